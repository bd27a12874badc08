"""sparkloom: tabular profiling, splitting and imputation on Spark DataFrames."""

from .config import ImputationConfig, Modality, PipelineConfig, PipelinePhase, ProfileConfig, SemanticType, SplitConfig
from .plans.imputer import FittedImputer, ImputationOrchestrator
from .plans.profiler import CorrelationProfiler, NonlinearityProfiler, StructuralProfiler
from .plans.splitter import DataSplitter
from .results import ColumnProfile, DatasetStats, FoldResult, ImputationFitDiagnostic, SplitResult, StructuralProfileResult
from .sources.loader import DataLoader, UnsupportedFormatError

__version__ = "0.1.0"

__all__ = [
    "ColumnProfile", "CorrelationProfiler", "DataLoader", "DataSplitter", "DatasetStats", "FittedImputer", "FoldResult", "ImputationConfig", "ImputationFitDiagnostic",
    "ImputationOrchestrator", "Modality", "NonlinearityProfiler", "PipelineConfig", "PipelinePhase", "ProfileConfig", "SemanticType", "SplitConfig", "SplitResult",
    "StructuralProfileResult", "StructuralProfiler", "UnsupportedFormatError",
]
