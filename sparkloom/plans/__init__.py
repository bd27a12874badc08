"""Flows over several operators: profiling, splitting, imputation."""
