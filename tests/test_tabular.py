import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from sparkloom import DataLoader, DataSplitter, ImputationOrchestrator, PipelineConfig, ProfileConfig, SemanticType, StructuralProfiler, UnsupportedFormatError
from sparkloom.config import ImputationConfig, ImputationStrategy, NumericImputationConfig, NumericKind, PipelinePhase
from sparkloom.functions import casts, mathx
from sparkloom.functions.nulls import normalize
from sparkloom.operators import columns as C
from sparkloom.operators import pairs as P
from sparkloom.operators.base import average_ranks
from sparkloom.operators.types import detect
from sparkloom.plans import imputer as I
from sparkloom.plans.profiler import NonlinearityProfiler, flat, scale_anomaly, severity, target_profile
from sparkloom.plans.router import Case, route
from sparkloom.plans.splitter import label_matrix
from sparkloom.results import ColumnMissingnessProfile, ColumnProfile, MissingnessFlag, MissingSeverity, NumericStats, StructuralProfileResult
from sparkloom.streaming import impute_stream, missing_counts


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(42)
    rows = []
    for i in range(400):
        a = float(r.normal(50, 10))
        rows.append((i + 1, a if i % 9 else None, 3 * a + float(r.normal()), int(r.integers(1, 6)) if i % 13 else None, ["red", "green", "blue", "NA"][i % 4], bool(i % 2), datetime(2024, 1, 1) + timedelta(days=i), f"some longer words number {i} here"))
    return spark.createDataFrame(rows, "id long, a double, b double, rating long, colour string, flag boolean, day timestamp, note string")


def test_effective_nulls(spark):
    rows = [("NA", 1.0, 1), (" NA ", float("nan"), -9), ("\t ", float("inf"), 3), ("nan", None, None), ("ok", -1.0, 4), (None, 2.0, 5)]
    d = spark.createDataFrame(rows, "s string, x double, k int")
    got = normalize(d, {"x": [-1], "k": [-9]}).collect()
    assert [r["s"] for r in got] == [None, " NA ", None, None, "ok", None]
    assert [r["x"] for r in got] == [1.0, None, None, None, None, 2.0]
    assert [r["k"] for r in got] == [1, None, 3, None, 4, 5]
    own = normalize(d, None, {"s": ["OK"]}).collect()
    assert [r["s"] for r in own] == ["NA", " NA ", None, "nan", None, None], "declared words replace the built-in ones"


def test_casts(spark):
    d = spark.createDataFrame([(s,) for s in ("1.5", " 1", "1d", "-2e3", "2015", "2015-03-02", "2015-03-02 10:11:12", "yes", "F", "x")], "s string")
    kind = d.schema["s"].dataType
    r = d.select(casts.to_double(F.col("s"), kind).alias("n"), casts.to_timestamp(F.col("s"), kind).alias("t"), casts.to_boolean(F.col("s"), kind).alias("b")).collect()
    assert [x["n"] for x in r] == [1.5, None, None, -2000.0, 2015.0, None, None, None, None, None]
    assert [x["t"] for x in r][4:7] == [None, datetime(2015, 3, 2), datetime(2015, 3, 2, 10, 11, 12)]
    assert [x["b"] for x in r][7:] == [True, False, None]
    years = d.select(casts.to_timestamp(F.col("s"), kind, fmt="%Y").alias("t")).collect()
    assert years[4]["t"] == datetime(2015, 1, 1)
    assert casts.java_pattern("%d/%m/%Y at %H:%M") == "dd/MM/yyyy' at 'HH:mm"
    e = spark.createDataFrame([(86400,)], "k long")
    for unit, want in (("s", datetime(1970, 1, 2)), ("d", datetime(1970, 1, 1) + timedelta(days=86400)), ("ms", datetime(1970, 1, 1, 0, 1, 26, 400000))):
        assert e.select(casts.to_timestamp(F.col("k"), e.schema["k"].dataType, unit=unit)).first()[0] == want


def test_tails_of_distributions():
    assert mathx.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert mathx.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert mathx.f_sf(4.0, 2, 10) == pytest.approx((1 + 2 * 4 / 10) ** -5, abs=1e-9)
    assert mathx.wilson_lower(0, 10) == pytest.approx(0, abs=1e-12) and 0.2 < mathx.wilson_lower(5, 10) < 0.25


def test_dip_and_mixture():
    r = np.random.default_rng(42)
    one, two = r.normal(size=200), np.r_[r.normal(size=100), r.normal(10, 1, 100)]
    dips = [mathx.dip(*np.unique(x, return_counts=True)) for x in (one, two)]
    assert dips[0] < 0.04 < 0.1 < dips[1] <= 0.25
    assert mathx.dip_p_value(dips[1], 200, 100) < 0.05 < mathx.dip_p_value(dips[0], 200, 100)
    mean, std, share = mathx.mixture_of_two(*np.unique(two, return_counts=True))
    assert sorted(mean) == pytest.approx([0, 10], abs=0.5) and share == pytest.approx([0.5, 0.5], abs=0.02) and (std < 1.5).all()


def test_mutual_information():
    r = np.random.default_rng(1)
    x = r.normal(size=800)
    y = 0.9 * x + math.sqrt(1 - 0.81) * r.normal(size=800)
    assert mathx.mutual_information(x, y, False, False) == pytest.approx(-0.5 * math.log(1 - 0.81), abs=0.12)
    assert mathx.mutual_information(x, r.normal(size=800), False, False) < 0.08
    assert mathx.mutual_information((x > 0).astype(int), x, True, False) == pytest.approx(math.log(2), abs=0.08)
    assert mathx.mutual_information(np.array([0, 1] * 50), np.array([0, 1] * 50), True, True) == pytest.approx(math.log(2))


@pytest.mark.parametrize(
    "values,kind,flags",
    [
        ([1, 2, 3, 4, 5] * 20, "categorical", {"encoded_category"}),
        ([0, 1] * 20, "boolean", {"boolean_candidate"}),
        (list(range(1, 101)), "identifier", {"identifier_column", "sequential_index"}),
        (list(range(0, 100)), "identifier", {"identifier_column"}),
        ([i * 7 % 91 for i in range(200)], "numeric", set()),
        ([f"u{i:08d}" for i in range(60)], "identifier", {"identifier_column"}),
        ([f"Smith, John Paul the {i}" for i in range(60)], "text", {"free_text_candidate"}),
        (["1", "2", "3"] * 40, "categorical", {"numeric_coerced", "encoded_category"}),
        (["1.5", "2.25", "3.75"] * 40, "numeric", {"numeric_coerced"}),
        (["2024-01-01", "2024-01-02"] * 20, "datetime", {"datetime_coerced"}),
        (["2000", "2001"] * 30, "categorical", {"numeric_coerced", "encoded_category"}),
        (["yes", "No"] * 20, "boolean", {"boolean_candidate"}),
        (["red", "green", "blue"] * 20, "categorical", set()),
    ],
)
def test_type_detection(spark, values, kind, flags):
    t = "string" if isinstance(values[0], str) else "long"
    info = detect(spark.createDataFrame([(v,) for v in values], f"c {t}"))["c"]
    assert info.semantic_type == kind and set(info.flags) == flags


def test_bounded_discrete_boundaries(spark):
    def kind(values):
        return detect(spark.createDataFrame([(float(v),) for v in values], "c double"))["c"].numeric_kind

    assert kind([1, 2, 3, 4, 5] * 10) == NumericKind.BoundedDiscrete
    assert kind([1, 2, 4, 5] * 10) == NumericKind.Continuous, "a hole"
    assert kind([2, 3, 4] * 10) == NumericKind.Continuous, "starts at neither 0 nor 1"
    assert kind([1.5, 2, 3] * 10) == NumericKind.Continuous


def test_all_null_and_empty_tables(spark):
    schema = "x double, k long, s string, b boolean, d date"
    for rows in ([], [(None,) * 5] * 60):
        p = StructuralProfiler().profile(spark.createDataFrame(rows, schema))
        assert p.dataset.row_count == len(rows) and set(p.columns) == {"x", "k", "s", "b", "d"}
        assert json.loads(p.to_json()) and p.to_markdown() and p.to_full_markdown()
    assert p.columns["x"].missingness.has_flag(MissingnessFlag.FullyNull) and p.columns["k"].semantic_type == SemanticType.Boolean


def test_missingness(spark):
    rows = [(None if i < 24 else 1.0, None if i < 24 else "x", None if i % 50 == 0 else i) for i in range(100)]
    config = PipelineConfig()
    p = StructuralProfiler(config).profile(spark.createDataFrame(rows, "a double, s string, k long"))
    m = {c: p.columns[c].missingness for c in "ask"}
    assert m["a"].severity == MissingSeverity.Severe and m["a"].correlated_with == ["s"] and m["s"].has_flag(MissingnessFlag.MARSuspect)
    assert m["k"].severity == MissingSeverity.Moderate and not m["k"].flags
    assert p.dataset.missingness_matrix["a"]["s"] == pytest.approx(1.0)
    d = p.dataset.row_distribution
    assert d.pct_zero_missing == pytest.approx(0.75) and d.row_missing_p90 == 2 and d.drop_candidate_row_count == 24
    assert severity(0.0, config.profiling.missingness) is None


def test_numeric_profile_against_numpy(spark):
    r = np.random.default_rng(3)
    x = r.gamma(2, 3, 500)
    p = StructuralProfiler().profile(spark.createDataFrame([(float(v),) for v in x], "x double")).columns["x"].stats
    n, m = len(x), x - x.mean()
    g1, g2 = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2 - 3
    assert p.mean == pytest.approx(x.mean()) and p.std == pytest.approx(x.std(ddof=1)) and p.percentiles.p95 == pytest.approx(np.quantile(x, 0.95))
    assert p.skewness == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert p.kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    edges = np.histogram_bin_edges(x, bins="auto")
    assert len(p.histogram) == len(edges) - 1 and [b.count for b in p.histogram] == np.histogram(x, edges)[0].tolist()
    assert p.outlier_density == pytest.approx((np.abs(m) > 3 * x.std(ddof=1)).mean())
    assert scale_anomaly(1, 1000, 3) and not scale_anomaly(0.0001, 1, 3) and not scale_anomaly(2, 100, 3)


def test_fifty_columns_in_one_pass(spark):
    x = np.random.default_rng(1).normal(size=(1000, 50))
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"f{i} double" for i in range(50)))
    rows = {r["column"]: r for r in C.numeric_summary(d, d.columns).collect()}
    assert all(rows[f"f{i}"]["mean"] == pytest.approx(x[:, i].mean()) and rows[f"f{i}"]["p25"] == pytest.approx(np.quantile(x[:, i], 0.25)) for i in range(50))


def test_bimodal_column(spark):
    r = np.random.default_rng(42)
    x = np.r_[r.normal(size=100), r.normal(10, 1, 100)]
    s = StructuralProfiler().profile(spark.createDataFrame([(float(v),) for v in x], "v double")).columns["v"].stats
    assert s.has_flag("bimodal") and s.bimodal_stats.center1 == pytest.approx(0, abs=0.5) and s.bimodal_stats.cluster_separation > 2


def test_pairs_against_numpy(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=300), 1)
    y = x**3 + np.round(r.normal(size=300), 1)
    d = spark.createDataFrame([(float(a), float(b), 1.0, None if i % 5 else float(a)) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, c double, h double")
    got = {(r["column_a"], r["column_b"]): r["pearson"] for r in P.pearson(d, ["x", "y", "c", "h"]).collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["x", "c"] == 0.0
    assert got["y", "h"] == pytest.approx(np.corrcoef(y[::5], x[::5])[0, 1])
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    ranks = {r["value"]: r["rank"] for r in average_ranks(d, "x", 8).collect()}
    assert ranks == {float(a): float(b) for a, b in zip(x, rank(x))}
    s = P.spearman(d, ["x", "y"]).first()["spearman"]
    assert s == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_cramers_v_with_yates(spark):
    table = {("a", "x"): 30, ("a", "y"): 10, ("b", "x"): 12, ("b", "y"): 28}
    d = spark.createDataFrame([k for k, n in table.items() for _ in range(n)], "p string, q string")
    r = P.cramers_v(d, "p", "q").first()
    o = np.array([[30, 10], [12, 28]], float)
    e = o.sum(1, keepdims=True) @ o.sum(0, keepdims=True) / o.sum()
    chi2 = ((np.abs(o - e) - 0.5) ** 2 / e).sum()
    n = 80
    assert r["chi2"] == pytest.approx(chi2) and r["cramers_v"] == pytest.approx(math.sqrt((chi2 / n - 1 / (n - 1)) / (2 - 1 / (n - 1) - 1)))


def test_nonlinearity_tags(spark):
    r = np.random.default_rng(42)
    a, b = r.normal(size=400), r.normal(size=400)
    d = spark.createDataFrame([tuple(map(float, v)) for v in zip(a, b, 2 * a + 3 * b + 0.1 * r.normal(size=400))], "x1 double, x2 double, y double")
    got = NonlinearityProfiler(["x1", "x2", "y"]).profile(d)
    assert got["y"]["r2_linear"] > 0.9 and got["y"]["nonlinearity_tag"] in ("linear", "complex_nonlinear") and 0 <= got["y"]["heteroscedasticity_p_value"] <= 1
    noise = spark.createDataFrame([tuple(map(float, v)) for v in r.normal(size=(300, 3))], "x1 double, x2 double, y double")
    assert NonlinearityProfiler(["x1", "x2", "y"]).profile(noise)["y"]["nonlinearity_tag"] == "unpredictable"


def test_profile_of_all_types(mixed, spark):
    config = PipelineConfig(profiling=ProfileConfig(target_columns=["colour", "b"], compute_correlation=True))
    config.add_exclusion("note")
    p = StructuralProfiler(config, datetime(2024, 6, 1)).profile(mixed)
    assert {c: str(x.semantic_type) for c, x in p.columns.items()} == {"id": "identifier", "a": "numeric", "b": "numeric", "rating": "categorical", "colour": "categorical", "flag": "boolean", "day": "datetime"}
    assert p.columns["day"].stats.inferred_granularity == "daily" and p.columns["day"].stats.future_date_count > 0
    assert p.columns["colour"].missingness.effective_null_ratio == 0.25 and p.columns["colour"].stats.cardinality == 3
    assert p.columns["flag"].stats.mode is None and p.targets["b"].problem_type == "regression" and p.targets["colour"].problem_type == "multiclass_classification"
    k = p.dataset.target_correlations["b"]
    assert k.feature_target_numeric[0].feature == "a" and k.feature_target_numeric[0].pearson_r > 0.99 and k.top_mi(1)[0].feature == "a"
    assert p.dataset.feature_correlation.near_redundancy_groups[0].suggested_drop == ["b"]
    assert "Target analysis" in p.to_markdown() and flat(p, spark).where("metric = 'semantic_type'").count() == 7
    with pytest.raises(TypeError):
        StructuralProfiler().profile([1])


def test_target_of_text_labels(spark):
    d = spark.createDataFrame([(v,) for v in ["cat"] * 60 + ["dog"] * 5], "label string")
    t = target_profile(d, "label", ProfileConfig())
    assert t.problem_type == "binary_classification" and t.has_flag("high_imbalance") and not t.has_flag("severe_imbalance")


def test_config_round_trips():
    c = PipelineConfig(random_seed=3)
    c.add_exclusion(["a", "a", "b"])
    c.add_phase_exclusion("scaling", "c")
    c.set_column_type("x", "numeric")
    c.set_numeric_kind("x", "continuous")
    c.profiling.set_numeric_sentinel("x", [-1])
    c.profiling.set_datetime_epoch_unit("t", "ms")
    c.imputation.numeric.set_per_column_strategy("x", "knn")
    c.imputation.add_mnar_column("z")
    assert PipelineConfig.from_json(c.to_json()).to_dict() == c.to_dict()
    assert c.resolve_active_columns(PipelinePhase.Scaling, ["d", "c", "b", "a"]) == ["d"]
    with pytest.raises(ValueError):
        c.profiling.set_datetime_format("t", "%Y")
    with pytest.raises(ValueError):
        c.imputation.numeric.set_per_column_constant_fill("x", 1)
    with pytest.raises(ValueError):
        NumericImputationConfig().set_per_column_strategy("x", "passthrough")
    both = ImputationConfig()
    both.add_mnar_column("q")
    both.numeric.set_per_column_strategy("q", "mean")
    with pytest.raises(ValueError):
        both.validate()


def test_splits(mixed):
    s = DataSplitter(mixed, "colour", 7)
    r = s.random_split(0.25)
    assert (r.train_size, r.test_size) == (300, 100) and r.train.join(r.test, "id").count() == 0
    assert {x["colour"]: x["count"] for x in r.test.groupBy("colour").count().collect()} == {"red": 25, "green": 25, "blue": 25, "NA": 25}
    again = DataSplitter(mixed.repartition(9), "colour", 7).random_split(0.25)
    assert sorted(x["id"] for x in r.test.collect()) == sorted(x["id"] for x in again.test.collect())
    t = s.time_split("day", 0.1)
    assert t.test_size == 40 and t.train.agg(F.max("day")).first()[0] < t.test.agg(F.min("day")).first()[0]
    c = s.time_split("day", cutoff=datetime(2024, 2, 1))
    assert (c.train_size, c.test_size) == (31, 369)
    for folds in (s.kfold(7, stratify=False), s.kfold(5)):
        ids = [x["id"] for f in folds for x in f.val.select("id").collect()]
        assert sorted(ids) == list(range(1, 401)) and max(f.val_size for f in folds) - min(f.val_size for f in folds) <= 1
    for bad in (lambda: DataSplitter(mixed.limit(0)), lambda: DataSplitter(mixed, "nope"), lambda: DataSplitter(mixed).random_split(0.2, stratify=True), lambda: s.time_split("day"), lambda: s.kfold(1)):
        with pytest.raises(ValueError):
            bad()


def test_profile_stratified_splits(mixed):
    p = StructuralProfiler().profile(mixed)
    s = DataSplitter(mixed, "colour", 3)
    clean, signals = label_matrix(mixed, p, "colour")
    assert {"a:missing", "rating:missing", "colour:missing", "colour:red"} <= set(signals)
    r = s.profile_stratified_split(p, 0.2)
    assert r.test_size == 80 and r.train.join(r.test, "id").count() == 0
    assert abs(r.test.where("a is null").count() - 9) <= 2
    assert r.test.where("colour = 'NA'").count() == 20, "cells come back as they were"
    folds = s.profile_stratified_kfold(p, 4)
    assert sum(f.val_size for f in folds) == 400 and all(f.val_size == 100 for f in folds)
    plain = mixed.sparkSession.createDataFrame([(float(i), float(i)) for i in range(100)], "x double, y double")
    assert DataSplitter(plain, random_seed=1).profile_stratified_split(StructuralProfileResult(), 0.25).test_size == 25


def column(null_ratio, flags=(), kind=NumericKind.Continuous, correlated=(), **stats):
    m = ColumnMissingnessProfile("x", 1000, 0, int(1000 * null_ratio), 0.0, null_ratio, severity(null_ratio, ProfileConfig().missingness), list(flags), list(correlated))
    return ColumnProfile("x", SemanticType.Numeric, kind, missingness=m, stats=NumericStats(**stats))


MAR, BOUNDED = [MissingnessFlag.MARSuspect], NumericKind.BoundedDiscrete


@pytest.mark.parametrize(
    "profile,more,want",
    [
        (column(0.6, [MissingnessFlag.DropCandidate]), {}, "dropped"),
        (column(0.1), {"mnar": frozenset("x")}, "mnar"),
        (column(0.0), {}, "passthrough"),
        (column(0.005, skewness_severity="normal"), {}, "mean"),
        (column(0.005, skewness_severity="high"), {}, "median"),
        (column(0.005, kurtosis_tag="leptokurtic"), {}, "knn"),
        (column(0.03, skewness_severity="severe"), {}, "knn"),
        (column(0.1), {}, "knn"),
        (column(0.1), {"rows": 60_000}, "regression"),
        (column(0.1), {"rows": 100, "features": 60}, "median"),
        (column(0.3), {}, "mice"),
        (column(0.1, flags=MAR, correlated=["y"]), {}, "regression"),
        (column(0.1, flags=MAR, correlated=["y"]), {"rows": 100}, "knn"),
        (column(0.1, flags=MAR, correlated=["y"]), {"several_mar": True}, "mice"),
        (column(0.03, flags=MAR, correlated=["y"]), {}, "median"),
        (column(0.1, nonlinearity_tag="unpredictable"), {}, "median"),
        (column(0.1, flags=["near_constant"]), {}, "knn"),
        (column(0.02, kind=BOUNDED), {}, "mode"),
        (column(0.1, kind=BOUNDED), {}, "knn"),
        (column(0.1, kind=BOUNDED, nonlinearity_tag="unpredictable"), {}, "mode"),
    ],
)
def test_routes(profile, more, want):
    case = Case("x", profile, NumericImputationConfig(), **({"rows": 1000, "features": 5} | more))
    assert route(case)[0] == want and route(case)[1]


def test_imputation_end_to_end(spark):
    r = np.random.default_rng(42)
    rows = []
    for i in range(600):
        a, b = r.normal(), r.normal()
        c = 2 * a - b + 0.1 * r.normal()
        rows.append((float(a), float(b), None if i % 9 == 0 else float(c), None if i % 40 == 0 else int(r.integers(1, 6)), None if i % 7 == 0 else float(a + b), None if i % 100 == 0 else float(r.normal()), "ab"[i % 2]))
    d = spark.createDataFrame(rows, "a double, b double, c double, rating int, m double, e double, label string")
    config = PipelineConfig(random_seed=5)
    config.set_column_type("rating", "numeric")
    config.set_numeric_kind("rating", "bounded_discrete")
    for name, s in (("c", "regression"), ("rating", "knn"), ("m", "mice")):
        config.imputation.numeric.set_per_column_strategy(name, s)
    config.imputation.add_mnar_column("e")
    p = StructuralProfiler(config).profile(d)
    fitted, result = ImputationOrchestrator(config).fit_transform(d, p)
    out = result.dataframe.toPandas()
    assert not out.isna().any().any() and "e_missing" in out and out["e_missing"].sum() == 6 and len(out) == 600
    assert set(out["rating"]) <= {1, 2, 3, 4, 5} and result.dataframe.schema["rating"].dataType.simpleString() == "int"
    truth = 2 * out["a"] - out["b"]
    gone = [i for i in range(600) if i % 9 == 0]
    assert fitted.records["c"].diagnostic.r2_train > 0.95 and fitted.records["rating"].domain_snap_bounds == (1, 5)
    merged = out.merge(d.toPandas()[["a", "b", "c"]].rename(columns={"c": "old"}), on=["a", "b"])
    off = (merged["c"] - (2 * merged["a"] - merged["b"]))[merged["old"].isna()]
    assert len(off) == len(gone) and off.abs().mean() < 0.3 and len(truth) == 600
    copy = I.FittedImputer.from_dict(json.loads(json.dumps(fitted.to_dict())))
    again = copy.transform(d).dataframe.toPandas()
    assert np.allclose(out.sort_values(["a"])["c"], again.sort_values(["a"])["c"])
    fitted.apply_exclusions(config)
    assert config.phase_exclusions[PipelinePhase.Scaling] == ("e_missing",)
    with pytest.raises(I.UnseenColumnError):
        fitted.transform(d.withColumn("new", F.lit(1)))
    with pytest.raises(I.FittedColumnAbsentError):
        fitted.transform(d.drop("a"))
    with pytest.raises(I.UnfittedColumnError):
        fitted.transform(d.withColumn("label", F.lit(None).cast("string")))


def test_scalar_fills(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, None), (None, 6.0), (4, 6.0)], "k int, x double")
    assert I.fills_of(d, {"x": "mean"})["x"] == 3.75 and I.fills_of(d, {"x": "median"})["x"] == 4.0
    assert I.mode_of(d, "k") == 2.0 and I.mode_of(d, "x") == 6.0 and I.mode_of(d.where("k = 99"), "x") == 0.0
    assert [r[0] for r in d.select(I.fill_column(d, "k", F.lit(2.5))).collect()] == [1, 2, 2, 2, 4]


def test_group_cluster_and_mixture_fills(spark):
    r = np.random.default_rng(1)
    rows = [("lo" if i % 2 else "hi", float((1 if i % 2 else 10) + 0.1 * r.normal()) if i % 10 > 1 else None, float((0 if i % 2 else 5) + r.normal() / 5), i) for i in range(200)]
    d = spark.createDataFrame(rows, "g string, x double, f double, i int")
    filled = I.group_fill(d, "x", I.fit_groups(d, "x", "g", "mean")).collect()
    assert all(abs(r["x"] - (1 if r["g"] == "lo" else 10)) < 1 for r in filled)
    state = I.fit_clusters(d, "x", (1.0, 10.0), ["f"], "median")
    by = d.select("g", I.fill_column(d, "x", I.cluster_fill(d, state)).alias("x")).collect()
    assert all(abs(r["x"] - (1 if r["g"] == "lo" else 10)) < 1 for r in by)
    mix = {"means": [1.0, 10.0], "stds": [0.1, 0.1], "weights": [0.25, 0.75]}
    big = spark.range(4000).select(F.col("id").alias("i"), F.lit(None).cast("double").alias("x"))
    drawn = [r[0] for r in big.select(I.fill_column(big, "x", I.drawn(big, mix, 1, "x"))).collect()]
    assert abs(np.mean(np.array(drawn) < 5) - 0.25) < 0.03 and abs(np.std([v for v in drawn if v > 5]) - 0.1) < 0.02
    same = [r[0] for r in big.repartition(5).orderBy("i").select(I.fill_column(big, "x", I.drawn(big, mix, 1, "x"))).collect()]
    assert same == drawn


def test_nearest_neighbours_by_hand():
    x = np.array([[0.0, 0.0, 1.0], [0.1, 0.0, 3.0], [10.0, 10.0, 50.0], [0.0, 0.1, np.nan]])
    state = I.fit_neighbours(x, ["a", "b", "c"], 2, False)
    assert I.apply_neighbours(state, x)[3, 2] == pytest.approx(2.0)
    assert I.n_neighbours(NumericImputationConfig(), 4, 1000, 0.1, 0.9) == (5, False) and I.n_neighbours(NumericImputationConfig(), 4, 4, 0.1, 0.9) == (3, True)


def test_loader(spark, tmp_path):
    load = DataLoader(spark).load
    (tmp_path / "a.csv").write_text("k;name;day\n1;é;2024-01-01\n2;b;2024-01-02\n", encoding="latin-1")
    got = load(str(tmp_path / "a.csv"))
    assert [r["name"] for r in got.orderBy("k").collect()] == ["é", "b"] and dict(got.dtypes) == {"k": "int", "name": "string", "day": "date"}
    (tmp_path / "b.tsv").write_text("k\tv\n1\t2\n")
    (tmp_path / "c.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "d.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    feather.write_feather(pa.table({"k": [1, 2, 3]}), str(tmp_path / "e.feather"))
    spark.range(4).write.parquet(str(tmp_path / "f.parquet"))
    for name, n in (("b.tsv", 1), ("c.json", 2), ("d.jsonl", 2), ("e.feather", 3), ("f.parquet", 4)):
        assert load(str(tmp_path / name)).count() == n, name
    assert load(str(tmp_path / "d.jsonl"), fmt="ndjson").count() == 2
    with pytest.raises(FileNotFoundError):
        load(str(tmp_path / "none.csv"))
    with pytest.raises(UnsupportedFormatError):
        load(str(tmp_path / "a.xyz"))


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, i), float(i) if i % 3 else None, "NA" if i % 2 else "x") for i in range(20)]
    d = spark.createDataFrame(rows, "t timestamp, x double, s string")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    counts = run(missing_counts(stream, "t", ["x", "s"], "10 minutes"), "missing_counts", "complete")
    assert sum(r["rows"] for r in counts) == 20 and sum(r["x_missing"] for r in counts) == 7 and sum(r["s_missing"] for r in counts) == 10
    config = PipelineConfig()
    config.imputation.numeric.set_per_column_constant_fill("x", -1.0)
    fitted = ImputationOrchestrator(config).fit(d, StructuralProfiler(config).profile(d))
    filled = run(impute_stream(stream, fitted), "imputed", "append")
    assert len(filled) == 20 and sum(r["x"] == -1.0 for r in filled) == 7


def test_strategies_are_named():
    assert ImputationStrategy("gmm_sampling") == ImputationStrategy.GMMSampling


def test_single_profilers(mixed):
    from sparkloom.plans import profilers as Q

    assert Q.MissingnessProfiler().profile(mixed).columns == {}
    m = Q.MissingnessProfiler(string_sentinels={"colour": ["red"]}).profile(mixed, ["a", "colour"])
    assert m.columns["colour"].effective_null_count == 100 and m.columns["a"].effective_null_count == 45 and not m.fully_null_columns
    assert Q.NumericProfiler().profile(mixed, ["b"]).columns["b"].percentiles.p50 == pytest.approx(150, abs=8)
    assert Q.CategoricalProfiler().profile(mixed, ["colour"]).columns["colour"].top_values[0].count == 100
    assert Q.BooleanProfiler().profile(mixed, ["flag"]).columns["flag"].true_count == 200
    assert Q.TextProfiler().profile(mixed, ["note"]).columns["note"].median_token_count == 6
    assert Q.DatetimeProfiler(now=datetime(2030, 1, 1)).profile(mixed, ["day"]).columns["day"].median_gap_seconds == 86400
    assert Q.TargetProfiler("flag").profile(mixed).problem_type == "binary_classification"
    assert Q.TabularProfiler().profile(mixed).row_count == 400 and Q.TypeDetector(["id"]).detect(mixed)["id"].semantic_type == "identifier"


def test_registered_neighbours_come_from_every_row(spark, tmp_path):
    from sparkloom.queries import QUERIES

    r = np.random.default_rng(3)
    size, price = r.integers(1, 51, 3000), r.permutation(3000) / 7 + 900 + r.random(3000) / 100
    spark.createDataFrame([(int(a), float(b)) for a, b in zip(size, price)], "p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["impute_knn"](spark, str(tmp_path)).first()
    donors, want, k = size != 1, size.astype(float), 5
    for i in np.flatnonzero(~donors):
        off = np.abs(price[donors] - price[i])
        near = np.argsort(off)[:k]
        want[i] = np.rint((size[donors][near] / off[near]).sum() / (1 / off[near]).sum())
    assert (got["rows"], got["p_size_n"], got["p_size_sum"]) == (3000, 3000, want.sum())


def test_regression_sees_predictors_as_it_was_fitted(spark):
    """Gaps of a predictor count as its mean in the fit; its own fill, here a far constant, must not enter the estimates."""
    r = np.random.default_rng(8)
    n = 700
    a, b = r.random(n), r.random(n)
    y = 3 * a + b + r.random(n) / 10
    gone, hole = np.arange(n) % 7 == 0, np.arange(n) % 5 == 0
    d = spark.createDataFrame([(f"k{i}", None if g else float(v), None if h else float(p), float(q)) for i, (g, h, v, p, q) in enumerate(zip(gone, hole, y, a, b))], "id string, y double, a double, b double")
    config = PipelineConfig(random_seed=5)
    for c in "yab":
        config.set_column_type(c, "numeric")
    config.imputation.numeric.set_per_column_strategy("y", "regression")
    config.imputation.numeric.set_per_column_constant_fill("a", 50.0)
    profile = StructuralProfiler(config).profile(d)
    fitted, result = ImputationOrchestrator(config).fit_transform(d, profile)
    assert fitted.models[0]["models"]["0"]["kind"] == "linear"
    got = np.array([x["y"] for x in sorted(result.dataframe.collect(), key=lambda x: int(x["id"][1:]))])
    design = np.c_[np.ones(n), np.where(hole, a[~hole].mean(), a), b]
    want = design @ np.linalg.lstsq(design[~gone], y[~gone], rcond=None)[0]
    assert np.allclose(got[gone], want[gone], atol=1e-4) and np.array_equal(got[~gone], y[~gone])
    assert {x["a"] for x in result.dataframe.collect() if int(x["id"][1:]) % 5 == 0} == {50.0}
    assert fitted.records["y"].diagnostic.imputed_mean == pytest.approx(float(got[gone].mean()), abs=1e-6)


def _brute_neighbours(x, wanted, k, weighted):
    """``wanted`` with missing cells filled from all rows of ``x``, one distance after the other."""
    mean, std = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    std[std == 0] = 1.0
    t, out = (x - mean) / std, wanted.copy()
    for i, c in zip(*np.nonzero(np.isnan(wanted))):
        donors = np.flatnonzero(~np.isnan(t[:, c]))
        off = t[donors] - (wanted[i] - mean) / std
        both = ~np.isnan(off)
        with np.errstate(all="ignore"):
            dist = np.where(both.any(axis=1), np.sqrt(np.where(both, off**2, 0.0).sum(axis=1) * x.shape[1] / both.sum(axis=1)), np.inf)
            near = np.lexsort((donors, dist))[:k]
            w = np.isfinite(dist[near]).astype(float)
            if weighted:
                w = (dist[near] == 0).astype(float) if (dist[near] == 0).any() else np.where(w > 0, 1 / dist[near], 0.0)
        out[i, c] = ((w * t[donors[near], c]).sum() / w.sum() if w.sum() else 0.0) * std[c] + mean[c]
    return out


@pytest.mark.parametrize("case", range(6))
def test_neighbours_found_by_boxes_are_those_of_all_rows(case):
    """Gaps in every column, many copies, few levels, one row far away, another scale: nothing nearer is left out."""
    r = np.random.default_rng(case)
    x = r.normal(size=(900, 2 + case % 3)) if case % 2 else r.integers(0, 30, (900, 2 + case % 3)).astype(float)
    x[:, -1] = x[:, -1] * 1e6 + 1e8
    x[r.random(x.shape) < (0.05, 0.4)[case % 2]] = np.nan
    x[0] = 1e9
    x = np.repeat(x, r.integers(1, 6, len(x)), axis=0) if case < 4 else x
    some = x[r.permutation(len(x))[:120]]
    for k, weighted in ((1, True), (5, True), (7, False)):
        got = I.apply_neighbours(I.fit_neighbours(x, list("abcd")[: x.shape[1]], k, weighted), some)
        assert np.allclose(got, _brute_neighbours(x, some, k, weighted), rtol=1e-9, atol=1e-7)


def test_registered_neighbours_beyond_the_declared_bound(spark, tmp_path):
    """More rows than ``knn_max_rows``: the query does all of them, and the imputer by itself still refuses."""
    from sparkloom.queries import QUERIES

    r, n = np.random.default_rng(4), 51_000
    size, price = r.integers(1, 51, n), r.permutation(n) / 7 + 900 + r.random(n) / 100
    d = spark.createDataFrame(pd.DataFrame({"p_size": size, "p_retailprice": price}))
    d.write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["impute_knn"](spark, str(tmp_path)).first()
    donors, want = size != 1, size.astype(float)
    for i in np.flatnonzero(~donors):
        off = np.abs(price[donors] - price[i])
        near = np.argpartition(off, 5)[:5]
        want[i] = np.rint((size[donors][near] / off[near]).sum() / (1 / off[near]).sum())
    assert (got["rows"], got["p_size_n"], got["p_size_sum"]) == (n, n, want.sum())
    config = PipelineConfig(random_seed=7)
    config.profiling.set_numeric_sentinel("p_size", [1])
    config.imputation.numeric.set_per_column_strategy("p_size", "knn")
    with pytest.raises(ValueError):
        ImputationOrchestrator(config).fit(d, StructuralProfiler(config).profile(d))
