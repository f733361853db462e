import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payerlens.operators import drift, forest, periods
from payerlens.operators.contracts import (
    ContractError,
    cast_declared,
    declared_type,
    drop_empty_columns,
    looks_truncated,
    normalize_headers,
    require_columns,
    require_exact_columns,
    require_numeric,
    require_row_count,
    require_unchanged_count,
    resolve_columns,
    safe_identifiers,
)
from payerlens.operators.keyed import first_per_key, latest_per_key, mark_orphans, mark_repeated
from payerlens.operators.quantiles import exact_median, percent_ranks, robust_z
from payerlens.operators.stages import settle


@pytest.mark.parametrize("hot_rows", [10, 10_000_000])
def test_exact_median_matches_numpy(spark, hot_rows):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 700).round(2), np.full(500, 7.0), [np.nan] * 9])
    pdf = pd.DataFrame({"g": (["hot"] * 900 + ["warm"] * 300 + [None] * 9)[: len(values)], "x": values})
    df = spark.createDataFrame(
        [(g, None if math.isnan(x) else float(x)) for g, x in zip(pdf.g, pdf.x)], "g string, x double"
    )
    got = {r["g"]: r["x_median"] for r in exact_median(df, ["g"], ["x"], hot_rows=hot_rows).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part.x.median())
    assert got[None] is None


def test_robust_z_edges(spark):
    data = [("four", x) for x in (1.0, 2.0, 3.0, 9.0)] + [("five", x) for x in (1.0, 2.0, 3.0, 4.0, 90.0)]
    data += [("flat", 5.0)] * 4 + [("flat", 6.0)]
    df = spark.createDataFrame(data, "g string, x double")
    z = {(r["g"], r["x"]): r["x_z"] for r in robust_z(df, ["g"], ["x"]).collect()}
    assert z["four", 9.0] is None
    assert z["flat", 6.0] is None
    assert z["five", 90.0] == pytest.approx(0.6745 * 87)
    hot = {(r["g"], r["x"]): r["x_z"] for r in robust_z(df, ["g"], ["x"], hot_rows=2).collect()}
    assert hot == pytest.approx(z)


def test_all_null_and_long_tailed_groups(spark):
    """Groups without values stay; a slice that equal bins cannot part is narrowed again."""
    data = [("none", None)] * 8 + [("some", float(i)) for i in range(8)]
    data += [("tail", float(i)) for i in range(301)] + [("tail", 1e9), ("tail", 2e9)]
    data += [("split", float(i)) for i in range(40)] + [("split", 1e6 + i) for i in range(40)]
    df = spark.createDataFrame(data, "g string, x double")
    want = {"none": None, "some": 3.5, "tail": 151.0, "split": (39 + 1e6) / 2}
    for hot_rows in (4, 10, 1_000_000):
        got = exact_median(df, ["g"], ["x"], hot_rows=hot_rows, bins=16, most=5).collect()
        assert {r["g"]: r["x_median"] for r in got} == want
        assert robust_z(df, ["g"], ["x"], hot_rows=hot_rows).count() == len(data)


def test_percent_ranks_match_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": range(400), "a": rng.integers(0, 30, 400).astype(float), "b": rng.lognormal(0, 3, 400)})
    df = spark.createDataFrame(pdf)
    got = percent_ranks(df, {"a": "ra", "b": "rb"}).toPandas().sort_values("k")
    assert np.allclose(got.ra, pdf.a.rank(pct=True) * 100)
    assert np.allclose(got.rb, pdf.b.rank(pct=True) * 100)
    assert len(got) == 400


def test_percent_ranks_of_ties_nulls_and_repeated_rows(spark):
    values = [0.0] * 300 + [-0.0] * 5 + [None] * 7 + [math.inf, -math.inf, math.nan, math.nan] + [float(i % 90) for i in range(400)]
    data = [("same" if i < 300 else None, v, None) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k string, x double, none double")
    got = percent_ranks(df.repartition(5), {"x": "rx", "none": "rn"}).collect()
    known = [(math.isnan(v), 0.0 if math.isnan(v) else v) for v in values if v is not None]
    below = {v: sum(o < v for o in known) for v in set(known)}
    ties = Counter(known)
    want = [None] * 7 + [(below[v] + (ties[v] + 1) / 2) / len(known) * 100 for v in known]
    assert sorted(r.rx or 0.0 for r in got) == pytest.approx(sorted(w or 0.0 for w in want))
    assert all(r.rn is None for r in got) and len(got) == len(values)
    assert all((r.x is None) == (r.rx is None) for r in got)
    assert percent_ranks(df.limit(0), {"x": "rx"}).count() == 0


def test_month_gaps_and_history(spark, rows):
    df = spark.createDataFrame(
        [("p", "2020-11", 4), ("p", "2021-02", 2), ("q", "2020-01", 1)], "n string, period string, v int"
    )
    filled = periods.fill_months(df, ["n"], "period", ["v"])
    assert rows(filled) == [("p", "2020-11", 4), ("p", "2020-12", 0), ("p", "2021-01", 0), ("p", "2021-02", 2), ("q", "2020-01", 1)]
    base = periods.previous_median("v", ["n"], "period", 3)
    assert rows(filled.select("n", "period", base.alias("b")))[3] == ("p", "2021-02", 0.0)


def test_years(spark, rows):
    df = spark.createDataFrame([(2019, 5), (2022, 7)], "y int, v int")
    assert rows(periods.fill_years(df, [], "y", ["v"])) == [(2019, 5), (2020, 0), (2021, 0), (2022, 7)]


def psi(base, curr, floor=1e-4):
    keys = set(base) | set(curr)
    nb, nc = sum(base.values()), sum(curr.values())
    total = 0.0
    for k in keys:
        e, a = max(base.get(k, 0) / nb, floor), max(curr.get(k, 0) / nc, floor)
        total += (a - e) * math.log(a / e)
    return total


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    base=st.dictionaries(st.sampled_from("abcd"), st.integers(1, 50), min_size=1),
    curr=st.dictionaries(st.sampled_from("abcd"), st.integers(1, 50), min_size=1),
)
def test_psi_matches_definition(spark, base, curr):
    frame = lambda d: spark.createDataFrame([("g", k, v) for k, v in d.items()], "g string, category string, cnt long")
    got = drift.categorical_psi(frame(base), frame(curr), ["g"]).first()["psi"]
    assert got == pytest.approx(psi(base, curr)) and got >= -1e-12


def test_population_psi_counts_absent_and_rare(spark):
    data = [("d1", "a")] * 60 + [("d2", "b")] * 39 + [("d2", "rare")] * 1 + [("d1", None)] * 3
    df = spark.createDataFrame(data, "drug string, kind string")
    got = {r["drug"]: r["psi"] for r in drift.population_psi(df, "drug", "kind").collect()}
    base = {"a": 60, "b": 39, "OTHER": 1}
    assert got["d1"] == pytest.approx(psi(base, {"a": 60}))
    assert got["d2"] == pytest.approx(psi(base, {"b": 39, "OTHER": 1}))


def test_rolling_psi_limits(spark):
    months = [f"2020-{m:02d}" for m in range(1, 9)]
    data = [("t", m, "x" if (i + j) % 2 else "y") for j, m in enumerate(months) for i in range(300 if j < 7 else 299)]
    df = spark.createDataFrame(data, "kind string, month string, c string")
    got = drift.rolling_psi(df, "kind", "month", {"field": "c"}).collect()
    # The seventh month has six before it; the eighth is one row short.
    assert [(r["month"], r["baseline_rows"], r["current_rows"]) for r in got] == [("2020-07", 1800, 300)]
    assert got[0]["psi_score"] == pytest.approx(0.0)


def test_weighted_psi(spark):
    df = spark.createDataFrame([([5.0, 5.0], [10.0, 0.0]), ([5.0, 5.0], [0.0, 0.0])], "b array<double>, c array<double>")
    out = [r["psi"] for r in drift.weighted_psi(df, "b", "c").collect()]
    e, a = np.array([0.5, 0.5]), np.array([1.0, 1e-6]) / (1 + 1e-6)
    assert out[0] == pytest.approx(float(((a - e) * np.log(a / e)).sum()))
    assert out[1] == 0.0


def test_picks_and_flags(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 3, "w"), (None, 3, "w")], "k string, t int, v string")
    assert rows(latest_per_key(df, ["k"], ["t"])) == [("a", 2, "z"), (None, 3, "w")]
    assert rows(first_per_key(df, ["k"], ["t"])) == [("a", 1, "x"), (None, 3, "w")]
    flagged = mark_repeated(df, ["k", "t"], "again")
    assert [r["again"] for r in flagged.orderBy("v").collect()] == [True, True, False, True, True]
    master = spark.createDataFrame([("a",), ("a",)], "k string")
    orphans = mark_orphans(spark.createDataFrame([("a",), ("b",), ("",), (None,)], "k string"), master, "k", "o")
    assert sorted((r["k"] or "", r["o"]) for r in orphans.collect()) == [("", False), ("", False), ("a", False), ("b", True)]


def test_contracts(spark):
    df = spark.createDataFrame([("1", None, "x")], "a string, b string, c string")
    assert require_exact_columns(df, ["a", "b", "c"]) is df
    for bad in (["a", "c", "b"], ["a", "b"], ["a", "b", "c", "d"]):
        with pytest.raises(ContractError):
            require_exact_columns(df, bad)
    with pytest.raises(ContractError):
        require_columns(df, ["z"])
    with pytest.raises(Exception, match="not numeric: c: x"):
        require_numeric(df, ["a", "c"]).collect()
    assert require_numeric(df, ["a", "b"]).first()["a"] == 1.0
    with pytest.raises(Exception, match="expected 474 rows, found 1"):
        require_row_count(df, 474).collect()
    assert require_row_count(df, 1).collect() == df.collect()
    with pytest.raises(Exception, match="expected 2 rows as before, found 1"):
        require_unchanged_count(df, df.union(df)).collect()
    assert require_unchanged_count(df, df).count() == 1
    assert drop_empty_columns(df).columns == ["a", "c"]
    assert resolve_columns(df.toDF("Drug_name", "x", "y"), ["Drug Name"]).columns[0] == "Drug Name"
    assert normalize_headers(df.toDF("Calendar Year", "Total (Age 65+)", "k"), {"k": "z"}).columns == ["calendar_year", "total_age65plus", "z"]
    assert safe_identifiers(df.toDF("a b-c/d", "e,(f)", "x" * 65)).columns == ["a_b_c_d", "ef", "column_3"]
    assert [declared_type(t) for t in ("INTEGER", "varchar(3)", "DECIMAL(1)", "DATETIME", None)] == ["bigint", "string", "decimal(18,4)", "timestamp", "string"]
    assert cast_declared(df, {"a": "INT", "c": "REAL"}).dtypes[0] == ("a", "bigint")
    assert looks_truncated(1_048_575) and not looks_truncated(1_048_574)


def test_settle_keeps_rows_and_types(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    back = settle(df)
    assert back.dtypes == df.dtypes and rows(back) == rows(df)


def test_forest_ranks_planted_outlier(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": range(300), "a": rng.normal(0, 1, 300), "b": rng.normal(0, 1, 300)})
    pdf.loc[17, ["a", "b"]] = [40.0, -40.0]
    df = spark.createDataFrame(pdf)
    scored = forest.score(df, forest.fit(df, "k", ["a", "b"], trees=30), ["a", "b"])
    best = scored.orderBy(F.desc("anomaly_score")).first()
    assert best["k"] == 17
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 < low < high < 1


def test_checks_run_no_job_when_built(spark, tmp_path):
    spark.createDataFrame([("1", "x")], "a string, b string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checks", "checks")
    try:
        built = require_row_count(require_numeric(df, ["a", "b"]), 5)
        assert tracker.getJobIdsForGroup("checks") == []
        with pytest.raises(Exception, match="not numeric|expected 5 rows"):
            built.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("odd", [[float("nan")], [float("-inf"), float("inf")], [float("nan")] * 3 + [float("-inf")] * 5])
def test_medians_with_endless_values(spark, odd):
    values = [float(v) for v in range(-40, 400, 3)] + odd
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    hot = exact_median(df, ["k"], ["v"], hot_rows=10, bins=4, most=5).first()[1]
    assert hot == exact_median(df, ["k"], ["v"]).first()[1]


def test_hot_medians_keep_values_where_they_are(spark, monkeypatch):
    from payerlens.operators import quantiles

    rng = np.random.default_rng(5)
    values = {"a": rng.lognormal(2, 3, 6000), "b": rng.integers(0, 3, 3000).astype(float), "c": np.full(2000, 4.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, x double")
    settled = []
    monkeypatch.setattr(quantiles, "settle", lambda frame, to=quantiles.settle: settled.append(to(frame)) or settled[-1])
    got = {r["g"]: r["x_median"] for r in exact_median(df, ["g"], ["x"], hot_rows=10, bins=32, most=50).collect()}
    assert got == pytest.approx({g: float(np.median(vs)) for g, vs in values.items()})
    assert len(settled) > 2 and all(s.count() <= len(values) for s in settled)  # a range a group, no values
