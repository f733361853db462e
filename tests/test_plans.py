from datetime import datetime

import pytest
from pyspark.sql import functions as F

from payerlens.operators.rules import Rule, count_findings, failing_records
from payerlens.plans import auth_quality as A
from payerlens.plans import claims_anomaly as CA
from payerlens.plans import claims_quality as Q
from payerlens.plans import drug_anomaly as DA
from payerlens.plans import pharmacy_quality as P
from payerlens.plans import pharmacy_volume as PV
from payerlens.plans import risk as R
from payerlens.plans import reports, sla
from payerlens.plans import volume as V
from payerlens.sources import readers, sinks, store


def months(n, start=2020):
    return [f"{start + i // 12}-{i % 12 + 1:02d}" for i in range(n)]


def test_volume_history_of_five_and_six_months(spark):
    data = [("p", m, 10, ["a"]) for m in months(6)] + [("p", months(7)[6], 11, ["b"])]
    df = spark.createDataFrame(data, "NPI string, period string, monthly_volume long, month_sources array<string>")
    history = V.rolling_history(df).orderBy("period").collect()
    assert [r["risk_level"] for r in history] == ["INSUFFICIENT_HISTORY"] * 6 + ["MODERATE"]
    last = V.provider_volume_risk(V.rolling_history(df)).first()
    assert (last["deviation_pct"], last["sources"], last["total_claim_volume"]) == (10.0, "a, b", 71)
    assert "The deviation is 10.00%." in last["root_cause"]


def test_valid_claims_keeps_earliest_row(spark, rows):
    df = spark.createDataFrame(
        [("a", "1", "2020-02-01", "9.0"), ("a", "1", "2020-01-05", "8"), ("a", "2", "bad", "8"), ("a", "3", "2020-01-01", "nan"), ("b", "1", "2020-03-01", "7")],
        "source string, CLM_ID string, DT string, NPI string",
    )
    assert rows(V.valid_claims(df), "source", "CLM_ID", "NPI", "period") == [("a", "1", "8", "2020-01"), ("b", "1", "7", "2020-03")]


@pytest.mark.parametrize(
    "volumes,level,deviation",
    [([0, 0, 0, 0], "LOW", 0.0), ([0, 0, 0, 3], "INSUFFICIENT_HISTORY", None), ([4, 4, 4, 8], "LOW_VOLUME", 100.0), ([8, 8, 8, 10], "MODERATE", 25.0), ([8, 8, 8, 8], "LOW", 0.0), ([8, 8, 8, 20], "CRITICAL", 150.0)],
)
def test_auth_volume_zero_and_small_baselines(spark, volumes, level, deviation):
    # A first month outside the baseline keeps the series going back far enough.
    df = spark.createDataFrame([("p", m, v) for m, v in zip(months(4), volumes)], "NPI string, period string, monthly_volume long")
    last = V.auth_volume_risk(df).orderBy(F.desc("current_period")).first()
    assert (last["risk_level"], last["deviation_pct"]) == (level, deviation)


def test_run_sla_edges_and_totals(spark):
    t = datetime(2020, 1, 1)
    data = [(str(i), "run_claims_checks", "SUCCESS", t, t, m * 60.0 if m is not None else None) for i, m in enumerate([60.0, 63.0, 63.01, None])]
    df = spark.createDataFrame(data, "run_id string, step_name string, status string, started_at timestamp, completed_at timestamp, duration_seconds double")
    got = {r["run_id"]: r for r in sla.claim_runs(df).collect()}
    assert [got[str(i)]["sla_status"] for i in range(4)] == ["MET", "MINOR_OVERRUN", "BREACHED", "N/A"]
    assert (got["0"]["sla_met_count"], got["0"]["sla_breached_count"], got["0"]["sla_evaluable_runs"]) == (1, 2, 3)
    assert {r["sla_status"] for r in sla.pharmacy_runs(df).collect()} == {"MET", "MINOR_BREACH", "BREACHED"}


def test_auth_sla_edges(spark):
    hours = [72.0, 75.6, 75.7, -1.0, None]
    df = spark.range(5).select(
        F.col("id").cast("string").alias("authorization_id"),
        F.lit("2020-01-01").cast("timestamp").alias("request_date"),
        F.timestamp_micros(F.unix_micros(F.lit("2020-01-01").cast("timestamp")) + (F.get(F.array(*[F.lit(h).cast("double") for h in hours]), F.col("id").cast("int")) * 3.6e9).cast("bigint")).alias("approval_date"),
        F.lit(" ").alias("provider_id"),
    )
    got = sla.auth_requests(df).orderBy("authorization_id").collect()
    assert [r["sla_status"] for r in got] == ["MET", "MINOR_BREACH", "BREACHED", "N/A", "N/A"]
    metrics = sla.auth_provider_metrics(sla.auth_requests(df)).first()
    assert (metrics["npi"], metrics["npi_total_rows"], metrics["npi_affected_rows"], metrics["npi_completeness_score"]) == (None, 5, 2, 0.0)


def test_behavior_from_zero(spark):
    df = spark.createDataFrame([(m, v) for m, v in zip(months(5), [0, 0, 0, 5, 0])], "t string, v long")
    reasons = {k: k for k in ("short", "zero", "from_zero", "normal")} | {"changed": "{} {}"}
    got = sla.behavior(df, "v", "t", reasons, "b").orderBy("t").collect()
    assert [(r["behavior_status"], r["behavior_reason"], r["behavior_deviation_pct"]) for r in got[3:]] == [("ANOMALOUS", "from_zero", None), ("ANOMALOUS", "decreased 100.00", 100.0)]


def test_rules_count_records_once(spark, rows):
    df = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 9), ("k3", None)], "k string, x int")
    rules = [Rule("D", f"r{i}", "quarantine", F.col("x") >= i) for i in range(1, 130)]
    counted = count_findings(failing_records(df, rules, ["k"]), rules)
    got = {(r["dimension"], r["rule"]): r["affected"] for r in counted.collect()}
    assert (got["D", "r1"], got["D", "r2"], got["D", "r9"], got["D", "r10"], got["D", None]) == (2, 2, 1, 0, 2)


def claims_frame(spark):
    columns = "BENE_ID CLM_ID LINE_NUM PRVDR_NPI CLM_FROM_DT CLM_THRU_DT CLM_PMT_AMT LINE_NCH_PMT_AMT ICD_DGNS_CD1".split()
    data = [
        ("1", "c1", "1", "1234567890", "2020-01-02", "2020-01-03", "11", "5", "A01"),
        ("1", "c1", "2", "1234567890", "2020-01-02", "2020-01-01", "11", "5", "A0"),
        ("9", "c2", "1", "123", "junk", "2020-01-03", "10", "4", ""),
        ("", "c2", "1", "", "20200101", "2020-01-03", "10", "4", "B12"),
    ]
    return spark.createDataFrame(data, columns)


def test_claim_findings(spark):
    people = Q.prepare_beneficiaries(spark.createDataFrame([("1", "01", "1950-01-01", "1", "2020")], list(Q.BENE_REQUIRED)))
    df = Q.prepare(claims_frame(spark), people)
    got = {r["rule"]: r["affected"] for r in Q.claim_findings(df, "dme").collect() if r["rule"]}
    assert got == {
        "missing_BENE_ID": 1, "missing_PRVDR_NPI": 1, "invalid_npi_format_PRVDR_NPI": 1, "missing_ICD_DGNS_CD1": 1,
        "invalid_diag_code_inferred_ICD_DGNS_CD1": 1, "bene_id_not_in_enrollment": 1,
        "CLM_THRU_DT_before_CLM_FROM_DT": 1, "nonstandard_date_format_CLM_FROM_DT": 1,
        "header_CLM_PMT_AMT_ne_sum_LINE_NCH_PMT_AMT": 1,
    }


def test_whole_quality_run_table(spark):
    people = spark.createDataFrame([("1", "01", "1950-01-01", "1", "2020")], list(Q.BENE_REQUIRED))
    run = Q.QualityRun({"dme": claims_frame(spark)}, people, "2021-01-01", run_id="r1")
    table = run.run_table
    assert table.columns == list(sinks.RUN_COLUMNS)
    steps = {r["step_name"] for r in table.select("step_name").distinct().collect()}
    assert steps == {"dq_validation", "weighted_dimension_score", "weighted_sla_score", "provider_completeness", "provider_dq_dimension"}
    summary = {r["file"]: r for r in run.summary.collect()}
    assert summary["beneficiary"]["overall_status"] == "PASS" and summary["beneficiary"]["quality_score"] == 10.0


def prescriptions(spark, n=20, low_supply=3):
    data = []
    for i in range(n):
        supply = 300.0 if i >= low_supply else 100.0
        data.append(("1234567890", "L", "F", "City", "NY", "36", "T", "NPPES-Taxonomy", f"b{i}", "g", 12, 10.0, supply, 50.0, 11))
    return spark.createDataFrame(data, "Prscrbr_NPI string, Prscrbr_Last_Org_Name string, Prscrbr_First_Name string, Prscrbr_City string, Prscrbr_State_Abrvtn string, Prscrbr_State_FIPS string, Prscrbr_Type string, Prscrbr_Type_Src string, Brnd_Name string, Gnrc_Name string, Tot_Clms long, Tot_30day_Fills double, Tot_Day_Suply double, Tot_Drug_Cst double, Tot_Benes long")


def test_published_sample_score(spark):
    """A warning on 15 % of the rows gives consistency 9.4 and 9.91 overall."""
    tables = P.provider_quality(prescriptions(spark))
    scores = {r["dimension"]: r["score"] for r in tables["provider_dq_dimension"].collect()}
    assert scores["consistency"] == 9.4
    summary = tables["provider_dq_summary"].first()
    assert (summary["quality_score"], summary["quality_status"], summary["warning_count"]) == (9.91, "excellent", 1)


def test_auth_rules_accumulate(spark):
    t = datetime(2020, 1, 10)
    data = [
        ("a1", "b", "1234567890.0", "s", t, t, "Approved", t, "Routine", "x"),
        ("", None, "12", "", None, None, "Approved", None, None, "x"),
        ("a2", "b", "1234567890", "s", t, None, "Pending", None, "", "x"),
        ("a2", "b", "1234567890", "s", t, None, "Denied", None, "Urgent", "x"),
    ]
    df = spark.createDataFrame(data, "authorization_id string, bene_id string, provider_id string, service_code string, request_date timestamp, approval_date timestamp, status string, expiry_date timestamp, urgency string, batch_id string")
    got = A.auth_quality(df, "2020-01-18", run_id="r")
    records = {(r["authorization_id"], r["status"]): r for r in got["records"].collect()}
    assert records["", "Approved"]["quality_score"] == 0.0
    assert records["", "Approved"]["severity"] == "Critical"
    pending = records["a2", "Pending"]["failed_rules"].split("; ")
    assert pending == ["Invalid Urgency", "Duplicate Authorization ID", "Duplicate Authorization Business Record", "Pending Beyond SLA"]
    assert records["a1", "Approved"]["failed_rules"] == "Duplicate Authorization Business Record"
    providers = {r["provider_id"]: r for r in got["providers"].collect()}
    assert providers["1234567890"]["total_authorizations"] == 3
    assert got["dq_run_output"].count() == 2 + 16


def test_annual_scores(spark):
    data = [(2018 + i, v, float(v), v, v) for i, v in enumerate([10, 12, 11, 30, 12, 13])]
    df = spark.createDataFrame(data, "calendar_year int, total_claims long, total_standardized_30_day_fills double, total_beneficiaries long, total_prescribers long")
    got = PV.annual_risk(df).orderBy("calendar_year").collect()
    assert [r["final_volume_risk_score"] for r in got[:3]] == [None] * 3
    # Absent categories have no spread, so the final score stays unknown.
    assert got[3]["volume_risk_score"] == 100.0 and got[3]["final_volume_risk_score"] is None


def test_peer_scores_stay_in_range(spark):
    rows = PV.flagged_prescriptions(prescriptions(spark), spark.createDataFrame([("B1 ", "g", "y", "N", "N", "N", "N")], "drug_name string, generic_name string, opioid_flag string, la_opioid_flag string, antibiotic_flag string, antipsychotic_flag string, ndc_conflict_flag string"))
    drugs = PV.drug_peer_risk(rows)
    low, high, flagged = drugs.agg(F.min("volume_risk_score"), F.max("volume_risk_score"), F.sum("opioid_flag")).first()
    assert 0 <= low <= high <= 100 and flagged == 1
    assert drugs.count() == 20


def test_anomaly_tables_share_keys(spark):
    data = []
    for p in range(6):
        for c in range(4):
            pay = 100.0 + p if p < 5 else 9000.0
            data.append(("dme", f"b{p}{c}", f"c{p}{c}", "1", f"p{p}", datetime(2020, 1, 1), datetime(2020, 1, 3), pay, 200.0, "A01", "H0001"))
    df = spark.createDataFrame(data, "claim_type string, BENE_ID string, CLM_ID string, LINE_NUM string, PRVDR_NPI string, CLM_FROM_DT timestamp, CLM_THRU_DT timestamp, CLM_PMT_AMT double, CLM_TOT_CHRG_AMT double, PRNCPAL_DGNS_CD string, HCPCS_CD string")
    tables = CA.claims_anomalies(CA.standard_lines(df))
    found = {r["provider_id"]: r for r in tables["claims_anomalies"].collect()}
    assert set(found) == {f"p{i}" for i in range(6)}  # a diagnosis without procedure counts
    assert found["p5"]["severity"] == "HIGH" and "Claim payment anomaly: actual=9000.0000" in found["p5"]["anomaly_reason"]
    metrics = tables["claims_individual_metrics"]
    assert metrics.count() == 6 * 15
    linked = metrics.filter("anomaly_id is not null").select("anomaly_id").distinct().count()
    assert linked == 6
    more = CA.claims_anomalies(CA.standard_lines(df), utilization=True)["claims_individual_metrics"]
    assert more.count() == 6 * 16


def test_drug_anomaly_reason(spark):
    rows = prescriptions(spark).withColumn("Tot_Drug_Cst", F.when(F.col("Brnd_Name") == "b7", 5000.0).otherwise(50.0 + F.crc32("Brnd_Name") % 7))
    found = DA.drug_anomaly_rows(DA.with_signals(DA.scored(DA.measured(rows)))).filter("robust_z_score > 100").collect()
    assert len(found) == 1 and found[0]["robust_z_anomaly"] == 1
    assert found[0]["anomaly_reason"].startswith("Total drug cost is unusually HIGH: provider=5000.00, peer median=")


def test_claim_risk_uses_merged_scores(spark):
    volume = spark.createDataFrame([("1", "2020-02", 5, 1.0), ("2", "2020-02", 5, None)], "NPI string, current_period string, current_month_volume int, volume_risk double")
    quality = spark.createDataFrame([("1.0", 50.0, None), ("1", 70.0, 80.0)], "npi string, npi_completeness_score double, npi_dimension_score double")
    anomalies = spark.createDataFrame([("1", "2020-02", -7.0, 0.1), (None, "2020-02", None, 0.25)], "provider_id string, batch_month string, robust_z_score double, psi_score double")
    got = {r["NPI"]: r for r in R.claim_provider_risk(volume, quality, anomalies).collect()}
    assert got["1"]["robust_z_risk"] == 1.0 and got["1"]["psi_risk"] == 0.5
    assert got["1"]["dq_risk"] == pytest.approx(0.3)
    assert got["1"]["final_sla_risk_score"] == pytest.approx(0.25 * 0.3 + 0.2 + 0.2 + 0.15 * 0.5 + 0.04)
    assert got["2"]["robust_z_status"] == "NO_DATA" and got["2"]["dq_risk"] == 0.0
    with pytest.raises(ValueError):
        R.check_weights({"a": 0.5})


def test_global_z_falls_back_to_deviation(spark):
    df = spark.createDataFrame([(1.0, 4.0)] * 4 + [(9.0, 4.0)], "a double, b double")
    got = R.global_robust_z(df, ["a", "b"]).collect()
    assert max(r["a_robust_z"] for r in got) == pytest.approx(8 / 3.2)
    assert all(r["b_robust_z"] == 0.0 for r in got)


def test_sinks_and_readers(spark, tmp_path, rows):
    out = str(tmp_path)
    df = spark.range(25).select(F.col("id").cast("string").alias("CLM_ID"), F.lit("a|b").alias("t"))
    sinks.write_batches(df.coalesce(1), f"{out}/batches", 10)
    assert len(list((tmp_path / "batches").glob("*.csv"))) == 3
    sinks.export_report([df, df.withColumn("more", F.lit(1))], f"{out}/report")
    assert readers.read_text(spark, f"{out}/report", ",").columns == ["CLM_ID", "t", "more"]
    (tmp_path / "raw.csv").write_text("BENE_ID|X\n-007|\n|NA\n")
    assert rows(readers.read_text(spark, f"{out}/raw.csv")) == [("", "NA"), ("-007", "")]
    assert rows(readers.read_text(spark, f"{out}/raw.csv", empty_is_null=True)) == [("-007", None), (None, "NA")]
    assert readers.read_tagged(spark, {"a": f"{out}/raw.csv", "b": f"{out}/raw.csv"}).count() == 4
    row = sinks.step_row(spark, "r1", "load", "SUCCESS", datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 1))
    sinks.append_run(row, f"{out}/runs")
    with pytest.raises(RuntimeError):
        sinks.audited(spark, "r2", "boom", lambda: (_ for _ in ()).throw(RuntimeError("x")), f"{out}/runs")
    log = spark.read.parquet(f"{out}/runs")
    assert rows(log, "run_id", "status") == [("r1", "SUCCESS"), ("r2", "FAILED")]
    merged = sinks.merge_runs(df.withColumn("old", F.lit(1)), df.withColumn("new", F.lit(2)), ("old",))
    assert merged.columns == ["CLM_ID", "t", "new"]


def test_evidence_limit(spark, tmp_path):
    df = spark.range(60).select(F.lit("f").alias("file"), F.lit("d").alias("dimension"), F.when(F.col("id") < 50, "big").otherwise("small").alias("rule"), F.col("id").alias("k"))
    got = sinks.sample_evidence(df, ["file", "dimension", "rule"], ["k"], limit=7).collect()
    assert sorted(r["k"] for r in got if r["rule"] == "big") == list(range(7))
    assert len(got) == 14
    sinks.write_evidence(df, df.groupBy("rule").count(), str(tmp_path / "e"), ["k"], limit=7)
    assert spark.read.json(str(tmp_path / "e" / "summary")).count() == 2


def test_evidence_is_cut_before_the_shuffle(spark, tmp_path):
    spark.range(4000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("rule"), F.col("id").alias("k")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    sampled = sinks.sample_evidence(rows, ["rule"], ["k"], limit=1500)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one of them below the exchange
    assert sampled.groupBy("rule").count().collect().__len__() == 2
    assert {r["rule"]: r["count"] for r in sampled.groupBy("rule").count().collect()} == {"big": 1500, "small": 400}


def test_result_store(spark, tmp_path, rows):
    results = store.ResultStore(spark, str(tmp_path / "store"))
    assert results.latest_run("t") is None
    with pytest.raises(LookupError):
        results.latest("t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = results.run("kind", {"t": lambda read: df, "u": lambda read: read("t").filter("k = 1")}, datetime(2024, 1, 1))
    assert rows(results.latest("u"), "k", "v") == [(1, "a")]

    def broken(read):
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError):
        results.run("kind", {"t": lambda read: df.limit(1), "u": broken}, datetime(2024, 1, 2))
    assert results.latest_run("t") == first and results.latest("t").count() == 2
    second = results.run("kind", {"t": lambda read: df.withColumn("w", F.lit(3)).drop("v")}, datetime(2024, 1, 3), version=2)
    assert results.latest("t").columns == ["k", "w"] and results.latest_run("u") == first
    results.run("kind", {"t": lambda read: df.limit(1).withColumn("w", F.lit(4)).drop("v")}, datetime(2024, 1, 3), version=2)
    assert results.latest_run("t") == second and results.latest("t").count() == 1  # the repeated run replaced its part
    merged = results.history("t", renamed={"v": "name"}, obsolete=["gone"])
    assert sorted(map(str, rows(merged, "k", "w", "name"))) == ["(1, 4, None)", "(1, None, 'a')", "(2, None, 'b')"]
    audit = spark.read.parquet(results.path("_audit"))
    assert audit.filter("status = 'FAILED'").count() == 1
    assert store.run_id("kind", datetime(2024, 1, 1), ["b", "a"]) == store.run_id("kind", datetime(2024, 1, 1), ["a", "b"])


def test_pages_go_on_behind_the_last_row(spark):
    data = [(k, None if k % 7 == 0 else float(k % 5), f"n{k % 3}") for k in range(60)]
    df = spark.createDataFrame(data, "k int, score double, name string")
    for order in ([("score", True), ("k", False)], [("score", False), ("name", True), ("k", True)]):
        whole = reports.page_after(df, order, None, 1000).collect()
        seen, last = [], None
        while part := reports.page_after(df, order, last, 7).collect():
            seen += part
            last = [part[-1][c] for c, _ in order]
        assert seen == whole and len(seen) == 60


def test_delimited_files(spark, tmp_path, rows):
    for name, text in (("a", "x|y\n1|2\n|\n3\n"), ("b", "x|y\n4|5|6\n7|8\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    good, bad = readers.read_delimited(spark, {n: str(tmp_path / f"{n}.csv") for n in "ab"}, ["x", "y"])
    assert rows(good) == [("a", "", ""), ("a", "1", "2"), ("b", "7", "8")]
    assert rows(bad) == [("a", "3"), ("b", "4|5|6")]


LINE_SCHEMA = (
    "claim_type string, claim string, line string, provider string, month string, bene string, payment double, charge double, allowed double, "
    "units double, utilization_days double, visits double, los_days int, specialty string, state string, mismatch int, bad_icd int, bad_hcpcs int, bad_dates int"
)


def odd_lines(spark):
    """Repeated, tied and null claims, lines, providers, persons and amounts."""
    data = []
    for i in range(600):
        kind = ("dme", "hha", "inpatient")[i % 3]
        claim = None if i % 37 == 0 else f"c{i // 5 % 60}"
        line = None if i % 41 == 0 else str(i % 4)
        provider = None if i % 29 == 0 else f"p{i // 7 % 4}"
        bene = None if i % 31 == 0 else f"b{i // 11 % 9}"
        amount = None if i % 17 == 0 else float(i % 13)
        data.append((kind, claim, line, provider, f"2020-0{i // 50 % 3 + 1}", bene, amount, float(i % 5), amount, float(i % 3), float(i % 7), float(i % 6),
                     i % 8, f"S{i % 2}", None if i % 3 else "01", i % 2, i % 3 % 2, i % 5 % 2, i % 7 % 2))
    return spark.createDataFrame(data + data[:90], LINE_SCHEMA)


def test_provider_months_equal_those_of_claims_and_lines_apart(spark):
    lines = odd_lines(spark)
    apart = CA.claim_behavior(CA.claim_level(lines)).join(CA.line_behavior(lines), CA.PROVIDER_MONTH, "left")
    together = CA.provider_months(lines)
    assert set(together.columns) == set(apart.columns)

    def plain(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(apart.columns)).collect()), key=repr)

    assert plain(together) == plain(apart) and together.count() > 20


def test_provider_months_shuffle_lines_by_claim_once_to_their_months(spark):
    lines = odd_lines(spark).repartition(4, "claim")
    plan = CA.provider_months(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the one by claim asked for here, and one by provider month


def test_robust_z_and_drift_join_rows_without_shuffling_them(spark):
    month = F.format_string("2020-%02d", F.col("id") % 12 + 1)
    rows = spark.range(5000).select(
        F.lit("dme").alias("claim_type"), month.alias("month"), (F.col("id") * 7 % 101).cast("double").alias("x"), F.repeat(F.lit("w"), 40).alias("wide")
    )
    scored = CA.robust_z(rows, ["claim_type", "month"], ["x"])
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_drug_scores_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def kind(i):
        made.add(1)
        return f"Specialty{i % 3}"

    told = F.udf(kind, "string").asNondeterministic()
    rows = spark.range(0, 300, 1, 3).select(
        F.format_string("p%d", F.col("id") % 40).alias("Prscrbr_NPI"), told("id").alias("Prscrbr_Type"), F.format_string("S%d", F.col("id") % 5).alias("Prscrbr_State_Abrvtn"),
        F.format_string("g%d", F.col("id") % 4).alias("Gnrc_Name"), *[(F.col("id") * 7 % 101).cast("double").alias(f) for f in DA.FEATURES],
    )
    assert DA.scored(rows).count() == 300
    assert made.value == 300


def test_rule_masks_are_compiled(spark, rows):
    rules = [Rule("d", f"r{i}", "quarantine", F.col("id") % (i + 2) == 0) for i in range(65)]
    found = failing_records(spark.range(200), rules, ["id"])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(n, sum((n % (i + 2) == 0) << i for i in range(60)), sum((n % (i + 62) == 0) << i for i in range(5))) for n in range(200)]
    assert rows(found) == sorted((w for w in want if w[1] or w[2]), key=repr)


def test_claims_signals_are_counted_as_listed(spark):
    lines = odd_lines(spark)
    scored = CA.peer_scores(CA.provider_months(lines))
    scored = scored.withColumns(
        {"avg_los_z": F.when(F.crc32("provider") % 2 == 0, 9.0), "specialty_behavior_z": F.lit(-4.0), "claims_per_beneficiary_z": F.lit(5.0)}
    ).withColumn("claim_type", F.when(F.col("month") != "2020-02", F.col("claim_type")))
    drift = spark.createDataFrame(
        [("dme", "2020-01", CA.DIAGNOSIS_DRIFT, 0.5, "2019-12"), ("hha", "2020-01", "Specialty distribution drift", 0.3, "2019-12")],
        "claim_type string, month string, field string, psi_score double, baseline_periods string",
    )
    found = CA.signals(scored, drift).select("signal_count", *[F.size(f"{k}_items").alias(k) for k in ("robust", "rule", "psi")]).collect()
    assert all(r["signal_count"] == r["robust"] + r["rule"] + r["psi"] for r in found)
    assert {r["signal_count"] for r in found} > {1, 4} and any(r["psi"] for r in found)


def test_provider_months_add_up_lines_without_sorting_them_for_texts(spark):
    lines = odd_lines(spark).repartition(4, "claim")
    plan = CA.provider_months(lines)._jdf.queryExecution().executedPlan().toString()
    # by specialty and state lines are hashed; only their few sums are sorted for the least texts
    assert plan.count("SortAggregate(") == 2 and plan.count("HashAggregate(") == 2


def test_provider_completeness_reads_its_claims_once(spark, rows):
    df = Q.prepare(spark.createDataFrame(
        [(None if i % 7 == 0 else f"b{i % 5}", f"c{i % 11}", str(i % 2), "" if i % 13 == 0 else f"1{i % 3:09d}", "" if i % 9 == 0 else "2020-01-01") for i in range(200)],
        "BENE_ID string, CLM_ID string, LINE_NUM string, PRF_PHYSN_NPI string, CLM_FROM_DT string",
    ))
    found = Q.provider_completeness(df, "PRF_PHYSN_NPI", "carrier")
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    want = {}
    for r in df.collect():
        if r["PRF_PHYSN_NPI"]:
            want.setdefault(r["PRF_PHYSN_NPI"], []).append(r)
    for npi, of in want.items():
        for field in ("BENE_ID", "CLM_FROM_DT", "CLM_ID"):
            missing = {(r["BENE_ID"], r["CLM_ID"], r["LINE_NUM"]) for r in of if not r[field]}
            got = found.filter((F.col("npi") == npi) & (F.col("field_name") == field)).first()
            assert (got["npi_affected_rows"], got["npi_total_rows"]) == (len(missing), len(of))


def test_drug_texts_are_made_of_rows_with_signals_only(spark, monkeypatch):
    rows = prescriptions(spark).withColumn("Tot_Drug_Cst", F.when(F.col("Brnd_Name") == "b7", 5000.0).otherwise(50.0 + F.crc32("Brnd_Name") % 7))
    marked, settled = DA.with_signals(DA.scored(DA.measured(rows))), []
    monkeypatch.setattr(DA, "settle", lambda df, to=DA.settle: settled.append(to(df)) or settled[-1])
    found = DA.drug_anomaly_rows(marked)
    assert "reason" not in marked.columns and settled[0].count() == found.count() < rows.count()
