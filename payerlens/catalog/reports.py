"""Report queries over the stored results of the latest runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from payerlens.catalog import pharmacy as PH
from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, view
from payerlens.catalog.results import stored
from payerlens.catalog.sla import rounded
from payerlens.functions.bands import GAUGE
from payerlens.plans import pharmacy_volume as PV
from payerlens.plans import reports as R
from payerlens.plans import sla
from payerlens.plans import volume as V

view(
    "rp_claim",
    """
    SELECT claim_type, provider_id, batch_month, round_even(robust_z_score, 6) AS robust_z_score, round_even(psi_score, 6) AS psi_score, anomaly_count, severity
    FROM claims_anomalies
    """,
)
view(
    "rp_drug",
    """
    SELECT provider_id, drug, round_even(robust_z_score, 6) AS robust_z_score, round_even(psi_score, 6) AS psi_score, anomaly_count, severity FROM drug_anomalies
    """,
)
view(
    "rp_all",
    """
    SELECT 'DRUG' AS anomaly_type, drug AS subject, NULL AS month, provider_id, robust_z_score, psi_score, anomaly_count, severity FROM rp_drug
    UNION ALL SELECT 'CLAIM', claim_type, batch_month, provider_id, robust_z_score, psi_score, anomaly_count, severity FROM rp_claim
    """,
)
view(
    "rp_risk",
    """
    SELECT NPI, current_period, volume_risk, dq_risk, robust_z_risk, psi_risk, 0.2::DOUBLE AS arrival_delay_risk, round_even(final_sla_risk_score, 4) AS score, final_risk_level AS risk_level FROM provider_sla_risk
    """,
)
view(
    "rp_pharmacy_risk",
    """
    SELECT npi, round_even(dq_risk, 6) AS dq_risk, round_even(volume_risk, 6) AS volume_risk, round_even(z_risk, 6) AS robust_z_risk, round_even(psi_risk, 6) AS psi_risk, 0.2::DOUBLE AS arrival_delay_risk,
           round_even(final_score, 4) AS score, Risk_Level AS risk_level FROM provider_risk
    """,
)
GAUGE_SQL = "CASE WHEN {s} < 0.1 THEN 'Excellent' WHEN {s} < 0.25 THEN 'Very Good' WHEN {s} < 0.5 THEN 'Good' WHEN {s} < 0.75 THEN 'Fair' ELSE 'Poor' END"


def claim(spark, sf):
    found = stored(spark, sf, "claims_anomalies").select(
        "claim_type", "provider_id", "batch_month", "robust_z_score", "psi_score", "anomaly_count", "severity"
    )
    return rounded(found, "robust_z_score", "psi_score")


def drug(spark, sf):
    found = stored(spark, sf, "drug_anomalies").select(
        "provider_id", "drug", "robust_z_score", "psi_score", "anomaly_count", "severity"
    )
    return rounded(found, "robust_z_score", "psi_score")


def everything(spark, sf):
    return R.all_anomalies(drug(spark, sf), claim(spark, sf))


def volume(spark, sf):
    return stored(spark, sf, "provider_volume_risk")


PARTS = ("volume_risk", "dq_risk", "robust_z_risk", "psi_risk", "arrival_delay_risk")


def risk(spark, sf):
    rows = stored(spark, sf, "claim_provider_risk").select(
        "NPI", "current_period", *PARTS, F.bround("final_sla_risk_score", 4).alias("score"), F.col("final_risk_level").alias("risk_level")
    )
    return rows


def pharmacy_risk(spark, sf):
    return stored(spark, sf, "pharmacy_provider_risk").select(
        "npi", F.col("DQ_Risk").alias("dq_risk"), F.col("Volume_Risk").alias("volume_risk"), F.col("RobustZ_Risk").alias("robust_z_risk"),
        F.col("PSI_Risk").alias("psi_risk"), F.col("ArrivalDelay_Risk").alias("arrival_delay_risk"),
        F.bround("Final_Risk_Score", 4).alias("score"), F.col("Risk_Level").alias("risk_level"),
    )


def auth(spark, sf):
    return stored(spark, sf, "auth_requests")


def drugs(spark, sf):
    return stored(spark, sf, "drug_peer_risk")


def claims_history(spark, sf):
    return stored(spark, sf, "rolling_history")


@query("rp01_claims_dashboard", """
    WITH a AS (SELECT 1 AS is_drug, provider_id, severity, psi_anomaly, robust_z_anomaly FROM drug_anomalies UNION ALL SELECT 0, provider_id, severity, psi_anomaly, robust_z_anomaly FROM claims_anomalies),
    t AS (SELECT (SELECT count(*) FROM valid_claims) AS total_records, (SELECT count(DISTINCT NPI) FROM provider_volume_risk) AS total_providers,
      (SELECT count(*) FROM provider_volume_risk WHERE risk_level IN ('HIGH', 'CRITICAL')) AS volume_alerts, (SELECT CAST(sum(records_processed) AS BIGINT) FROM claim_runs) AS processed_claims,
      (SELECT count(*) FROM claim_runs WHERE sla_status = 'BREACHED') AS sla_breaches, (SELECT round(100.0::DOUBLE * count(*) FILTER (sla_status = 'MET') / count(*) FILTER (sla_status IN ('MET', 'MINOR_OVERRUN', 'BREACHED')), 2) FROM claim_runs) AS sla_compliance,
      (SELECT count(*) FROM provider_dq_rows WHERE score < 100) AS dq_alerts)
    SELECT 'claims' AS module, t.*, sla_breaches AS sla_alerts, dq_alerts + volume_alerts + sla_breaches AS active_alerts,
      (SELECT count(*) FROM a WHERE is_drug = 1) AS drug_anomalies, (SELECT count(*) FROM a WHERE is_drug = 0) AS claim_anomalies, (SELECT count(*) FROM a) AS total_anomalies,
      (SELECT count(*) FROM a WHERE severity = 'HIGH') AS high_risk, (SELECT count(DISTINCT provider_id) FROM a) AS affected_providers,
      (SELECT count(*) FROM a WHERE psi_anomaly = 1) AS psi_anomalies, (SELECT count(*) FROM a WHERE robust_z_anomaly = 1) AS robust_z_anomalies FROM t""")
def _(spark, sf):
    names = ("valid_claims", "provider_volume_risk", "claim_runs", "claim_quality", "drug_anomalies", "claims_anomalies")
    return R.claims_dashboard(*(stored(spark, sf, n) for n in names))


@query("rp01_drugs_dashboard", f"""
    WITH d AS (SELECT *, {PH.LEVEL.format(s='round_even(volume_risk_score, 9)')} AS lvl FROM drug_peer)
    SELECT 'drugs' AS module, count(*) AS total_records, count(DISTINCT Brnd_Name) FILTER (trim(Brnd_Name) <> '') AS processed_claims, count(*) FILTER (upper(lvl) IN ('HIGH', 'CRITICAL')) AS sla_breaches,
      count(*) FILTER (upper(lvl) IN ('HIGH', 'CRITICAL') OR opioid_flag + la_opioid_flag + antibiotic_flag + antipsychotic_flag + ndc_conflict_flag > 0) AS active_alerts,
      (SELECT count(DISTINCT Prscrbr_NPI) FROM npi_peer WHERE trim(Prscrbr_NPI) <> '') AS total_providers, count(*) FILTER (upper(lvl) IN ('HIGH', 'CRITICAL')) AS total_anomalies,
      (SELECT count(DISTINCT Prscrbr_NPI) FROM npi_peer WHERE trim(Prscrbr_NPI) <> '') AS affected_providers FROM d""")
def _(spark, sf):
    return R.drugs_dashboard(drugs(spark, sf), stored(spark, sf, "provider_peer_risk"))


@query("rp01_authorization_dashboard", """
    WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY NPI ORDER BY current_period DESC) AS rn FROM auth_volume_risk WHERE trim(coalesce(NPI, '')) <> '') WHERE rn = 1),
    t AS (SELECT count(*) AS total_records, count(*) FILTER (sla_status IN ('MINOR_BREACH', 'BREACHED')) AS sla_breaches,
      round(100.0::DOUBLE * count(*) FILTER (sla_status = 'MET') / count(*) FILTER (sla_status IN ('MET', 'MINOR_BREACH', 'BREACHED')), 2) AS sla_compliance FROM auth_requests),
    q AS (SELECT CAST(coalesce(sum(failed) FILTER (rank_of >= 3), 0) AS BIGINT) AS dq_alerts FROM auth_rule_counts)
    SELECT 'authorization' AS module, t.*, (SELECT count(*) FROM v) AS total_providers, (SELECT count(*) FROM v WHERE risk_level IN ('HIGH', 'CRITICAL')) AS volume_alerts, dq_alerts,
      sla_breaches AS sla_alerts, dq_alerts AS active_alerts, dq_alerts + (SELECT count(*) FROM v WHERE risk_level IN ('HIGH', 'CRITICAL')) AS total_anomalies FROM t, q""")
def _(spark, sf):
    return R.authorization_dashboard(stored(spark, sf, "auth_volume_risk"), stored(spark, sf, "auth_rules"), auth(spark, sf))


@query("rp01_ag31_claim_kpis", """
    SELECT count(*) AS providers, CAST(sum(total_claim_volume) AS BIGINT) AS claims, round_even(avg(volume_risk), 6) AS average_risk,
           count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS elevated_providers, (SELECT count(*) FROM rp_claim) AS anomalies,
           (SELECT count(*) FROM rp_claim WHERE severity = 'HIGH') AS high_anomalies, (SELECT count(DISTINCT provider_id) FROM rp_claim) AS anomalous_providers FROM provider_volume_risk""")
def _(spark, sf):
    return rounded(R.claim_kpis(volume(spark, sf), claim(spark, sf)), "average_risk")


@query("ag32_distinct_providers", "SELECT count(DISTINCT provider_id) AS providers FROM (SELECT provider_id FROM rp_drug UNION SELECT provider_id FROM rp_claim)")
def _(spark, sf):
    return R.distinct_providers(drug(spark, sf), claim(spark, sf))


@query("rp02_drug_summary", """
    SELECT count(*) AS drugs, count(DISTINCT Gnrc_Name) AS generics, count(*) FILTER (round_even(volume_risk_score, 9) >= 50) AS elevated_drugs, round_even(sum(total_claims), 4) AS total_claims,
           count(*) FILTER (opioid_flag + la_opioid_flag + antibiotic_flag + antipsychotic_flag + ndc_conflict_flag > 0) AS flagged_drugs FROM drug_peer""")
def _(spark, sf):
    return rounded(R.drug_summary(drugs(spark, sf)), "total_claims", digits=4)


@query("rp03_drug_level_distribution", f"SELECT {PH.LEVEL.format(s='round_even(volume_risk_score, 9)')} AS volume_risk_level, count(*) AS count FROM drug_peer GROUP BY 1")
def _(spark, sf):
    return R.frequency(drugs(spark, sf), "volume_risk_level")


@query("rp04_tk01_top_drugs", "SELECT Brnd_Name, Gnrc_Name, round_even(total_claims, 4) AS total_claims FROM drug_peer ORDER BY drug_peer.total_claims DESC, Brnd_Name, Gnrc_Name LIMIT 10")
def _(spark, sf):
    best = R.top(PV.drug_rollup(stored(spark, sf, "prescriptions")), "total_claims", 10, "Brnd_Name", "Gnrc_Name")
    return rounded(best.select("Brnd_Name", "Gnrc_Name", "total_claims"), "total_claims", digits=4)


@query("rp04_top_risk_drugs", f"""
    SELECT Brnd_Name, Gnrc_Name, round_even(volume_risk_score, 6) AS volume_risk_score, {PH.LEVEL.format(s='round_even(volume_risk_score, 9)')} AS volume_risk_level
    FROM drug_peer WHERE volume_risk_score IS NOT NULL ORDER BY round_even(drug_peer.volume_risk_score, 6) DESC, Brnd_Name, Gnrc_Name LIMIT 5""")
def _(spark, sf):
    rows = rounded(drugs(spark, sf), "volume_risk_score").filter("volume_risk_score is not null")
    best = R.top(rows, "volume_risk_score", 5, "Brnd_Name", "Gnrc_Name")
    return best.select("Brnd_Name", "Gnrc_Name", "volume_risk_score", "volume_risk_level")


@query("rp04_drug_utilization", """
    SELECT Brnd_Name, Gnrc_Name, round_even(total_claims, 4) AS total_claims, round_even(total_fills, 4) AS total_fills, round_even(total_day_supply, 4) AS total_day_supply
    FROM drug_peer WHERE total_claims IS NOT NULL ORDER BY drug_peer.total_claims DESC, Brnd_Name, Gnrc_Name LIMIT 10""")
def _(spark, sf):
    best = R.top(drugs(spark, sf).filter("total_claims is not null"), "total_claims", 10, "Brnd_Name", "Gnrc_Name")
    picked = best.select("Brnd_Name", "Gnrc_Name", "total_claims", "total_fills", "total_day_supply")
    return rounded(picked, "total_claims", "total_fills", "total_day_supply", digits=4)


@query("rp05_risk_vs_beneficiaries", f"""
    SELECT Brnd_Name, Gnrc_Name, round_even(total_beneficiaries, 4) AS total_beneficiaries, round_even(volume_risk_score, 6) AS volume_risk_score,
           round_even(total_claims, 4) AS total_claims, {PH.LEVEL.format(s='round_even(volume_risk_score, 9)')} AS volume_risk_level
    FROM drug_peer WHERE total_beneficiaries IS NOT NULL AND volume_risk_score IS NOT NULL""")
def _(spark, sf):
    rows = R.risk_points(drugs(spark, sf), "total_beneficiaries", "volume_risk_score")
    picked = rows.select("Brnd_Name", "Gnrc_Name", "total_beneficiaries", "volume_risk_score", "total_claims", "volume_risk_level")
    return rounded(rounded(picked, "volume_risk_score"), "total_beneficiaries", "total_claims", digits=4)


@query("rp05_annual_trend", """
    SELECT calendar_year, total_claims, round_even(final_volume_risk_score, 6) AS final_volume_risk_score FROM annual_risk ORDER BY calendar_year DESC LIMIT 5""")
def _(spark, sf):
    rows = R.latest(PV.annual_risk(S.grand_totals(spark, sf)), "calendar_year", 5)
    return rounded(rows.select("calendar_year", F.col("total_claims").cast("bigint").alias("total_claims"), "final_volume_risk_score"), "final_volume_risk_score")


def second_page(rows, order, size):
    last = R.page_after(rows, order, None, size).tail(1)
    return R.page_after(rows, order, [last[0][c] for c, _ in order] if last else None, size)


@query("rp06_tk04_drug_volume_page", f"""
    SELECT Brnd_Name, Gnrc_Name, round_even(total_claims, 4) AS total_claims, {PH.LEVEL.format(s='round_even(volume_risk_score, 9)')} AS volume_risk_level
    FROM drug_peer ORDER BY drug_peer.total_claims DESC NULLS LAST, Brnd_Name, Gnrc_Name LIMIT 25 OFFSET 25""")
def _(spark, sf):
    rows = drugs(spark, sf).select("Brnd_Name", "Gnrc_Name", "total_claims", "volume_risk_level")
    return rounded(second_page(rows, [("total_claims", True), ("Brnd_Name", False), ("Gnrc_Name", False)], 25), "total_claims", digits=4)


@query("rp06_tk04_provider_volume_page", """
    SELECT Prscrbr_NPI, Prscrbr_Type, round_even(total_claims, 4) AS total_claims FROM npi_peer WHERE Prscrbr_Type ILIKE '%a%'
    ORDER BY npi_peer.total_claims DESC NULLS LAST, Prscrbr_NPI, Prscrbr_Type LIMIT 25 OFFSET 25""")
def _(spark, sf):
    rows = R.search(stored(spark, sf, "provider_peer_risk"), "A", ["Prscrbr_Type"]).select("Prscrbr_NPI", "Prscrbr_Type", "total_claims")
    return rounded(second_page(rows, [("total_claims", True), ("Prscrbr_NPI", False), ("Prscrbr_Type", False)], 25), "total_claims", digits=4)


@query("rp06_tk04_fl04_drug_listing_page", """
    SELECT provider_id, drug, robust_z_score, severity FROM rp_drug WHERE drug ILIKE '%econ%' AND severity IN ('LOW', 'MEDIUM') ORDER BY robust_z_score DESC, provider_id, drug LIMIT 25 OFFSET 25""")
def _(spark, sf):
    rows = R.with_level(R.search(drug(spark, sf), "ECON", ["drug", "provider_id"]), "severity", ["Low", "Medium"])
    shown = R.page(rows, "robust_z_score", ["robust_z_score", "severity"], ["provider_id", "drug"], number=2)
    return shown.select("provider_id", "drug", "robust_z_score", "severity")


@query("tk04_listing_totals", """
    SELECT count(*) AS total, count(DISTINCT provider_id) AS providers, count(*) FILTER (severity = 'HIGH') AS high FROM rp_drug WHERE drug ILIKE '%econ%'""")
def _(spark, sf):
    rows = R.search(drug(spark, sf), "econ", ["drug"])
    return R.listing_totals(rows, providers=F.countDistinct("provider_id"), high=R.count_if(R.level("severity") == "HIGH"))


@query("rp07_ag33_severity_counts", "SELECT severity, count(*) AS count FROM rp_all GROUP BY 1")
def _(spark, sf):
    return R.severity_counts(everything(spark, sf))


@query("rp08_st02_type_counts", "SELECT anomaly_type, count(*) AS count FROM rp_all GROUP BY 1")
def _(spark, sf):
    return R.type_counts(everything(spark, sf))


@query("rp09_busiest_providers", """
    SELECT provider_id, count(*) AS anomalies, count(*) FILTER (severity = 'HIGH') AS high FROM rp_all WHERE provider_id IS NOT NULL GROUP BY 1 ORDER BY anomalies DESC, provider_id LIMIT 10""")
def _(spark, sf):
    return R.busiest_providers(everything(spark, sf), 10)


@query("rp10_claim_type_month_counts", "SELECT claim_type, batch_month, count(*) AS count FROM rp_claim GROUP BY 1, 2")
def _(spark, sf):
    return claim(spark, sf).groupBy("claim_type", "batch_month").agg(F.count(F.lit(1)).alias("count"))


@query("rp10_top_anomaly_drugs", "SELECT drug, count(*) AS count FROM rp_drug GROUP BY 1 ORDER BY count DESC, drug LIMIT 10")
def _(spark, sf):
    return R.top(R.frequency(drug(spark, sf), "drug"), "count", 10, "drug")


@query("rp11_score_points", """
    SELECT anomaly_type, provider_id, robust_z_score, psi_score FROM rp_all WHERE robust_z_score IS NOT NULL AND psi_score IS NOT NULL
    ORDER BY robust_z_score DESC, anomaly_type, provider_id, subject, month NULLS FIRST""")
def _(spark, sf):
    return R.score_points(everything(spark, sf)).select("anomaly_type", "provider_id", "robust_z_score", "psi_score")


@query("rp12_operational_signals", """
    SELECT 'claims' AS domain, run_id, sla_status FROM (SELECT c.run_id, c.sla_status FROM claim_runs c JOIN run_log l ON l.run_id = c.run_id AND l.step_name = c.step_name ORDER BY l.started_at DESC LIMIT 1)
    UNION ALL SELECT 'pharmacy', run_id, sla_status FROM (SELECT c.run_id, c.sla_status FROM pharmacy_runs c JOIN run_log l ON l.run_id = c.run_id AND l.step_name = c.step_name ORDER BY l.started_at DESC LIMIT 1)""")
def _(spark, sf):
    log = S.run_log(spark, sf)
    rows = R.latest_signals({"claims": sla.claim_runs(log), "pharmacy": sla.pharmacy_runs(log)})
    return rows.select("domain", "run_id", "sla_status")


@query("rp13_tk03_volume_top", """
    SELECT NPI, volume_risk, deviation_pct, risk_level FROM provider_volume_risk ORDER BY volume_risk DESC NULLS LAST, deviation_pct DESC NULLS LAST, NPI LIMIT 20""")
def _(spark, sf):
    return V.by_risk(volume(spark, sf)).limit(20).select("NPI", "volume_risk", "deviation_pct", "risk_level")


@query("rp14_quality_overview", """
    SELECT count(*) AS providers, round_even(avg(s), 6) AS average_score, round_even(min(s), 3) AS lowest_score,
           CAST(coalesce(sum(c.critical + c.high + c.warning), 0) AS BIGINT) AS violations, CAST(coalesce(sum(c.critical), 0) AS BIGINT) AS critical
    FROM (SELECT npi, round_even(quality_score, 3) AS s FROM clean_dq) q
    LEFT JOIN (SELECT npi, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'warning') AS warning FROM drug_findings_once GROUP BY 1) c USING (npi)""")
def _(spark, sf):
    rows = rounded(stored(spark, sf, "pharmacy_quality"), "quality_score", digits=3)
    return rounded(R.quality_overview(rows), "average_score", "lowest_score")


@query("rp15_root_causes", """
    SELECT root_cause, count(*) AS occurrences FROM (SELECT root_cause FROM claim_runs UNION ALL SELECT root_cause FROM pharmacy_runs UNION ALL SELECT root_cause FROM auth_requests) WHERE trim(coalesce(root_cause, '')) <> '' GROUP BY 1 ORDER BY occurrences DESC, root_cause LIMIT 10""")
def _(spark, sf):
    log = S.run_log(spark, sf)
    return R.root_causes([sla.claim_runs(log), sla.pharmacy_runs(log), auth(spark, sf)], 10)


@query("rp16_alert_center", """
    SELECT * FROM (SELECT anomaly_type, subject, provider_id, robust_z_score, anomaly_count FROM rp_all WHERE anomaly_type = 'DRUG' AND severity = 'HIGH' ORDER BY anomaly_count DESC, robust_z_score DESC, provider_id, subject LIMIT 10)
    UNION ALL SELECT * FROM (SELECT anomaly_type, subject, provider_id, robust_z_score, anomaly_count FROM rp_all WHERE anomaly_type = 'CLAIM' AND severity = 'HIGH' ORDER BY anomaly_count DESC, robust_z_score DESC, provider_id, subject, month LIMIT 10)""")
def _(spark, sf):
    return R.alerts(drug(spark, sf), claim(spark, sf), 10).select("anomaly_type", "subject", "provider_id", "robust_z_score", "anomaly_count")


@query("rp17_jn18_provider_profile", """
    SELECT NPI, 'volume' AS section, current_period AS period, risk_level AS label, volume_risk AS value FROM provider_volume_risk
    UNION ALL SELECT NPI, 'history', period, risk_level, CAST(monthly_volume AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY NPI ORDER BY period DESC) AS rn FROM rolling_history) WHERE rn <= 12
    UNION ALL SELECT provider_id, 'claim_anomaly', batch_month, severity, robust_z_score FROM rp_claim
    UNION ALL SELECT provider_id, 'drug_anomaly', NULL, drug, robust_z_score FROM rp_drug
    UNION ALL SELECT npi, 'quality', NULL, field, score FROM provider_dq_fields""")
def _(spark, sf):
    return R.provider_profile(
        volume(spark, sf), claims_history(spark, sf), claim(spark, sf), drug(spark, sf), stored(spark, sf, "claim_quality"), 12
    )


@query("rp18_tk06_risk_distribution", """
    SELECT risk_level, count(*) AS count, CAST(CASE risk_level WHEN 'LOW' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 WHEN 'CRITICAL' THEN 5 ELSE 7 END AS BIGINT) AS position FROM provider_volume_risk GROUP BY 1""")
def _(spark, sf):
    return R.ordered_levels(R.frequency(volume(spark, sf), "risk_level"), "risk_level")


@query("rp19_jn12_tk02_volume_trend", """
    SELECT m.period, CAST(sum(m.monthly_volume) AS BIGINT) AS claims, round_even(avg(h.baseline_volume), 6) AS average_baseline FROM monthly_volume m LEFT JOIN rolling_history h ON h.NPI = m.NPI AND h.period = m.period GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(spark, sf):
    monthly = V.monthly_volume(stored(spark, sf, "valid_claims"))
    return rounded(R.volume_trend(monthly, claims_history(spark, sf), 12), "average_baseline")


@query("rp20_auth_funnel", """
    SELECT count(*) AS submitted, count(approval_date) AS decided, count(*) FILTER (status = 'Approved') AS approved, count(*) FILTER (status = 'Denied') AS denied,
           count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (sla_status = 'MET') AS within_sla, count(*) FILTER (sla_status IN ('MINOR_BREACH', 'BREACHED')) AS late FROM auth_requests""")
def _(spark, sf):
    return R.auth_funnel(auth(spark, sf))


@query("rp21_jn14_wn13_breach_by_provider", """
    SELECT r.NPI, r.requests, r.late_requests, round(100.0::DOUBLE * r.late_requests / r.requests, 2) AS breach_rate, v.current_period, v.current_month_volume, v.risk_level
    FROM (SELECT regexp_replace(trim(provider_id), '\\.0$', '') AS NPI, count(*) AS requests, count(*) FILTER (sla_status IN ('MINOR_BREACH', 'BREACHED')) AS late_requests FROM auth_requests GROUP BY 1) r
    JOIN (SELECT *, row_number() OVER (PARTITION BY NPI ORDER BY current_period DESC) AS rn FROM auth_volume_risk) v ON v.NPI = r.NPI AND v.rn = 1 ORDER BY breach_rate DESC, r.NPI LIMIT 10""")
def _(spark, sf):
    monthly = stored(spark, sf, "auth_volume_risk")
    return R.breach_by_provider(auth(spark, sf), monthly, 10)


@query("rp22_fn19_sla_trend", """
    SELECT strftime(request_date, '%Y-%m') AS month, round_even(avg(turnaround_hours), 6) AS average_hours, round_even(max(turnaround_hours), 6) AS longest_hours,
           round_even(100.0::DOUBLE * count(*) FILTER (sla_status IN ('MINOR_BREACH', 'BREACHED')) / count(*), 6) AS late_pct, 72.0::DOUBLE AS limit_hours
    FROM auth_requests WHERE request_date IS NOT NULL AND turnaround_hours >= 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(spark, sf):
    return rounded(R.sla_trend(auth(spark, sf), 12), "average_hours", "longest_hours", "late_pct")


@query("rp23_issue_distribution", """
    SELECT count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level IN ('MEDIUM', 'MODERATE')) AS medium, count(*) FILTER (risk_level = 'LOW') AS low FROM provider_volume_risk""")
def _(spark, sf):
    return R.issue_distribution(volume(spark, sf), "risk_level")


AXES = {
    "Data Quality": "dq_risk", "Volume": "volume_risk", "Robust Z": "robust_z_risk", "PSI": "psi_risk", "Arrival Delay": "arrival_delay_risk",
}


@query("rp24_rs03_risk_radar", "WITH a AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in AXES.values()) + ", avg(" + " + ".join(AXES.values()) + ") AS total FROM rp_risk)\n" + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round_even({c}, 6) AS value, round_even(100 * {c} / total, 6) AS contribution_pct FROM a" for n, c in AXES.items()))
def _(spark, sf):
    return rounded(R.radar(risk(spark, sf), AXES), "value", "contribution_pct")


@query("rp24_risk_trend", """
    SELECT period, round_even(avg(volume_risk), 6) AS average_risk, count(*) FILTER (volume_risk >= 0.8) AS high_risk_providers FROM rolling_history GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(spark, sf):
    return rounded(R.risk_trend(claims_history(spark, sf), 12), "average_risk")


@query("rp25_provider_options", "SELECT DISTINCT NPI FROM provider_volume_risk ORDER BY NPI")
def _(spark, sf):
    return R.options(volume(spark, sf), "NPI")


@query("rp26_jn17_claim_detail", """
    SELECT c.source, c.CLM_ID, c.NPI, v.risk_level, v.volume_risk, round_even(q.dq_quality_score, 6) AS quality_score FROM valid_claims c LEFT JOIN provider_volume_risk v USING (NPI) LEFT JOIN provider_dq q USING (NPI)""")
def _(spark, sf):
    rows = R.claim_detail(stored(spark, sf, "valid_claims"), volume(spark, sf), stored(spark, sf, "claim_quality"))
    return rounded(rows.select("source", "CLM_ID", "NPI", "risk_level", "volume_risk", "quality_score"), "quality_score")


@query("rp26_claim_listing_page", """
    SELECT source, NPI, CLM_ID, strftime(DT, '%Y-%m-%d') AS day FROM valid_claims ORDER BY DT DESC, CLM_ID, source, NPI LIMIT 50 OFFSET 50""")
def _(spark, sf):
    """The second page of the raw claims, behind the last row of the first."""
    rows = stored(spark, sf, "valid_claims").select("source", "NPI", "CLM_ID", "DT")
    found = second_page(rows, [("DT", True), ("CLM_ID", False), ("source", False), ("NPI", False)], 50)
    return found.select("source", "NPI", "CLM_ID", F.date_format("DT", "yyyy-MM-dd").alias("day"))


@query("rp26_fl05_claims_in_range", """
    SELECT source, count(*) AS claims FROM valid_claims WHERE DT >= TIMESTAMP '1997-01-01' AND DT < TIMESTAMP '2000-01-01' GROUP BY 1""")
def _(spark, sf):
    rows = R.between_days(V.valid_claims(S.claim_lines(spark, sf)), "DT", "1997-01-01", "1999-12-31")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("claims"))


@query("rp27_rp30_provider_listing", f"""
    SELECT NPI, score, risk_level, {GAUGE_SQL.format(s='score')} AS gauge FROM rp_risk WHERE NPI LIKE '%00%' ORDER BY score DESC, NPI LIMIT 30""")
def _(spark, sf):
    rows = R.page_after(R.search(risk(spark, sf), "00", ["NPI"]), [("score", True), ("NPI", False)], None, 30)
    return rows.select("NPI", "score", "risk_level", GAUGE("score").alias("gauge"))


@query("rp30_pharmacy_listing", f"""
    SELECT npi, score, risk_level, {GAUGE_SQL.format(s='score')} AS gauge FROM rp_pharmacy_risk ORDER BY score DESC, npi LIMIT 30 OFFSET 30""")
def _(spark, sf):
    rows = second_page(pharmacy_risk(spark, sf), [("score", True), ("npi", False)], 30)
    return rows.select("npi", "score", "risk_level", GAUGE("score").alias("gauge"))


_DRILL = {
    "volume": "SELECT 'volume' AS source, NPI AS id, volume_risk AS score FROM provider_volume_risk WHERE upper(risk_level) = 'HIGH'",
    "drug": "SELECT 'drug', provider_id, robust_z_score FROM rp_drug WHERE severity = 'HIGH'",
    "claim": "SELECT 'claim', provider_id, robust_z_score FROM rp_claim WHERE severity = 'HIGH'",
    "authorization": "SELECT 'authorization', NPI, volume_risk FROM auth_volume_risk WHERE upper(risk_level) = 'HIGH'",
    "claim_risk": "SELECT 'claim_risk', NPI, score FROM rp_risk WHERE upper(risk_level) = 'HIGH'",
}


@query("rp28_fl03_alert_drill_down", " UNION ALL ".join(
    f"SELECT * FROM (SELECT * FROM ({sql}) t(source, id, score) ORDER BY score DESC NULLS LAST, id NULLS FIRST LIMIT 200)" for sql in _DRILL.values()))
def _(spark, sf):
    tables = {
        "volume": (volume(spark, sf), "risk_level", "NPI", "volume_risk"),
        "drug": (drug(spark, sf), "severity", "provider_id", "robust_z_score"),
        "claim": (claim(spark, sf), "severity", "provider_id", "robust_z_score"),
        "authorization": (stored(spark, sf, "auth_volume_risk"), "risk_level", "NPI", "volume_risk"),
        "claim_risk": (risk(spark, sf), "risk_level", "NPI", "score"),
    }
    return R.drill_down(tables, "high", 200)


def _portfolio_sql(source):
    means = ", ".join(f"round_even(avg({c}), 6) AS average_{c}" for c in PARTS)
    return f"""SELECT count(*) AS providers, round_even(avg(score), 6) AS average_score, min(score) AS lowest_score, max(score) AS highest_score, {means},
        {GAUGE_SQL.format(s='avg(score)')} AS gauge, round_even((1 - avg(score)) * 100, 6) AS health FROM {source}"""


_MEANS = ["average_score", "health", *(f"average_{c}" for c in PARTS)]


@query("rp29_portfolio_summary", _portfolio_sql("rp_risk"))
def _(spark, sf):
    return rounded(R.portfolio(risk(spark, sf), "score", PARTS), *_MEANS)


@query("rp29_pharmacy_portfolio", _portfolio_sql("rp_pharmacy_risk"))
def _(spark, sf):
    return rounded(R.portfolio(pharmacy_risk(spark, sf), "score", PARTS), *_MEANS)


@query("rp29_gauge_bands", f"""
    SELECT 'claims' AS portfolio, {GAUGE_SQL.format(s='score')} AS gauge, count(*) AS providers FROM rp_risk GROUP BY 2
    UNION ALL SELECT 'pharmacy', {GAUGE_SQL.format(s='score')}, count(*) FROM rp_pharmacy_risk GROUP BY 2""")
def _(spark, sf):
    both = (("claims", risk(spark, sf)), ("pharmacy", pharmacy_risk(spark, sf)))
    parts = [R.gauge_bands(rows, "score").withColumn("portfolio", F.lit(name)) for name, rows in both]
    return parts[0].unionByName(parts[1])


@query("rp29_level_counts", """
    SELECT 'claims' AS portfolio, upper(risk_level) AS risk_level, count(*) AS providers FROM rp_risk GROUP BY 2 UNION ALL SELECT 'pharmacy', upper(risk_level), count(*) FROM rp_pharmacy_risk GROUP BY 2""")
def _(spark, sf):
    both = (("claims", risk(spark, sf)), ("pharmacy", pharmacy_risk(spark, sf)))
    parts = [R.level_counts(rows, "risk_level").withColumn("portfolio", F.lit(name)) for name, rows in both]
    return parts[0].unionByName(parts[1])


@query("rp29_top_risks", """
    SELECT * FROM (SELECT 'claims' AS portfolio, NPI AS id, score FROM rp_risk ORDER BY score DESC, NPI LIMIT 5) UNION ALL SELECT * FROM (SELECT 'pharmacy', npi, score FROM rp_pharmacy_risk ORDER BY score DESC, npi LIMIT 5)""")
def _(spark, sf):
    both = (("claims", risk(spark, sf), "NPI"), ("pharmacy", pharmacy_risk(spark, sf), "npi"))
    parts = [R.top(rows, "score", 5, key).select(F.lit(name).alias("portfolio"), F.col(key).alias("id"), "score") for name, rows, key in both]
    return parts[0].unionByName(parts[1])


@query("rp29_combined_index", f"""
    WITH m AS (SELECT count(*) AS n, round(avg(score), 4) AS s FROM rp_risk UNION ALL SELECT count(*), round(avg(score), 4) FROM rp_pharmacy_risk), t AS (SELECT CAST(sum(n) AS BIGINT) AS providers, round(avg(s), 4) AS combined_score FROM m)
    SELECT providers, combined_score, round((1 - combined_score) * 100, 1) AS health_index, {GAUGE_SQL.format(s='combined_score')} AS gauge FROM t""")
def _(spark, sf):
    return R.executive_index(R.portfolio(risk(spark, sf), "score"), R.portfolio(pharmacy_risk(spark, sf), "score"))


@query("rp29_weighted_index", f"""
    SELECT count(*) AS providers, round_even(avg(score), 6) AS combined_score, {GAUGE_SQL.format(s='avg(score)')} AS gauge
    FROM (SELECT score FROM rp_risk UNION ALL SELECT npi_affected_pct / 100 FROM auth_npi_metrics)""")
def _(spark, sf):
    a = stored(spark, sf, "auth_metrics").select((F.col("npi_affected_pct") / 100).alias("score"))
    both = R.combined_index(R.portfolio(risk(spark, sf), "score"), R.portfolio(a, "score"))
    return rounded(both, "combined_score")


@query("rp31_trend_facts", """
    WITH t AS (SELECT period, CAST(sum(monthly_volume) AS BIGINT) AS claims FROM monthly_volume GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
    SELECT (SELECT claims FROM t ORDER BY period DESC LIMIT 1) AS latest, round_even(avg(claims), 6) AS average, max(claims) AS peak, (SELECT period FROM t ORDER BY claims DESC, period DESC LIMIT 1) AS peak_period FROM t""")
def _(spark, sf):
    monthly = V.monthly_volume(stored(spark, sf, "valid_claims"))
    trend = R.volume_trend(monthly, claims_history(spark, sf), 12)
    return rounded(R.trend_facts(trend, "period", "claims"), "average")


@query("rp32_elevated_share", """
    SELECT count(*) AS providers, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS elevated, round_even(100.0::DOUBLE * count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) / count(*), 6) AS elevated_pct,
           round_even(100 - 100.0::DOUBLE * count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) / count(*), 6) AS stable_pct FROM provider_volume_risk""")
def _(spark, sf):
    return rounded(R.share_elevated(volume(spark, sf), "risk_level"), "elevated_pct", "stable_pct")


@query("rp32_ag34_highest_claims", """
    WITH t AS (SELECT Gnrc_Name, sum(Tot_Drug_Cst) AS total FROM prescriber_drug GROUP BY 1)
    SELECT Gnrc_Name, round_even(total, 4) AS total, round_even(total / (SELECT max(total) FROM t), 6) AS share_of_peak FROM t ORDER BY t.total DESC, Gnrc_Name LIMIT 5""")
def _(spark, sf):
    rows = R.highest_claims(S.prescriber_drug(spark, sf), "Gnrc_Name", "Tot_Drug_Cst", 5)
    return rounded(rounded(rows, "total", digits=4), "share_of_peak")


@query("rp32_last_periods_by_claims", """
    SELECT period, claims FROM (SELECT period, CAST(sum(monthly_volume) AS BIGINT) AS claims FROM monthly_volume GROUP BY 1) ORDER BY period DESC LIMIT 6""")
def _(spark, sf):
    monthly = V.monthly_volume(stored(spark, sf, "valid_claims"))
    return R.latest(monthly.groupBy("period").agg(F.sum("monthly_volume").alias("claims")), "period", 6)
