"""Composite risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from payerlens.catalog import anomaly as AN
from payerlens.catalog import pharmacy as PH
from payerlens.catalog import quality_claims as QC
from payerlens.catalog import standins as S
from payerlens.catalog.registry import VIEWS, query, table, view
from payerlens.catalog.sla import rounded
from payerlens.catalog.volume import claims_tables
from payerlens.operators.stages import settle
from payerlens.plans import claims_quality as Q
from payerlens.plans import pharmacy_quality as PQ
from payerlens.plans import pharmacy_volume as PV
from payerlens.plans import risk as R

view(
    "provider_dq_rows",
    """
    WITH p AS (SELECT trim(PRF_PHYSN_NPI) AS npi, count(*) AS n FROM ct WHERE trim(PRF_PHYSN_NPI) NOT IN ('', 'nan', 'NaN', 'None') GROUP BY 1),
    f AS (SELECT npi, rule, count(DISTINCT (BENE_ID, CLM_ID, LINE_NUM)) AS bad FROM claim_failures WHERE dimension = 'Completeness' GROUP BY 1, 2)
    SELECT p.npi, round_even(100 - round_even(100.0::DOUBLE * coalesce(f.bad, 0) / p.n, 4), 4) AS score
    FROM p CROSS JOIN (VALUES ('missing_BENE_ID'), ('missing_CLM_ID'), ('missing_CLM_FROM_DT'), ('missing_CLM_THRU_DT'), ('missing_CLM_PMT_AMT'), ('missing_PRF_PHYSN_NPI')) r(rule)
    LEFT JOIN f ON f.npi = p.npi AND f.rule = r.rule
    """,
)
view(
    "provider_dq_fields",
    VIEWS["provider_dq_rows"].replace("SELECT p.npi,", "SELECT p.npi, substring(r.rule, length('missing_') + 1) AS field,"),
)
view("provider_dq", "SELECT npi AS NPI, avg(score) AS dq_quality_score, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - avg(score) / 100)) AS dq_risk FROM provider_dq_rows GROUP BY 1")
_NAMES = ["Data Quality", "Volume", "Robust Z", "PSI", "Arrival Delay"]
view(
    "provider_sla_risk",
    """
    SELECT *, CASE WHEN final_sla_risk_score <= 0.24 THEN 'LOW' WHEN final_sla_risk_score <= 0.49 THEN 'MEDIUM' WHEN final_sla_risk_score <= 0.74 THEN 'HIGH' ELSE 'CRITICAL' END AS final_risk_level FROM (
      SELECT *, round_even(dq_risk * 0.25::DOUBLE + volume_risk * 0.2::DOUBLE + robust_z_risk * 0.2::DOUBLE + psi_risk * 0.15::DOUBLE + 0.2::DOUBLE * 0.2::DOUBLE, 6) AS final_sla_risk_score FROM (
        SELECT v.NPI, v.current_period, v.current_month_volume, coalesce(v.volume_risk, 0) AS volume_risk, d.dq_quality_score, coalesce(d.dq_risk, 0) AS dq_risk,
               z.robust_z_max, CASE WHEN z.robust_z_max IS NULL THEN 0.0::DOUBLE ELSE least(z.robust_z_max / 7, 1.0::DOUBLE) END AS robust_z_risk, CASE WHEN z.robust_z_max IS NULL THEN 'NO_DATA' WHEN z.robust_z_max >= 3.5 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS robust_z_status,
               p.psi_score, CASE WHEN p.psi_score IS NULL THEN 0.0::DOUBLE ELSE least(p.psi_score / 0.5, 1.0::DOUBLE) END AS psi_risk, CASE WHEN p.psi_score IS NULL THEN 'NO_DATA' WHEN p.psi_score < 0.1 THEN 'NORMAL' WHEN p.psi_score < 0.25 THEN 'MODERATE_DRIFT' ELSE 'SIGNIFICANT_DRIFT' END AS psi_status
        FROM provider_volume_risk v LEFT JOIN provider_dq d USING (NPI)
        LEFT JOIN (SELECT provider_id AS NPI, batch_month AS current_period, max(abs(robust_z_score)) AS robust_z_max FROM claims_anomalies WHERE provider_id IS NOT NULL AND robust_z_score IS NOT NULL GROUP BY 1, 2) z USING (NPI, current_period)
        LEFT JOIN (SELECT batch_month AS current_period, max(psi_score) AS psi_score FROM claims_anomalies WHERE psi_score IS NOT NULL GROUP BY 1) p USING (current_period)))
    """,
)
_RANK = "list_sort([{" + "}, {".join(
    f"'v': round_even({c} * {w}::DOUBLE, 9), 'o': {-i}, 'n': '{n}'"
    for i, (n, c, w) in enumerate(zip(_NAMES, ["dq_risk", "volume_risk", "robust_z_risk", "psi_risk", "0.2::DOUBLE"], [0.25, 0.2, 0.2, 0.15, 0.2]))
) + "}], 'DESC')"
_DRIVERS = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {c} >= 0.5 THEN '{n}' END" for n, c in
    [("data quality", "dq_risk"), ("claim volume", "volume_risk"), ("provider anomalies", "robust_z_risk"), ("population drift", "psi_risk")]
) + ")"


def claim_risk(spark, sf):
    people = Q.prepare_beneficiaries(S.beneficiary(spark, sf))
    quality = Q.provider_completeness(Q.prepare(S.claims_text(spark, sf), people), "PRF_PHYSN_NPI", "carrier")
    anomalies = settle(AN.claim_tables(spark, sf)["claims_anomalies"])
    return R.claim_provider_risk(claims_tables(spark, sf)["provider_volume_risk"], quality, anomalies)


@query(
    "pl15_claim_provider_risk",
    f"""
    SELECT NPI, current_period, current_month_volume, volume_risk, round_even(dq_quality_score, 7) AS dq_quality_score, round_even(dq_risk, 8) AS dq_risk,
           round_even(robust_z_max, 6) AS robust_z_max, robust_z_status, round_even(psi_score, 6) AS psi_score, psi_status, round_even(final_sla_risk_score, 4) AS final_sla_risk_score, final_risk_level,
           printf('Primary risk driver: %s; secondary risk driver: %s.', {_RANK}[1].n, {_RANK}[2].n) AS root_cause,
           CASE WHEN {_DRIVERS} = '' THEN 'No major risk driver detected. Continue routine monitoring.'
                WHEN final_sla_risk_score >= 0.75 THEN printf('Immediate investigation required for %s. Prioritize corrective action.', {_DRIVERS})
                WHEN final_sla_risk_score >= 0.5 THEN printf('Investigate %s and closely monitor the provider.', {_DRIVERS})
                WHEN final_sla_risk_score >= 0.25 THEN printf('Monitor %s during the next processing cycle.', {_DRIVERS}) ELSE 'Continue routine monitoring.' END AS recommendation
    FROM provider_sla_risk
    """,
)
def _(spark, sf):
    rows = claim_risk(spark, sf).select(
        "NPI", "current_period", "current_month_volume", "volume_risk", "dq_quality_score", "dq_risk",
        "robust_z_max", "robust_z_status", "psi_score", "psi_status", "final_sla_risk_score",
        "final_risk_level", "root_cause", "recommendation",
    )
    rows = rounded(rows, "robust_z_max", "psi_score")
    rows = rounded(rounded(rows, "dq_quality_score", digits=7), "dq_risk", digits=8)
    return rounded(rows, "final_sla_risk_score", digits=4)


@query("ag17_fn34_provider_quality_risk", "SELECT NPI, round_even(dq_quality_score, 7) AS dq_quality_score, round_even(dq_risk, 8) AS dq_risk FROM provider_dq")
def _(spark, sf):
    df = Q.prepare(S.claims_text(spark, sf))
    rows = R.quality_risk(Q.provider_completeness(df, "PRF_PHYSN_NPI", QC.FILE))
    rows = rounded(rows.select("NPI", "dq_quality_score", "dq_risk"), "dq_quality_score", digits=7)
    return rounded(rows, "dq_risk", digits=8)


@query("ag19_anomaly_peaks", """
    SELECT provider_id AS NPI, batch_month AS current_period, round_even(max(abs(robust_z_score)), 6) AS robust_z_max FROM claims_anomalies WHERE provider_id IS NOT NULL AND robust_z_score IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    peaks, _ = R.anomaly_peaks(AN.claim_tables(spark, sf)["claims_anomalies"])
    return rounded(peaks.select("NPI", "current_period", "robust_z_max"), "robust_z_max")


# -- pharmacy -----------------------------------------------------------------

_EDGES = R.PSI_EDGES


def _bins(score, weight):
    out = []
    for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])):
        op = "<=" if i == 9 else "<"
        out.append(f"sum(CASE WHEN {score} >= {a} AND {score} {op} {b} THEN {weight} ELSE 0.0::DOUBLE END) AS b{i}")
    return ", ".join(out)


def _norm(prefix):
    total = " + ".join(f"{prefix}b{i}" for i in range(10))
    lifted = [f"greatest({prefix}b{i} / ({total}), 0.000001)" for i in range(10)]
    return [f"({x} / ({' + '.join(lifted)}))" for x in lifted]


_PSI = " + ".join(f"({c} - {b}) * ln({c} / {b})" for b, c in zip(_norm("base."), _norm("cur.")))
view(
    "drug_mix",
    f"""
    SELECT cur.npi, greatest({_PSI}, 0.0::DOUBLE) AS psi FROM (
      SELECT f.Prscrbr_NPI AS npi, {_bins('volume_risk_score', 'clm')} FROM flagged f JOIN drug_peer d ON d.Brnd_Name = f.Brnd_Name AND d.Gnrc_Name = f.Gnrc_Name GROUP BY 1) cur
    CROSS JOIN (SELECT {_bins('volume_risk_score', 'total_claims')} FROM drug_peer) base
    """,
)
_METRICS = R.ROBUST_METRICS
_Z = ", ".join(
    f"greatest(CASE WHEN {m}_mad > 0 THEN 0.6745::DOUBLE * ({m} - {m}_med) / {m}_mad WHEN {m}_std > 0 THEN ({m} - {m}_med) / {m}_std ELSE 0 END, 0)" for m in _METRICS
)
view(
    "npi_z",
    f"""
    SELECT Prscrbr_NPI AS npi, volume_risk_score, least(greatest({_Z}) / 3.5, 1.0::DOUBLE) AS z_risk FROM (
      SELECT *, {', '.join(f'median(abs({m} - {m}_med)) OVER () AS {m}_mad' for m in _METRICS)} FROM (
        SELECT *, {', '.join(f'median({m}) OVER () AS {m}_med, stddev_pop({m}) OVER () AS {m}_std' for m in _METRICS)} FROM npi_peer))
    """,
)
view("clean_dq", """
    SELECT npi, round_even(sum(round_even(greatest(0.0::DOUBLE, 10 - coalesce(lost, 0)), 4) * weight), 4) AS quality_score FROM (
      SELECT p.npi, w.weight, f.lost FROM (SELECT DISTINCT Prscrbr_NPI AS npi FROM prescriber_drug) p
      CROSS JOIN (VALUES ('completeness', 0.15::DOUBLE), ('validity', 0.15::DOUBLE), ('consistency', 0.15::DOUBLE), ('plausibility', 0.15::DOUBLE), ('other', 0.4::DOUBLE)) w(dimension, weight)
      LEFT JOIN (SELECT npi, dimension, sum(CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.75::DOUBLE WHEN 'warning' THEN 0.4::DOUBLE ELSE 0 END * affected_pct / 100 * 10) AS lost
                 FROM drug_findings_once GROUP BY 1, 2) f ON f.npi = p.npi AND f.dimension = w.dimension) GROUP BY 1""")
from payerlens.catalog.quality_other import CHECKS  # noqa: E402

view("drug_findings_once", """
    SELECT npi, dimension, coalesce(fixed_severity, CASE WHEN affected_pct > 15 THEN 'critical' WHEN affected_pct >= 1 THEN 'high' WHEN affected_pct > 0 THEN 'warning' ELSE 'info' END) AS severity, affected_pct
    FROM (SELECT c.npi, dimension, field_name, rule_name, fixed_severity, round_even(100.0::DOUBLE * count(*) / n, 2) AS affected_pct FROM (""" + " UNION ALL ".join(
    f"SELECT Prscrbr_NPI AS npi, '{d}' AS dimension, '{f}' AS field_name, '{r}' AS rule_name, {repr(s) if s else 'NULL'} AS fixed_severity FROM prescriber_drug WHERE {p}" for d, f, r, p, s in CHECKS
) + """) c JOIN (SELECT Prscrbr_NPI AS npi, count(*) AS n FROM prescriber_drug GROUP BY 1) t ON t.npi = c.npi GROUP BY 1, 2, 3, 4, 5, n)""")
view(
    "provider_risk",
    """
    SELECT *, CASE WHEN final_score <= 0.25 THEN 'Low' WHEN final_score <= 0.5 THEN 'Moderate' WHEN final_score <= 0.75 THEN 'High' ELSE 'Critical' END AS Risk_Level FROM (
      SELECT *, 0.285714::DOUBLE * dq_risk + 0.214286::DOUBLE * volume_risk + 0.214286::DOUBLE * z_risk + 0.142857::DOUBLE * psi_risk + 0.142857::DOUBLE * 0.2 AS final_score FROM (
        SELECT z.npi, 1 - q.quality_score / 10 AS dq_risk, z.volume_risk_score / 100 AS volume_risk, z.z_risk, m.psi, 1 - exp(-m.psi) AS psi_risk
        FROM npi_z z JOIN clean_dq q ON q.npi = z.npi JOIN drug_mix m ON m.npi = z.npi))
    """,
)


def pharmacy_risk(spark, sf):
    rows = settle(PH.prescriptions(spark, sf))
    quality = PQ.provider_quality(S.prescriber_drug(spark, sf))["provider_dq_summary"]
    return R.pharmacy_provider_risk(
        quality, PV.provider_peer_risk(rows), PV.provider_drug_detail(rows), PV.drug_peer_risk(rows)
    )


@query("pl16_pharmacy_provider_risk", """
    SELECT npi, round_even(dq_risk, 3) AS DQ_Risk, round_even(round_even(volume_risk, 6), 5) AS Volume_Risk, round_even(round_even(z_risk, 6), 5) AS RobustZ_Risk, round_even(round_even(psi, 6), 5) AS PSI, round_even(round_even(psi_risk, 6), 5) AS PSI_Risk,
           round_even(final_score, 3) AS Final_Risk_Score, Risk_Level FROM provider_risk""")
def _(spark, sf):
    rows = pharmacy_risk(spark, sf).select(
        "npi", "DQ_Risk", "Volume_Risk", "RobustZ_Risk", "PSI", "PSI_Risk", "Final_Risk_Score", "Risk_Level"
    )
    rows = rounded(rows, "DQ_Risk", "Final_Risk_Score", digits=3)
    return rounded(rows, "Volume_Risk", "RobustZ_Risk", "PSI", "PSI_Risk", digits=5)


@query("sx03_sx11_global_robust_z", "SELECT npi, round_even(z_risk, 6) AS z_risk FROM npi_z")
def _(spark, sf):
    rows = R.global_robust_z(PV.provider_rollup(PH.prescriptions(spark, sf)), R.ROBUST_METRICS)
    peak = F.greatest(*[R.positive_z_risk(F.col(f"{m}_robust_z")) for m in R.ROBUST_METRICS])
    return rounded(rows.select(F.col("Prscrbr_NPI").alias("npi"), peak.alias("z_risk")), "z_risk")


@query("sx09_sx10_jn05_ag30_drug_mix_psi", "SELECT npi, round_even(psi, 6) AS PSI, round_even(1 - exp(-psi), 6) AS PSI_Risk FROM drug_mix")
def _(spark, sf):
    rows = settle(PH.prescriptions(spark, sf))
    return rounded(R.drug_mix_psi(PV.provider_drug_detail(rows), PV.drug_peer_risk(rows)), "PSI", "PSI_Risk")


@query("fl06_latest_run", """
    SELECT o_orderpriority AS run_id, count(*) AS rows FROM orders WHERE o_orderpriority = (SELECT o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) GROUP BY 1""")
def _(spark, sf):
    log = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id")
    )
    return R.latest_run(log, "id").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


@query("jn13_wn10_latest_rows", """
    SELECT NPI, period, monthly_volume FROM rolling_history h WHERE period = (SELECT max(period) FROM rolling_history x WHERE x.NPI = h.NPI)""")
def _(spark, sf):
    from payerlens.catalog.volume import claims_history

    return R.latest_rows(claims_history(spark, sf), "NPI", "period").select("NPI", "period", "monthly_volume")
