"""Anomaly queries: peers, drift, claims and drug anomaly tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, table, view
from payerlens.catalog.sla import rounded
from payerlens.operators import drift as D
from payerlens.operators.quantiles import exact_median, robust_z
from payerlens.plans import claims_anomaly as CA
from payerlens.plans import drug_anomaly as DA


def robust_sql(source, keys, features, minimum, count_rows=False):
    """Robust Z of the features as window medians."""
    by = "PARTITION BY " + ", ".join(keys) if keys else ""
    med = ", ".join(f"median({f}::DOUBLE) OVER ({by}) AS {f}_med, count({'*' if count_rows else f}) OVER ({by}) AS {f}_n, count({f}) OVER ({by}) AS {f}_valid" for f in features)
    mad = ", ".join(f"median(abs({f} - {f}_med)) OVER ({by}) AS {f}_mad" for f in features)
    z = ", ".join(f"CASE WHEN {f}_n >= {minimum} AND {f}_mad > 0 THEN 0.6745::DOUBLE * ({f} - {f}_med) / {f}_mad END AS {f}_z" for f in features)
    return f"SELECT *, {z} FROM (SELECT *, {mad} FROM (SELECT *, {med} FROM {source}))"


view(
    "lines",
    """
    SELECT claim_type, CLM_ID AS claim, LINE_NUM AS line, PRVDR_NPI AS provider, strftime(CLM_FROM_DT, '%Y-%m') AS month, BENE_ID AS bene,
           CLM_PMT_AMT AS payment, CLM_TOT_CHRG_AMT AS charge, LINE_ALOWD_CHRG_AMT AS allowed, LINE_SRVC_CNT AS units,
           CLM_UTLZTN_DAY_CNT AS utilization_days, CLM_HHA_TOT_VISIT_CNT AS visits, date_diff('day', CLM_FROM_DT, CLM_THRU_DT) AS los_days,
           PRVDR_SPCLTY AS specialty, PRVDR_STATE_CD AS state, PRNCPAL_DGNS_CD AS diagnosis, ICD_PRCDR_CD1 AS procedure, HCPCS_CD AS hcpcs,
           REV_CNTR AS revenue_center, NCH_PRMRY_PYR_CD AS payer, CLM_DISP_CD AS claim_status, PTNT_DSCHRG_STUS_CD AS discharge_status,
           CASE WHEN ICD_PRCDR_CD1 IS NULL THEN 1 ELSE 0 END AS mismatch,
           CASE WHEN NOT regexp_matches(PRNCPAL_DGNS_CD, '^[A-Z0-9]{3,7}$') THEN 1 ELSE 0 END AS bad_icd,
           CASE WHEN NOT regexp_matches(HCPCS_CD, '^[A-Z0-9]{5}$') THEN 1 ELSE 0 END AS bad_hcpcs,
           CASE WHEN CLM_THRU_DT < CLM_FROM_DT THEN 1 ELSE 0 END AS bad_dates
    FROM claims
    """,
)
view(
    "first_lines",
    """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_type, claim ORDER BY line, provider, month, bene, payment, charge, allowed, utilization_days, visits, los_days) AS rn FROM lines) WHERE rn = 1
    """,
)
view(
    "months",
    """
    SELECT b.*, b.claim_count::DOUBLE / b.beneficiary_count AS claims_per_beneficiary, duplicate_rate, specialty, state,
           CASE WHEN claim_type = 'dme' THEN u END AS avg_service_units, CASE WHEN claim_type = 'dme' THEN p / nullif(a, 0) END AS payment_to_allowed,
           diagnosis_procedure_mismatch, invalid_icd_hcpcs, impossible_date_relation
    FROM (SELECT claim_type, provider, month, count(claim) AS claim_count, count(DISTINCT bene) AS beneficiary_count, avg(payment) AS avg_claim_payment,
                 avg(charge) AS avg_claim_charge, avg(payment / nullif(charge, 0)) AS avg_payment_to_charge, avg(los_days) AS avg_los,
                 avg(utilization_days) AS avg_utilization_days, avg(CASE WHEN claim_type = 'hha' THEN visits END) AS avg_hha_visits, sum(payment) AS total_payment
          FROM first_lines GROUP BY 1, 2, 3) b
    LEFT JOIN (SELECT claim_type, provider, month, 1 - count(DISTINCT (claim, line))::DOUBLE / count(*) AS duplicate_rate, min(specialty) AS specialty, min(state) AS state,
                 avg(units) AS u, avg(payment) AS p, avg(allowed) AS a, CAST(sum(mismatch) AS BIGINT) AS diagnosis_procedure_mismatch,
                 CAST(sum(bad_icd) + sum(bad_hcpcs) AS BIGINT) AS invalid_icd_hcpcs, CAST(sum(bad_dates) AS BIGINT) AS impossible_date_relation
          FROM lines GROUP BY 1, 2, 3) l USING (claim_type, provider, month)
    """,
)
# Sums of many amounts differ in their last digits, so features are compared
# and scored at six decimals on both sides of the check where ties decide.
view("scored_months", f"""
    SELECT *, CASE WHEN sb_n >= 5 AND sb_mad > 0 THEN 0.6745::DOUBLE * (claims_per_beneficiary - sb_med) / sb_mad END AS specialty_behavior_z FROM (
      SELECT *, median(abs(claims_per_beneficiary - sb_med)) OVER (PARTITION BY claim_type, month, specialty) AS sb_mad FROM (
        SELECT *, median(claims_per_beneficiary) OVER (PARTITION BY claim_type, month, specialty) AS sb_med, count(claims_per_beneficiary) OVER (PARTITION BY claim_type, month, specialty) AS sb_n
        FROM ({robust_sql('months', ['claim_type', 'month'], CA.FEATURES, 5)})))""")
_FIELDS = " UNION ALL ".join(
    f"SELECT claim_type, month, '{label}' AS field, {c} AS category FROM lines WHERE {c} IS NOT NULL" for label, c in CA.PSI_FIELDS.items()
)
view(
    "drift",
    f"""
    WITH m AS (SELECT claim_type, month, count(*) AS n, row_number() OVER (PARTITION BY claim_type ORDER BY month) AS idx FROM lines GROUP BY 1, 2),
    w AS (SELECT claim_type, month, n AS current_rows, idx, sum(n) OVER p AS baseline_rows, string_agg(month, ',') OVER p AS baseline_periods
          FROM m WINDOW p AS (PARTITION BY claim_type ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
    ready AS (SELECT * FROM w WHERE idx > 6 AND baseline_rows >= 1000 AND current_rows >= 300),
    c AS (SELECT claim_type, field, category, idx, count(*) AS cnt FROM ({_FIELDS}) JOIN m USING (claim_type, month) GROUP BY 1, 2, 3, 4),
    b AS (SELECT r.claim_type, r.idx, c.field, c.category, sum(c.cnt) AS cnt FROM ready r JOIN c ON c.claim_type = r.claim_type AND c.idx BETWEEN r.idx - 6 AND r.idx - 1 GROUP BY 1, 2, 3, 4),
    bs AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY claim_type, idx, field) AS share FROM b),
    kept AS (SELECT claim_type, idx, field, category, count(*) OVER (PARTITION BY claim_type, idx, field) AS k FROM bs WHERE share >= 0.02),
    usable AS (SELECT DISTINCT claim_type, idx, field, k FROM kept WHERE k >= 2),
    bb AS (SELECT b.claim_type, b.idx, b.field, coalesce(kept.category, 'OTHER_RARE') AS category, sum(b.cnt) AS base, 0 AS curr FROM b JOIN usable USING (claim_type, idx, field) LEFT JOIN kept USING (claim_type, idx, field, category) GROUP BY 1, 2, 3, 4),
    cc AS (SELECT c.claim_type, c.idx, c.field, coalesce(kept.category, 'OTHER_RARE') AS category, 0 AS base, sum(c.cnt) AS curr FROM c JOIN usable USING (claim_type, idx, field) LEFT JOIN kept USING (claim_type, idx, field, category) GROUP BY 1, 2, 3, 4),
    u AS (SELECT claim_type, idx, field, category, sum(base) AS base, sum(curr) AS curr FROM (SELECT * FROM bb UNION ALL SELECT * FROM cc) GROUP BY 1, 2, 3, 4),
    s AS (SELECT claim_type, idx, field, greatest(base::DOUBLE / sum(base) OVER p, 0.0001) AS e, greatest(curr::DOUBLE / sum(curr) OVER p, 0.0001) AS a FROM u WINDOW p AS (PARTITION BY claim_type, idx, field)),
    psi AS (SELECT claim_type, idx, field, sum((a - e) * ln(a / e)) AS psi_score FROM s GROUP BY 1, 2, 3)
    SELECT claim_type, field, ready.month, psi_score, baseline_periods, CAST(baseline_rows AS BIGINT) AS baseline_rows, current_rows, k + 1 AS baseline_categories,
           CASE WHEN psi_score >= 0.25 THEN 1 ELSE 0 END AS psi_anomaly, CASE WHEN psi_score < 0.1 THEN 'NORMAL' WHEN psi_score < 0.25 THEN 'MODERATE DRIFT' ELSE 'SIGNIFICANT DRIFT' END AS interpretation
    FROM psi JOIN ready USING (claim_type, idx) JOIN usable USING (claim_type, idx, field)
    """,
)


def lines(spark, sf):
    return CA.standard_lines(S.claims(spark, sf))


@query("ag06_jn07_first_line_per_claim", """
    SELECT f.claim_type, f.claim, f.line, f.provider, f.month, round_even(f.payment, 4) AS payment, n.claim_line_count, n.duplicate_line_rows
    FROM first_lines f JOIN (SELECT claim_type, claim, CAST(sum(n) AS BIGINT) AS claim_line_count, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_line_rows
      FROM (SELECT claim_type, claim, line, count(*) AS n FROM lines GROUP BY 1, 2, 3) GROUP BY 1, 2) n USING (claim_type, claim)""")
def _(spark, sf):
    l = lines(spark, sf)
    joined = CA.claim_level(l).join(CA.claim_line_counts(l), ["claim_type", "claim"])
    return rounded(
        joined.select("claim_type", "claim", "line", "provider", "month", "payment", "claim_line_count", "duplicate_line_rows"),
        "payment", digits=4,
    )


MONTH_COLUMNS = (
    "avg_claim_payment", "avg_claim_charge", "avg_payment_to_charge", "duplicate_rate", "avg_los",
    "avg_utilization_days", "avg_hha_visits", "avg_service_units", "payment_to_allowed",
    "claims_per_beneficiary",
)


@query(
    "ag07_ag12_provider_months",
    "SELECT claim_type, provider, month, claim_count, beneficiary_count, specialty, state, diagnosis_procedure_mismatch, invalid_icd_hcpcs, impossible_date_relation, "
    + ", ".join(f"round_even({c}, 7) AS {c}" for c in MONTH_COLUMNS) + " FROM months",
)
def _(spark, sf):
    rows = CA.provider_months(lines(spark, sf)).select(
        "claim_type", "provider", "month", "claim_count", "beneficiary_count", "specialty", "state",
        "diagnosis_procedure_mismatch", "invalid_icd_hcpcs", "impossible_date_relation", *MONTH_COLUMNS,
    )
    return rounded(rows, *MONTH_COLUMNS, digits=7)


@query("ag07_provider_month_medians", """
    SELECT claim_type, provider, month, round_even(median(payment), 6) AS median_claim_payment, round_even(median(charge), 6) AS median_claim_charge FROM first_lines GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = CA.claim_medians(CA.claim_level(lines(spark, sf)))
    return rounded(rows, "median_claim_payment", "median_claim_charge")


@query("sx01_sx04_wn14_peer_robust_z", """
    SELECT claim_type, provider, month, round_even(avg_claim_payment_z, 9) AS avg_claim_payment_z, round_even(avg_los_z, 9) AS avg_los_z,
           round_even(avg_hha_visits_z, 9) AS avg_hha_visits_z, round_even(avg_service_units_z, 9) AS avg_service_units_z,
           round_even(claims_per_beneficiary_z, 9) AS claims_per_beneficiary_z, round_even(specialty_behavior_z, 9) AS specialty_behavior_z FROM scored_months""")
def _(spark, sf):
    names = ["avg_claim_payment_z", "avg_los_z", "avg_hha_visits_z", "avg_service_units_z", "claims_per_beneficiary_z", "specialty_behavior_z"]
    rows = CA.peer_scores(CA.provider_months(lines(spark, sf))).select("claim_type", "provider", "month", *names)
    return rounded(rows, *names, digits=9)


@query("wn14_medians_with_empty_groups", """
    SELECT l_returnflag, round_even(median(CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END), 6) AS price_median, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    price = F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).alias("price")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", price)
    # groups above the limit are narrowed in bins, the one without values too
    medians = exact_median(rows, ["l_returnflag"], ["price"], hot_rows=500)
    sizes = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sizes.join(medians, "l_returnflag"), "price_median")


@query("sx07_fl08_wn15_rolling_psi", "SELECT * REPLACE (round_even(psi_score, 6) AS psi_score) FROM drift")
def _(spark, sf):
    return rounded(CA.population_drift(lines(spark, sf)), "psi_score")


_ROBUST = " + ".join(f"CASE WHEN abs({f}_z) >= 3.5 THEN 1 ELSE 0 END" for f in [*CA.ANOMALY_NAMES, "specialty_behavior"])
_MAXZ = "greatest(" + ", ".join(f"CASE WHEN abs({f}_z) >= 3.5 THEN abs({f}_z) END" for f in [*CA.ANOMALY_NAMES, "specialty_behavior"]) + ")"
SEVERITY = """CASE WHEN {n} <= 0 THEN 'NORMAL' WHEN {n} >= 4 OR coalesce({z} >= 7, FALSE) OR coalesce({p} >= 0.75, FALSE) THEN 'HIGH' WHEN {n} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"""
view(
    "month_signals",
    f"""
    SELECT *, robust_n + psi_n + rule_n AS anomaly_count FROM (
      SELECT *, {_ROBUST} + CASE WHEN both_hit THEN 1 ELSE 0 END AS robust_n, coalesce(drift_n, 0) + CASE WHEN both_hit THEN 1 ELSE 0 END AS psi_n,
             CASE WHEN diagnosis_procedure_mismatch > 0 THEN 1 ELSE 0 END + CASE WHEN invalid_icd_hcpcs > 0 THEN 1 ELSE 0 END + CASE WHEN impossible_date_relation > 0 THEN 1 ELSE 0 END AS rule_n,
             {_MAXZ} AS max_z, greatest(drift_max, CASE WHEN both_hit THEN diagnosis_psi END) AS max_psi
      FROM (SELECT *, coalesce(abs(claims_per_beneficiary_z) >= 3.5 AND diagnosis_psi >= 0.25, FALSE) AS both_hit FROM scored_months
            LEFT JOIN (SELECT claim_type, month, count(*) FILTER (psi_anomaly = 1) AS drift_n, max(psi_score) FILTER (psi_anomaly = 1) AS drift_max,
                              max(psi_score) FILTER (field = 'Diagnosis distribution drift') AS diagnosis_psi FROM drift GROUP BY 1, 2) USING (claim_type, month)))
    """,
)
view(
    "claims_anomalies",
    f"""
    SELECT claim_type, provider AS provider_id, month AS batch_month, max_z AS robust_z_score, CASE WHEN robust_n > 0 THEN 1 ELSE 0 END AS robust_z_anomaly,
           max_psi AS psi_score, CASE WHEN psi_n > 0 THEN 1 ELSE 0 END AS psi_anomaly, CAST(anomaly_count AS INTEGER) AS anomaly_count, {SEVERITY.format(n='anomaly_count', z='max_z', p='max_psi')} AS severity
    FROM month_signals WHERE anomaly_count > 0
    UNION ALL SELECT claim_type, NULL, month, NULL, 0, max(psi_score), 1, CAST(count(*) AS INTEGER), {SEVERITY.format(n='count(*)', z='NULL', p='max(psi_score)')}
    FROM drift WHERE psi_anomaly = 1 GROUP BY claim_type, month
    """,
)


def claim_tables(spark, sf):
    return CA.claims_anomalies(lines(spark, sf))


@query("pl13_claims_anomalies", "SELECT * REPLACE (round_even(robust_z_score, 6) AS robust_z_score, round_even(psi_score, 6) AS psi_score) FROM claims_anomalies")
def _(spark, sf):
    rows = claim_tables(spark, sf)["claims_anomalies"].drop("anomaly_id", "anomaly_reason")
    return rounded(rows, "robust_z_score", "psi_score")


@query(
    "rs01_jn16_claims_metric_rows",
    "\nUNION ALL ".join(
        f"SELECT claim_type, provider AS provider_id, month AS batch_month, '{n}' AS anomaly_name, round_even({f}, 9) AS actual_value, round_even({f}_z, 9) AS score, CASE WHEN coalesce(abs({f}_z) >= 3.5, FALSE) THEN 1 ELSE 0 END AS is_anomalous FROM month_signals"
        for f, n in CA.ANOMALY_NAMES.items()
    )
    + """
    UNION ALL SELECT claim_type, provider, month, 'Provider specialty behavior anomaly', round_even(claims_per_beneficiary, 9), round_even(specialty_behavior_z, 9), CASE WHEN coalesce(abs(specialty_behavior_z) >= 3.5, FALSE) THEN 1 ELSE 0 END FROM month_signals
    UNION ALL SELECT claim_type, provider, month, 'Diagnosis–procedure mismatch', diagnosis_procedure_mismatch::DOUBLE, diagnosis_procedure_mismatch::DOUBLE, CASE WHEN diagnosis_procedure_mismatch > 0 THEN 1 ELSE 0 END FROM month_signals
    UNION ALL SELECT claim_type, provider, month, 'Invalid ICD/HCPCS code', invalid_icd_hcpcs::DOUBLE, invalid_icd_hcpcs::DOUBLE, CASE WHEN invalid_icd_hcpcs > 0 THEN 1 ELSE 0 END FROM month_signals
    UNION ALL SELECT claim_type, provider, month, 'Impossible admission/discharge/date relationship', impossible_date_relation::DOUBLE, impossible_date_relation::DOUBLE, CASE WHEN impossible_date_relation > 0 THEN 1 ELSE 0 END FROM month_signals
    UNION ALL SELECT claim_type, provider, month, 'Provider–diagnosis behavior anomaly', round_even(claims_per_beneficiary, 9), round_even(claims_per_beneficiary_z, 9), CASE WHEN both_hit THEN 1 ELSE 0 END FROM month_signals
    UNION ALL SELECT claim_type, provider, month, 'Multi-metric provider anomaly', anomaly_count::DOUBLE, anomaly_count::DOUBLE, CASE WHEN anomaly_count >= 2 THEN 1 ELSE 0 END FROM month_signals
    UNION ALL SELECT claim_type, NULL, month, field, NULL, round_even(psi_score, 9), psi_anomaly FROM drift
    """,
)
def _(spark, sf):
    rows = claim_tables(spark, sf)["claims_individual_metrics"].select(
        "claim_type", "provider_id", "batch_month", "anomaly_name", "actual_value", "score", "is_anomalous"
    )
    return rounded(rows, "actual_value", "score", digits=9)


@query("sx06_categorical_psi", """
    WITH b AS (SELECT n_regionkey AS grp, c_mktsegment AS category, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 4000 GROUP BY 1, 2),
    c AS (SELECT n_regionkey AS grp, c_mktsegment AS category, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 4000 GROUP BY 1, 2),
    u AS (SELECT coalesce(b.grp, c.grp) AS grp, coalesce(b.n, 0) AS bn, coalesce(c.n, 0) AS cn FROM b FULL JOIN c ON b.grp = c.grp AND b.category = c.category),
    s AS (SELECT grp, greatest(bn::DOUBLE / sum(bn) OVER (PARTITION BY grp), 0.0001) AS e, greatest(cn::DOUBLE / sum(cn) OVER (PARTITION BY grp), 0.0001) AS a FROM u)
    SELECT CAST(grp AS VARCHAR) AS grp, round_even(sum((a - e) * ln(a / e)), 6) AS psi FROM s GROUP BY grp""")
def _(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_regionkey").cast("string").alias("grp"), "c_acctbal", "c_mktsegment"
    )
    low, high = (
        D.category_counts(rows.filter(p), ["grp"], {"segment": "c_mktsegment"}).drop("field")
        for p in (F.col("c_acctbal") < 4000, F.col("c_acctbal") >= 4000)
    )
    return rounded(D.categorical_psi(low, high, ["grp"]).select("grp", "psi"), "psi")


@query("ag29_category_shares", """
    SELECT l_returnflag AS category, count(*) AS cnt, round_even(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1""")
def _(spark, sf):
    counts = D.category_counts(
        table(spark, sf, "lineitem").withColumn("k", F.lit(1)), ["k"], {"flag": "l_returnflag"}
    )
    return rounded(D.shares(counts, ["k"], "cnt").select("category", "cnt", "share"), "share")


@query("wn14_exact_median", """
    SELECT l_returnflag, l_linestatus, round_even(median(l_extendedprice), 4) AS price_median, median(l_quantity) AS quantity_median FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    rows = exact_median(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"]
    ).withColumnsRenamed({"l_extendedprice_median": "price_median", "l_quantity_median": "quantity_median"})
    return rounded(rows, "price_median", digits=4)


@query("wn14_exact_median_hot_groups", """
    SELECT l_returnflag, l_linestatus, round_even(median(l_extendedprice), 4) AS price_median, median(l_quantity) AS quantity_median FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    """Same result through the path taken by groups too large for one task."""
    rows = exact_median(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"],
        hot_rows=100,
    ).withColumnsRenamed({"l_extendedprice_median": "price_median", "l_quantity_median": "quantity_median"})
    return rounded(rows, "price_median", digits=4)


# -- drugs ------------------------------------------------------------------------

view(
    "drug_features",
    """
    SELECT *, Tot_Drug_Cst / nullif(Tot_Clms, 0) AS Cost_Per_Claim, Tot_Clms::DOUBLE / nullif(Tot_Benes, 0) AS Claims_Per_Beneficiary,
           Tot_Day_Suply / nullif(Tot_Clms, 0) AS DaySupply_Per_Claim, Tot_Drug_Cst / nullif(Tot_Benes, 0) AS Cost_Per_Beneficiary FROM prescriber_drug
    """,
)


def mix_sql(name, column):
    return f"""
    SELECT g.drug, sum((a - e) * ln(a / e)) AS {name} FROM (
      SELECT d.drug, c.category, greatest(coalesce(x.n, 0)::DOUBLE / d.total, 0.0001) AS a, greatest(coalesce(c.share, 0), 0.0001) AS e
      FROM (SELECT Gnrc_Name AS drug, count({column}) AS total FROM prescriber_drug WHERE {column} IS NOT NULL GROUP BY 1) d
      CROSS JOIN (SELECT bucket AS category, sum(share) AS share FROM (
           SELECT CASE WHEN share >= 0.02 THEN category ELSE 'OTHER_RARE' END AS bucket, share FROM (
             SELECT {column} AS category, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM prescriber_drug WHERE {column} IS NOT NULL GROUP BY 1)) GROUP BY 1) c
      LEFT JOIN (SELECT Gnrc_Name AS drug, CASE WHEN share >= 0.02 THEN category ELSE 'OTHER_RARE' END AS category, sum(n) AS n FROM (
           SELECT Gnrc_Name, {column} AS category, count(*) AS n FROM prescriber_drug WHERE {column} IS NOT NULL GROUP BY 1, 2) JOIN (
           SELECT {column} AS category, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM prescriber_drug WHERE {column} IS NOT NULL GROUP BY 1) USING (category) GROUP BY 1, 2) x
        ON x.drug = d.drug AND x.category = c.category) g GROUP BY 1"""


FEATURES = list(DA.FEATURES)
view("drug_scored", f"""
    SELECT r.*, s.specialty_psi, t.state_psi FROM ({robust_sql('drug_features', ['Gnrc_Name'], FEATURES, 5, count_rows=True)}) r
    LEFT JOIN ({mix_sql('specialty_psi', 'Prscrbr_Type')}) s ON s.drug = r.Gnrc_Name LEFT JOIN ({mix_sql('state_psi', 'Prscrbr_State_Abrvtn')}) t ON t.drug = r.Gnrc_Name""")
_AB = " + ".join(f"CASE WHEN abs({f}_z) >= 3.5 THEN 1 ELSE 0 END" for f in FEATURES)
_YEAR_METRICS = ("total_claims", "total_standardized_30_day_fills", "total_drug_cost", "total_beneficiaries", "total_prescribers",
                 "total_claims_for_antibiotic_drugs", "total_claims_for_antipsychotic_drugs_age65plus", "total_claims_for_opioid_drugs", "total_claims_for_la_opioid_drugs")
view("yearly_z", " UNION ALL ".join(
    f"SELECT calendar_year AS year, '{m}' AS metric, value, value_z AS z FROM ({robust_sql(f'(SELECT calendar_year, {m}::DOUBLE AS value FROM grand_totals)', [], ['value'], 5)})" for m in _YEAR_METRICS))
view(
    "drug_anomalies",
    f"""
    SELECT provider_id, drug, robust_z_score, CASE WHEN ab >= 2 THEN 1 ELSE 0 END AS robust_z_anomaly, psi_score, CASE WHEN sp + st > 0 THEN 1 ELSE 0 END AS psi_anomaly, ab + sp + st AS anomaly_count,
           CASE WHEN ab + sp + st >= 5 THEN 'HIGH' WHEN ab + sp + st >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity, brand
    FROM (SELECT Prscrbr_NPI AS provider_id, Gnrc_Name AS drug, Brnd_Name AS brand, greatest({', '.join(f'abs({f}_z)' for f in FEATURES)}) AS robust_z_score, greatest(specialty_psi, state_psi) AS psi_score,
                 {_AB} AS ab, CASE WHEN specialty_psi >= 0.25 THEN 1 ELSE 0 END AS sp, CASE WHEN state_psi >= 0.25 THEN 1 ELSE 0 END AS st FROM drug_scored)
    WHERE ab + sp + st > 0
    UNION ALL SELECT NULL, 'ALL_DRUGS_YEARLY', abs(z), 1, NULL, 0, 1, CASE WHEN abs(z) >= 5 THEN 'HIGH' WHEN abs(z) >= 4 THEN 'MEDIUM' ELSE 'LOW' END, NULL FROM yearly_z WHERE abs(z) >= 3.5
    """,
)


def drug_tables(spark, sf):
    return DA.drug_anomalies(S.prescriber_drug(spark, sf), S.drug_list(spark, sf), S.grand_totals(spark, sf))


@query("pl14_drug_anomalies", "SELECT * EXCLUDE (brand) REPLACE (round_even(robust_z_score, 6) AS robust_z_score, round_even(psi_score, 6) AS psi_score) FROM drug_anomalies")
def _(spark, sf):
    rows = drug_tables(spark, sf)["drug_anomalies"].drop("anomaly_id", "anomaly_reason")
    return rounded(rows, "robust_z_score", "psi_score")


@query("sx02_drug_peer_robust_z", "SELECT Prscrbr_NPI, Brnd_Name, Gnrc_Name, " + ", ".join(f"round_even({f}_z, 6) AS {f}_z" for f in FEATURES) + " FROM drug_scored")
def _(spark, sf):
    rows = robust_z(DA.measured(S.prescriber_drug(spark, sf)), ["Gnrc_Name"], FEATURES, 5, count_missing=True)
    names = [f"{f}_z" for f in FEATURES]
    return rounded(rows.select("Prscrbr_NPI", "Brnd_Name", "Gnrc_Name", *names), *names)


@query("sx08_population_psi", "SELECT DISTINCT Gnrc_Name, round_even(specialty_psi, 6) AS specialty_psi, round_even(state_psi, 6) AS state_psi FROM drug_scored")
def _(spark, sf):
    rows = S.prescriber_drug(spark, sf)
    a = D.population_psi(rows, "Gnrc_Name", "Prscrbr_Type").withColumnRenamed("psi", "specialty_psi")
    b = D.population_psi(rows, "Gnrc_Name", "Prscrbr_State_Abrvtn").withColumnRenamed("psi", "state_psi")
    return rounded(a.join(b, "Gnrc_Name", "full"), "specialty_psi", "state_psi")


@query("sx05_yearly_robust_z", "SELECT year, metric, round_even(z, 6) AS z FROM yearly_z")
def _(spark, sf):
    return rounded(DA.yearly_scores(S.grand_totals(spark, sf)).select("year", "metric", "z"), "z")


@query(
    "rs01_drug_metric_rows",
    " UNION ALL ".join(
        f"SELECT Prscrbr_NPI AS provider_id, Gnrc_Name AS drug, '{f}' AS metric_name, round_even({f}::DOUBLE, 6) AS actual_value, round_even({f}_z, 6) AS score, CASE WHEN coalesce(abs({f}_z) >= 3.5, FALSE) THEN 1 ELSE 0 END AS is_anomalous, CASE WHEN {f}_valid >= 5 AND {f}_mad > 0 THEN {f}_valid ELSE 0 END AS peers FROM drug_scored"
        for f in FEATURES
    ),
)
def _(spark, sf):
    rows = DA.drug_metric_rows(DA.with_signals(DA.scored(DA.measured(S.prescriber_drug(spark, sf)))))
    peers = F.regexp_extract("baseline_periods", r"peer_count=(\d+)", 1).try_cast("bigint")
    rows = rows.filter("metric_type = 'ROBUST_Z'").select(
        "provider_id", "drug", "metric_name", "actual_value", "score", "is_anomalous", peers.alias("peers")
    )
    return rounded(rows, "actual_value", "score")


@query("jn04_drug_list_by_generic", """
    SELECT p.Prscrbr_NPI, p.Brnd_Name, p.Gnrc_Name, d.drug_name AS listed_drug, trim(d.la_opioid_flag) AS la_flag FROM prescriber_drug p
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upper(trim(generic_name)) ORDER BY drug_name) AS rn FROM drug_list) WHERE rn = 1) d ON upper(trim(d.generic_name)) = upper(trim(p.Gnrc_Name))""")
def _(spark, sf):
    rows = DA.classified(DA.measured(S.prescriber_drug(spark, sf)), S.drug_list(spark, sf))
    return rows.select("Prscrbr_NPI", "Brnd_Name", "Gnrc_Name", F.col("Drug Name").alias("listed_drug"), F.col("LA Opioid Flag").alias("la_flag"))


@query("tk05_most_severe_drug_anomalies", """
    SELECT drug, severity, anomaly_count, round_even(robust_z_score, 6) AS robust_z_score FROM drug_anomalies
    ORDER BY CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, anomaly_count DESC, drug_anomalies.robust_z_score DESC NULLS LAST LIMIT 30""")
def _(spark, sf):
    top = DA.most_severe(drug_tables(spark, sf)["drug_anomalies"], 30)
    return rounded(top.select("drug", "severity", "anomaly_count", "robust_z_score"), "robust_z_score")
