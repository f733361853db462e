"""Pharmacy and authorization data-quality queries."""

from __future__ import annotations

from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, view
from payerlens.catalog.sla import rounded
from payerlens.plans import auth_quality as A
from payerlens.plans import pharmacy_quality as P

TODAY = "2001-07-20"

STATES = ", ".join(f"'{s}'" for s in P.STATE_CODES)
CHECKS = [
    *[("completeness", c, "not_null", f"{c} IS NULL", None) for c in P.REQUIRED],
    ("validity", "Prscrbr_NPI", "must_be_10_digits", "NOT regexp_matches(trim(Prscrbr_NPI), '^\\d{10}$')", None),
    ("validity", "Prscrbr_State_Abrvtn", "must_be_valid_state_code", f"coalesce(Prscrbr_State_Abrvtn, '') NOT IN ({STATES})", None),
    ("validity", "Prscrbr_Type_Src", "must_be_allowed_value", "coalesce(Prscrbr_Type_Src, '') NOT IN ('Claim-Specialty', 'NPPES-Specialty', 'NPPES-Taxonomy')", None),
    *[("validity", c, "must_be_non_negative", f"{c} < 0", None) for c in P.NON_NEGATIVE],
    ("validity", "GE65_Sprsn_Flag", "must_be_valid_suppression_symbol", "trim(coalesce(GE65_Sprsn_Flag, '')) NOT IN ('*', '#', '')", None),
    ("consistency", "GE65_Tot_Clms vs Tot_Clms", "GE65_Tot_Clms_must_not_exceed_Tot_Clms", "GE65_Tot_Clms > Tot_Clms", None),
    ("consistency", "Tot_Benes", "Tot_Benes_must_not_exceed_Tot_Clms", "Tot_Benes > Tot_Clms", None),
    ("consistency", "Tot_Day_Suply vs Tot_30day_Fills*30", "soft_ratio_check_30pct_tolerance",
     "Tot_30day_Fills > 0 AND abs(Tot_Day_Suply - Tot_30day_Fills * 30) / (Tot_30day_Fills * 30) * 100 > 30", "warning"),
    ("plausibility", "Tot_Clms / Tot_Benes", "claims_per_beneficiary_over_20_flagged_for_review", "Tot_Clms::DOUBLE / nullif(Tot_Benes, 0) > 20", "warning"),
]
view(
    "drug_checks",
    "\nUNION ALL ".join(
        f"SELECT Prscrbr_NPI AS npi, '{d}' AS dimension, '{f}' AS field_name, '{r}' AS rule_name, {repr(s) if s else 'NULL'} AS fixed_severity FROM drug_rows WHERE {p}"
        for d, f, r, p, s in CHECKS
    )
    + """
    UNION ALL SELECT d.Prscrbr_NPI, 'uniqueness', 'Prscrbr_NPI+Brnd_Name+Gnrc_Name', 'unique_key', NULL FROM drug_rows d
      JOIN (SELECT Prscrbr_NPI, Brnd_Name, Gnrc_Name FROM drug_rows GROUP BY 1, 2, 3 HAVING count(*) > 1) k
        ON d.Prscrbr_NPI = k.Prscrbr_NPI AND d.Brnd_Name = k.Brnd_Name AND d.Gnrc_Name = k.Gnrc_Name
    """,
)
view(
    "drug_rows",
    """
    SELECT * FROM prescriber_drug
    UNION ALL SELECT * REPLACE (CASE WHEN Tot_Clms > 4 THEN NULL ELSE Tot_Drug_Cst END AS Tot_Drug_Cst) FROM prescriber_drug WHERE Brnd_Name = 'Brand#7'
    """,
)
view(
    "drug_findings",
    """
    SELECT npi, dimension, field_name, rule_name, affected_rows, affected_pct,
           coalesce(fixed_severity, CASE WHEN affected_pct > 15 THEN 'critical' WHEN affected_pct >= 1 THEN 'high' WHEN affected_pct > 0 THEN 'warning' ELSE 'info' END) AS severity
    FROM (SELECT c.npi, dimension, field_name, rule_name, fixed_severity, count(*) AS affected_rows, round_even(100.0::DOUBLE * count(*) / n, 2) AS affected_pct
          FROM drug_checks c JOIN (SELECT Prscrbr_NPI AS npi, count(*) AS n FROM drug_rows GROUP BY 1) t ON t.npi = c.npi GROUP BY 1, 2, 3, 4, 5, n)
    """,
)
view(
    "drug_dimensions",
    """
    SELECT npi, dimension, weight, score, round_even(score * weight, 4) AS weighted_contribution, findings_count FROM (
      SELECT p.npi, w.dimension, w.weight, round_even(greatest(0.0::DOUBLE, least(10.0::DOUBLE, 10 - coalesce(f.lost, 0))), 4) AS score, coalesce(f.n, 0) AS findings_count
      FROM (SELECT DISTINCT Prscrbr_NPI AS npi FROM drug_rows) p
      CROSS JOIN (VALUES ('completeness', 0.15::DOUBLE), ('uniqueness', 0.1::DOUBLE), ('validity', 0.15::DOUBLE), ('consistency', 0.15::DOUBLE),
        ('referential_integrity', 0.1::DOUBLE), ('concordance', 0.1::DOUBLE), ('plausibility', 0.15::DOUBLE), ('correctness', 0.1::DOUBLE)) w(dimension, weight)
      LEFT JOIN (SELECT npi, dimension, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.75::DOUBLE WHEN 'warning' THEN 0.4::DOUBLE ELSE 0 END * affected_pct / 100 * 10) AS lost
                 FROM drug_findings GROUP BY 1, 2) f ON f.npi = p.npi AND f.dimension = w.dimension)
    """,
)


def drug_rows(spark, sf):
    """Prescriber-drug rows with one brand listed twice, partly without cost."""
    from pyspark.sql import functions as F

    rows = S.prescriber_drug(spark, sf)
    again = rows.filter(F.col("Brnd_Name") == "Brand#7").withColumn(
        "Tot_Drug_Cst", F.when(~(F.col("Tot_Clms") > 4), F.col("Tot_Drug_Cst"))
    )
    return rows.unionByName(again)


def tables(spark, sf):
    return P.provider_quality(drug_rows(spark, sf))


@query("dq_p_findings", "SELECT * FROM drug_findings")
def _(spark, sf):
    """DP01-DP08, DP12 evidence."""
    return tables(spark, sf)["provider_dq_evidence"]


@query(
    "dp11_rs02_dimension_scores",
    "SELECT * REPLACE (round_even(score, 3) AS score, round_even(weighted_contribution, 3) AS weighted_contribution) FROM drug_dimensions",
)
def _(spark, sf):
    scores = tables(spark, sf)["provider_dq_dimension"]
    return rounded(scores, "score", "weighted_contribution", digits=3)


@query(
    "dp12_ag15_provider_summary",
    """
    SELECT t.npi, provider_last_name, coalesce(provider_first_name, '') AS provider_first_name, provider_type, state, total_records,
           round_even(total_claims, 4) AS total_claims, round_even(total_drug_cost, 4) AS total_drug_cost, unique_drugs,
           round_even(CASE WHEN total_claims > 0 THEN total_drug_cost / total_claims ELSE 0 END, 4) AS cost_per_claim,
           round_even(CASE WHEN total_beneficiaries > 0 THEN total_claims / total_beneficiaries ELSE 0 END, 4) AS claims_per_beneficiary,
           round_even(q.quality_score, 3) AS quality_score, CASE WHEN q.quality_score >= 9 THEN 'excellent' WHEN q.quality_score >= 7.5 THEN 'good' WHEN q.quality_score >= 5 THEN 'moderate' WHEN q.quality_score >= 2.5 THEN 'poor' ELSE 'critical' END AS quality_status,
           coalesce(c.critical_count, 0) AS critical_count, coalesce(c.high_count, 0) AS high_count, coalesce(c.warning_count, 0) AS warning_count,
           coalesce(c.critical_count + c.high_count + c.warning_count, 0) AS total_violations
    FROM (SELECT Prscrbr_NPI AS npi, min(Prscrbr_Last_Org_Name) AS provider_last_name, min(Prscrbr_First_Name) AS provider_first_name, min(Prscrbr_Type) AS provider_type,
                 min(Prscrbr_State_Abrvtn) AS state, count(*) AS total_records, CAST(sum(Tot_Clms) AS DOUBLE) AS total_claims, coalesce(sum(Tot_Drug_Cst), 0) AS total_drug_cost,
                 CAST(coalesce(sum(Tot_Benes), 0) AS DOUBLE) AS total_beneficiaries, count(DISTINCT Gnrc_Name) AS unique_drugs FROM drug_rows GROUP BY 1) t
    JOIN (SELECT npi, round_even(sum(score * weight), 4) AS quality_score FROM drug_dimensions GROUP BY 1) q ON q.npi = t.npi
    LEFT JOIN (SELECT npi, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'warning') AS warning_count
               FROM drug_findings GROUP BY 1) c ON c.npi = t.npi
    """,
)
def _(spark, sf):
    rows = tables(spark, sf)["provider_dq_summary"].select(
        "npi", "provider_last_name", "provider_first_name", "provider_type", "state",
        "total_records", "total_claims", "total_drug_cost", "unique_drugs", "cost_per_claim",
        "claims_per_beneficiary", "quality_score", "quality_status", "critical_count", "high_count",
        "warning_count", "total_violations",
    )
    rows = rounded(rows, "total_claims", "total_drug_cost", digits=4)
    return rounded(rows, "quality_score", digits=3)


@query(
    "dp09_row_count_check",
    """SELECT 'correctness' AS dimension, 'row_count' AS field_name, 'actual_row_count_must_match_expected_row_count' AS rule_name,
              abs(count(*) - 474) AS affected_rows, 'critical' AS severity FROM drug_list HAVING count(*) <> 474""",
)
def _(spark, sf):
    return P.row_count_finding(S.drug_list(spark, sf), 474)


# -- authorizations -------------------------------------------------------------

view(
    "auth_std",
    """
    SELECT a.* REPLACE (regexp_replace(trim(provider_id), '^(\\d+)\\.0$', '\\1') AS provider_id) FROM authorizations a
    """,
)


def auth_rules_sql():
    masks = [
        "authorization_id IS NULL OR authorization_id = ''",
        "bene_id IS NULL OR bene_id = ''",
        "provider_id IS NULL OR provider_id = ''",
        "coalesce(provider_id, '') <> '' AND NOT regexp_matches(provider_id, '^\\d{10}$')",
        "service_code IS NULL OR service_code = ''",
        "request_date IS NULL",
        "status NOT IN ('Approved', 'Denied', 'Pending', 'Expired', 'Cancelled')",
        "urgency NOT IN ('Routine', 'Urgent', 'Emergency')",
        "approval_date < request_date",
        "expiry_date < approval_date",
        "status = 'Approved' AND approval_date IS NULL",
        "status = 'Expired' AND expiry_date IS NULL",
        "status = 'Pending' AND approval_date IS NOT NULL",
        "authorization_id IS NOT NULL AND count(*) OVER (PARTITION BY authorization_id) > 1",
        "bene_id IS NOT NULL AND provider_id IS NOT NULL AND service_code IS NOT NULL AND request_date IS NOT NULL AND count(*) OVER (PARTITION BY bene_id, provider_id, service_code, request_date) > 1",
        f"status = 'Pending' AND date_diff('day', request_date, TIMESTAMP '{TODAY}') > 7",
    ]
    return masks


# Name, dimension, deduction and severity rank as the check states them.
AUTH_RULES = [
    ("Missing Authorization ID", "Completeness", 30, 4), ("Missing Beneficiary ID", "Completeness", 15, 4),
    ("Missing Provider NPI", "Completeness", 15, 4), ("Invalid Provider NPI Format", "Validity", 25, 4),
    ("Missing Service Code", "Completeness", 15, 3), ("Missing or Invalid Request Date", "Completeness", 15, 3),
    ("Invalid Authorization Status", "Validity", 15, 3), ("Invalid Urgency", "Validity", 10, 2),
    ("Approval Before Request", "Consistency", 20, 4), ("Expiry Before Approval", "Consistency", 20, 4),
    ("Approved Without Approval Date", "Consistency", 20, 4), ("Expired Without Expiry Date", "Consistency", 20, 4),
    ("Pending With Approval Date", "Consistency", 15, 3), ("Duplicate Authorization ID", "Uniqueness", 25, 4),
    ("Duplicate Authorization Business Record", "Uniqueness", 20, 3), ("Pending Beyond SLA", "Timeliness", 15, 3),
]
SEVERITY = "(['Good', 'Low', 'Medium', 'High', 'Critical'])[1 + {rank}]"
view(
    "auth_masks",
    "SELECT authorization_id, coalesce(nullif(provider_id, ''), 'MISSING_PROVIDER_NPI') AS provider_id, request_date, "
    + ", ".join(f"coalesce({m}, FALSE) AS m{i}" for i, m in enumerate(auth_rules_sql()))
    + " FROM auth_std",
)
view("auth_rule_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS rule_name, {r} AS rank_of, count(*) FILTER (m{i}) AS failed FROM auth_masks" for i, (n, _, _, r) in enumerate(AUTH_RULES)))
_LOST = " + ".join(f"CASE WHEN m{i} THEN {d} ELSE 0 END" for i, (_, _, d, _) in enumerate(AUTH_RULES))
_WORST = "greatest(0, " + ", ".join(f"CASE WHEN m{i} THEN {r} ELSE 0 END" for i, (_, _, _, r) in enumerate(AUTH_RULES)) + ")"
_NAMES = "concat_ws('; ', " + ", ".join(f"CASE WHEN m{i} THEN '{n}' END" for i, (n, _, _, _) in enumerate(AUTH_RULES)) + ")"
CATEGORY = "CASE WHEN {s} >= 95 THEN 'Excellent' WHEN {s} >= 85 THEN 'Good' WHEN {s} >= 70 THEN 'Warning' WHEN {s} >= 50 THEN 'Poor' ELSE 'Critical' END"
view(
    "auth_scored",
    f"""
    SELECT *, {CATEGORY.format(s='quality_score')} AS quality_category, {SEVERITY.format(rank='worst')} AS severity FROM (
      SELECT *, greatest(0.0::DOUBLE, 100 - ({_LOST})) AS quality_score, {_WORST} AS worst,
             CASE WHEN {_NAMES} = '' THEN 'No DQ Issues' ELSE {_NAMES} END AS failed_rules FROM auth_masks)
    """,
)


def quality(spark, sf):
    return A.auth_quality(S.authorizations(spark, sf), TODAY, run_id="run")


@query("da17_record_scores", "SELECT authorization_id, provider_id, quality_score, quality_category, failed_rules, severity FROM auth_scored")
def _(spark, sf):
    """DA01-DA17: score, category, failed rules and severity of every record."""
    from pyspark.sql import functions as F

    provider = F.coalesce(F.nullif("provider_id", F.lit("")), F.lit(A.UNKNOWN_PROVIDER))
    return quality(spark, sf)["records"].select(
        "authorization_id", provider.alias("provider_id"), "quality_score", "quality_category",
        "failed_rules", "severity",
    )


@query(
    "dq_a_rule_results",
    "\nUNION ALL ".join(
        f"SELECT '{n}' AS rule_name, '{d}' AS dq_dimension, count(*) AS total_records, count(*) FILTER (m{i}) AS failed_records, {SEVERITY.format(rank=r)} AS severity, round_even(100.0::DOUBLE * count(*) FILTER (m{i}) / count(*), 2) AS failure_rate_pct FROM auth_masks"
        for i, (n, d, _, r) in enumerate(AUTH_RULES)
    ),
)
def _(spark, sf):
    return quality(spark, sf)["rules"]


_ITEMS = (
    "SELECT provider_id, authorization_id, request_date, 16 AS i, 'No DQ Issues' AS item FROM auth_scored WHERE failed_rules = 'No DQ Issues'\nUNION ALL "
    + "\nUNION ALL ".join(
        f"SELECT provider_id, authorization_id, request_date, {i}, '{n}' FROM auth_masks WHERE m{i}" for i, (n, _, _, _) in enumerate(AUTH_RULES)
    )
)


@query(
    "da18_ag18_fn37_provider_scores",
    f"""
    WITH items AS ({_ITEMS}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY provider_id, item ORDER BY authorization_id NULLS FIRST, request_date NULLS FIRST) AS rn FROM items),
    merged AS (SELECT provider_id, string_agg(item, '; ' ORDER BY authorization_id NULLS FIRST, request_date NULLS FIRST, i) AS failed_rules FROM ranked WHERE rn = 1 GROUP BY 1)
    SELECT s.*, {CATEGORY.format(s='provider_quality_score')} AS quality_category, m.failed_rules FROM (
      SELECT provider_id, count(*) AS total_authorizations, count(*) FILTER (failed_rules <> 'No DQ Issues') AS failed_authorizations,
             round_even(avg(quality_score), 2) AS provider_quality_score,
             round_even(100.0::DOUBLE * count(*) FILTER (failed_rules <> 'No DQ Issues') / count(*), 2) AS dq_failure_rate_pct,
             {SEVERITY.format(rank='max(worst)')} AS severity FROM auth_scored GROUP BY 1) s JOIN merged m USING (provider_id)
    """,
)
def _(spark, sf):
    return quality(spark, sf)["providers"].drop("root_cause", "recommendation")


@query(
    "st04_auth_dq_run_table",
    """
    SELECT 'authorization_provider_dq' AS step_name, provider_id AS npi, 'PROVIDER_DQ_SCORE' AS rule_name, count(*) FILTER (failed_rules <> 'No DQ Issues') AS affected_rows FROM auth_scored GROUP BY provider_id
    UNION ALL """
    + "\nUNION ALL ".join(
        f"SELECT 'authorization_dq_rule', NULL, '{n}', count(*) FILTER (m{i}) FROM auth_masks" for i, (n, _, _, _) in enumerate(AUTH_RULES)
    ),
)
def _(spark, sf):
    return quality(spark, sf)["dq_run_output"].select("step_name", "npi", "rule_name", "affected_rows")
