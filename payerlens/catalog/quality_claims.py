"""Claims and beneficiary data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, view
from payerlens.catalog.sla import rounded
from payerlens.functions.clean import half_even
from payerlens.operators.keyed import repeated_keys
from payerlens.operators.rules import severity_of
from payerlens.plans import claims_quality as Q
from payerlens.sources.sinks import sample_evidence

TODAY = "2002-01-01"
FILE = "carrier"


def blank(c):
    return f"(trim(coalesce({c}, '')) IN ('', 'nan', 'NaN', 'None'))"


def date(c):
    t = f"trim({c})"
    formats = ("'%Y%m%d'", "'%Y-%m-%d'", "'%m/%d/%Y'", "'%d-%b-%Y'")
    return "coalesce(" + ", ".join(f"try_strptime({t}, {f})" for f in formats) + ")"


def num(c):
    return f"nullif(try_cast({c} AS DOUBLE), 'nan'::DOUBLE)"


ICD10 = r"(?i)^[A-Z][0-9][0-9A-Z](\.?[0-9A-Z]{0,4})?$"
ICD9 = r"(?i)^(\d{3}(\.\d{1,2})?|[EV]\d{2,3}(\.\d{1,2})?)$"


def diag(code, version):
    return f"""(CASE WHEN trim({code}) = '' THEN TRUE WHEN {version} IN ('0', '10') THEN regexp_matches(trim({code}), '{ICD10}')
                WHEN {version} = '9' THEN regexp_matches(trim({code}), '{ICD9}') ELSE TRUE END)"""


COLUMNS = (
    "BENE_ID CLM_ID LINE_NUM PRF_PHYSN_NPI CLM_FROM_DT CLM_THRU_DT CLM_PMT_AMT CLM_TOT_CHRG_AMT LINE_SRVC_CNT "
    "LINE_NCH_PMT_AMT PRNCPAL_DGNS_CD PRNCPAL_DGNS_VRSN_CD ICD_DGNS_CD1 HCPCS_CD PRVDR_STATE_CD CLM_UTLZTN_DAY_CNT"
).split()
view(
    "ct",
    "SELECT "
    + ", ".join(f"coalesce({c}, '') AS {c}" for c in COLUMNS)
    + f", {date('CLM_FROM_DT')} AS from_d, {date('CLM_THRU_DT')} AS thru_d,"
    + " BENE_ID NOT IN (SELECT BENE_ID FROM beneficiary) AS orphan FROM claims_text",
)
INFERRED = "CASE WHEN from_d >= TIMESTAMP '2015-10-01' THEN '0' WHEN from_d < TIMESTAMP '2015-10-01' THEN '9' END"
C, R, P, I, K, N = (
    "Completeness", "Correctness", "Plausibility", "Internal Consistency", "Conformance", "Referential Integrity",
)
RULES = [
    *[(C, f"missing_{c}", "quarantine", blank(c)) for c in
      ("BENE_ID", "CLM_ID", "CLM_FROM_DT", "CLM_THRU_DT", "CLM_PMT_AMT", "PRF_PHYSN_NPI")],
    (R, "invalid_npi_format_PRF_PHYSN_NPI", "quarantine", f"NOT {blank('PRF_PHYSN_NPI')} AND NOT regexp_matches(trim(PRF_PHYSN_NPI), '^\\d{{10}}$')"),
    (R, "missing_ICD_DGNS_CD1", "quarantine", blank("ICD_DGNS_CD1")),
    (R, "invalid_diag_code_inferred_ICD_DGNS_CD1", "flag_for_review_inferred_version",
     f"from_d IS NOT NULL AND NOT {blank('ICD_DGNS_CD1')} AND NOT {diag('ICD_DGNS_CD1', '(' + INFERRED + ')')}"),
    (R, "missing_PRNCPAL_DGNS_CD", "quarantine", blank("PRNCPAL_DGNS_CD")),
    (R, "invalid_diag_code_PRNCPAL_DGNS_CD", "quarantine", f"NOT {diag('PRNCPAL_DGNS_CD', 'trim(PRNCPAL_DGNS_VRSN_CD)')}"),
    (R, "missing_HCPCS_CD", "quarantine", blank("HCPCS_CD")),
    (R, "invalid_hcpcs_format", "quarantine", f"NOT {blank('HCPCS_CD')} AND NOT regexp_matches(trim(HCPCS_CD), '^[A-Z0-9]{{5}}$')"),
    (N, "bene_id_not_in_enrollment", "route_to_data_exception_queue", f"orphan AND NOT {blank('BENE_ID')}"),
    (P, "CLM_THRU_DT_before_CLM_FROM_DT", "quarantine", "thru_d < from_d"),
    *[(P, f"negative_amount_{c}", "flag_for_review", f"{num(c)} < 0") for c in ("CLM_PMT_AMT", "CLM_TOT_CHRG_AMT", "LINE_NCH_PMT_AMT")],
    (P, "non_positive_units_LINE_SRVC_CNT", "quarantine", f"{num('LINE_SRVC_CNT')} <= 0"),
    (P, "implausible_utilization_days", "flag_for_review", f"{num('CLM_UTLZTN_DAY_CNT')} < 0 OR {num('CLM_UTLZTN_DAY_CNT')} > 365"),
    (I, "payment_exceeds_total_charge", "flag_for_review", f"{num('CLM_PMT_AMT')} > {num('CLM_TOT_CHRG_AMT')} + 1"),
    (K, "invalid_diag_version_PRNCPAL_DGNS_VRSN_CD", "quarantine", "trim(PRNCPAL_DGNS_VRSN_CD) NOT IN ('0', '9', '10', '')"),
    (K, "nonstandard_date_format_CLM_FROM_DT", "quarantine", f"NOT {blank('CLM_FROM_DT')} AND from_d IS NULL"),
    (K, "nonstandard_date_format_CLM_THRU_DT", "quarantine", f"NOT {blank('CLM_THRU_DT')} AND thru_d IS NULL"),
    (K, "nonstandard_state_code", "quarantine", f"NOT {blank('PRVDR_STATE_CD')} AND NOT regexp_matches(upper(trim(PRVDR_STATE_CD)), '^([A-Z]{{2}}|\\d{{2}})$')"),
]


def failures(rules, source, columns):
    lit = lambda s: "'" + s + "'"
    return "\nUNION ALL ".join(
        f"SELECT {lit(d)} AS dimension, {lit(r)} AS rule, {lit(a)} AS action, {columns} FROM {source} WHERE {p}"
        for d, r, a, p in rules
    )


view("claim_failures", failures(RULES, "ct", "BENE_ID, CLM_ID, LINE_NUM, trim(PRF_PHYSN_NPI) AS npi"))
view("repeated_lines", "SELECT BENE_ID, CLM_ID, LINE_NUM, count(*) AS key_rows FROM ct GROUP BY 1, 2, 3 HAVING count(*) > 1")
view(
    "header_mismatch",
    f"""
    SELECT CLM_ID, line_sum, hdr_amt FROM (
      SELECT CLM_ID, sum(coalesce({num('LINE_NCH_PMT_AMT')}, 0)) AS line_sum,
             arg_min({num('CLM_PMT_AMT')}, (LINE_NUM, BENE_ID)) FILTER ({num('CLM_PMT_AMT')} IS NOT NULL) AS hdr_amt FROM ct GROUP BY CLM_ID)
    WHERE hdr_amt IS NOT NULL AND abs(line_sum - hdr_amt) > 1
    """,
)
view(
    "claim_counts",
    """
    SELECT dimension, rule, action, count(*) AS affected FROM (SELECT DISTINCT dimension, rule, action, BENE_ID, CLM_ID FROM claim_failures) GROUP BY 1, 2, 3
    UNION ALL SELECT 'Referential Integrity', 'duplicate_claim_line_key', 'quarantine_pend_before_payment', count(*) FROM repeated_lines
    UNION ALL SELECT 'Internal Consistency', 'header_CLM_PMT_AMT_ne_sum_LINE_NCH_PMT_AMT', 'pend_before_payment', count(*) FROM header_mismatch
    """,
)
view(
    "claim_dimensions",
    """
    SELECT dimension, CAST(sum(affected) AS BIGINT) AS affected FROM (
      SELECT dimension, count(*) AS affected FROM (SELECT DISTINCT dimension, BENE_ID, CLM_ID FROM claim_failures) GROUP BY 1
      UNION ALL SELECT dimension, affected FROM claim_counts WHERE rule IN ('duplicate_claim_line_key', 'header_CLM_PMT_AMT_ne_sum_LINE_NCH_PMT_AMT'))
    GROUP BY 1
    """,
)
bdate = {c: date(c) for c in ("BENE_BIRTH_DT", "BENE_DEATH_DT")}
BENE_RULES = [
    *[(C, f"missing_{c}", "quarantine", blank(c)) for c in
      ("BENE_ID", "STATE_CODE", "BENE_BIRTH_DT", "SEX_IDENT_CD", "BENE_ENROLLMT_REF_YR")],
    (R, "invalid_sex_code", "quarantine", "trim(SEX_IDENT_CD) NOT IN ('0', '1', '2')"),
    (R, "invalid_state_code", "quarantine", "NOT regexp_matches(trim(STATE_CODE), '^\\d{2}$')"),
    (P, "implausible_age", "quarantine", f"{num('AGE_AT_END_REF_YR')} < 0 OR {num('AGE_AT_END_REF_YR')} > 115"),
    (P, "malformed_birth_date", "quarantine", f"NOT {blank('BENE_BIRTH_DT')} AND {bdate['BENE_BIRTH_DT']} IS NULL"),
    (P, "birth_date_in_future", "quarantine", f"{bdate['BENE_BIRTH_DT']} > TIMESTAMP '{TODAY}'"),
    (P, "death_before_birth", "quarantine", f"{bdate['BENE_DEATH_DT']} < {bdate['BENE_BIRTH_DT']}"),
]
view("bene_failures", failures(BENE_RULES, "beneficiary", "BENE_ID"))
view(
    "bene_counts",
    """
    SELECT dimension, rule, action, count(*) AS affected FROM (SELECT DISTINCT * FROM bene_failures) GROUP BY 1, 2, 3
    UNION ALL SELECT 'Referential Integrity', 'duplicate_bene_id', 'quarantine', count(*) FROM (SELECT BENE_ID FROM beneficiary GROUP BY 1 HAVING count(*) > 1)
    """,
)
view(
    "bene_dimensions",
    """
    SELECT dimension, count(*) AS affected FROM (SELECT DISTINCT dimension, BENE_ID FROM bene_failures) GROUP BY 1
    UNION ALL SELECT dimension, affected FROM bene_counts WHERE rule = 'duplicate_bene_id'
    """,
)
view(
    "dq_findings",
    """
    SELECT 'carrier' AS file, * FROM claim_counts WHERE affected > 0
    UNION ALL SELECT 'carrier', dimension, NULL, NULL, affected FROM claim_dimensions
    UNION ALL SELECT 'beneficiary', * FROM bene_counts WHERE affected > 0
    UNION ALL SELECT 'beneficiary', dimension, NULL, NULL, affected FROM bene_dimensions
    """,
)
view(
    "dq_totals",
    "SELECT 'carrier' AS file, count(*) AS total_records FROM claims_text UNION ALL SELECT 'beneficiary', count(*) FROM beneficiary",
)
view(
    "dq_scores",
    """
    SELECT t.file, w.dimension, t.total_records, w.weight, coalesce(d.affected, 0) AS affected,
           greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - coalesce(d.affected, 0)::DOUBLE / t.total_records)) AS score
    FROM dq_totals t CROSS JOIN (VALUES ('Completeness', 0.2::DOUBLE), ('Correctness', 0.2::DOUBLE), ('Referential Integrity', 0.15::DOUBLE),
         ('Plausibility', 0.15::DOUBLE), ('Internal Consistency', 0.15::DOUBLE), ('Conformance', 0.15::DOUBLE)) w(dimension, weight)
    LEFT JOIN dq_findings d ON d.file = t.file AND d.dimension = w.dimension AND d.rule IS NULL
    """,
)
SEVERITY = """CASE WHEN action LIKE 'quarantine%' THEN 'critical' WHEN action IN ('route_to_data_exception_queue', 'pend_before_payment') THEN 'high'
              WHEN action LIKE 'flag_for_review%' THEN 'warning' ELSE 'info' END"""


def prepared(spark, sf):
    people = Q.prepare_beneficiaries(S.beneficiary(spark, sf))
    return Q.prepare(S.claims_text(spark, sf), people)


def whole_run(spark, sf):
    return Q.QualityRun(
        {FILE: S.claims_text(spark, sf)}, S.beneficiary(spark, sf), TODAY, run_id="run", batch_id="batch"
    )


@query("dq_c_claim_rules", "SELECT dimension, rule, action, affected FROM dq_findings WHERE file = 'carrier' AND rule IS NOT NULL")
def _(spark, sf):
    """DC01, DC02, DC04-DC08, DC10-DC23: distinct affected records per rule."""
    found = Q.claim_findings(prepared(spark, sf), FILE)
    return found.filter("rule is not null").drop("file")


@query("ag26_claim_dimensions", "SELECT dimension, affected FROM dq_findings WHERE file = 'carrier' AND rule IS NULL")
def _(spark, sf):
    found = Q.claim_findings(prepared(spark, sf), FILE)
    return found.filter("rule is null").select("dimension", "affected")


@query("dq_c_beneficiary_rules", "SELECT dimension, rule, action, affected FROM dq_findings WHERE file = 'beneficiary'")
def _(spark, sf):
    """DC03, DC09, DC11, DC17."""
    people = Q.prepare_beneficiaries(S.beneficiary(spark, sf))
    return Q.beneficiary_findings(people, "beneficiary", TODAY).drop("file")


@query("dc18_ag05_header_mismatch", "SELECT CLM_ID, line_sum, hdr_amt FROM header_mismatch")
def _(spark, sf):
    return Q.header_mismatches(prepared(spark, sf)).select("CLM_ID", "line_sum", "hdr_amt")


@query("dc11_wn11_repeated_line_keys", "SELECT * FROM repeated_lines")
def _(spark, sf):
    df = Q.prepare(S.claims_text(spark, sf))
    return repeated_keys(df, Q.line_key(df))


@query(
    "dc24_dc26_jn01_concordance",
    f"""
    WITH e AS (SELECT BENE_ID, born, died, yr FROM (
        SELECT BENE_ID, {bdate['BENE_BIRTH_DT']} AS born, {bdate['BENE_DEATH_DT']} AS died, try_cast(BENE_ENROLLMT_REF_YR AS INTEGER) AS yr,
               row_number() OVER (PARTITION BY BENE_ID ORDER BY {bdate['BENE_BIRTH_DT']} NULLS FIRST, {bdate['BENE_DEATH_DT']} NULLS FIRST, try_cast(BENE_ENROLLMT_REF_YR AS INTEGER) NULLS FIRST) AS rn
        FROM beneficiary) WHERE rn = 1),
    j AS (SELECT from_d, born, died, yr FROM ct JOIN e ON ct.BENE_ID = e.BENE_ID)
    SELECT 'Concordance' AS dimension, 'service_after_death_date' AS rule, 'quarantine' AS action, count(*) AS violation_rows FROM j WHERE from_d > died
    UNION ALL SELECT 'Concordance', 'claim_year_vs_enrollment_year', 'flag', count(*) FROM j WHERE year(from_d) <> yr
    UNION ALL SELECT 'Concordance', 'claim_age_vs_birth_date_mismatch', 'quarantine', count(*) FROM j WHERE date_diff('day', born, from_d) / 365.25 < 0 OR date_diff('day', born, from_d) / 365.25 > 115
    """,
)
def _(spark, sf):
    return Q.concordance_counts(S.claims_text(spark, sf), S.beneficiary(spark, sf))


@query(
    "dc31_dimension_scores",
    """SELECT file, dimension, total_records, weight, affected, round_even(score, 6) AS score, round_even(score * weight, 6) AS contribution,
              round_even(100.0::DOUBLE * affected / total_records, 4) AS affected_pct FROM dq_scores""",
)
def _(spark, sf):
    return rounded(whole_run(spark, sf).scores, "score", "contribution")


@query(
    "dc30_dc31_file_summary",
    f"""
    SELECT t.file, t.total_records, r.total_rules_checked, r.total_violations, r.critical_count, r.high_count, r.warning_count, r.info_count,
           least(r.total_violations, t.total_records) AS failed_records, greatest(t.total_records - least(r.total_violations, t.total_records), 0) AS passed_records,
           round_even(100.0::DOUBLE * greatest(t.total_records - least(r.total_violations, t.total_records), 0) / t.total_records, 2) AS pass_rate,
           CASE WHEN r.total_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status, q.quality_score, round_even(10 - q.quality_score, 4) AS risk_score
    FROM dq_totals t
    JOIN (SELECT file, count(*) AS total_rules_checked, CAST(sum(affected) AS BIGINT) AS total_violations,
                 count(*) FILTER ({SEVERITY} = 'critical') AS critical_count, count(*) FILTER ({SEVERITY} = 'high') AS high_count,
                 count(*) FILTER ({SEVERITY} = 'warning') AS warning_count, count(*) FILTER ({SEVERITY} = 'info') AS info_count
          FROM dq_findings WHERE rule IS NOT NULL GROUP BY file) r USING (file)
    JOIN (SELECT file, round_even(sum(score * weight) * 10, 4) AS quality_score FROM dq_scores GROUP BY file) q USING (file)
    """,
)
def _(spark, sf):
    return whole_run(spark, sf).summary


def sql_text(column, index):
    from payerlens.functions import messages as M

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN contains(lower(rule), '{p}') THEN {quote(t[index])}" for p, t in M.RULE_TEXT)
    dims = " ".join(f"WHEN dimension = '{d}' THEN {quote(t[index])}" for d, t in M.DIMENSION_TEXT.items())
    return f"CASE {whens} {dims} ELSE {quote(M.RULE_DEFAULT[index])} END AS {column}"


@query(
    "dc33_fn33_rule_explanations",
    f"""SELECT file, dimension, rule, affected, {SEVERITY} AS severity, {sql_text('root_cause', 0)}, {sql_text('recommendation', 1)}
        FROM dq_findings WHERE rule IS NOT NULL""",
)
def _(spark, sf):
    run = whole_run(spark, sf)
    cause, action = Q.explain(F.col("rule"), F.col("dimension"))
    return run.findings.filter("rule is not null").select(
        "file", "dimension", "rule", "affected", severity_of(F.col("action")).alias("severity"),
        cause.alias("root_cause"), action.alias("recommendation"),
    )


@query(
    "dc32_ag28_provider_completeness",
    """
    WITH p AS (SELECT trim(PRF_PHYSN_NPI) AS npi, count(*) AS n FROM ct WHERE trim(PRF_PHYSN_NPI) NOT IN ('', 'nan', 'NaN', 'None') GROUP BY 1),
    f AS (SELECT npi, rule, count(DISTINCT (BENE_ID, CLM_ID, LINE_NUM)) AS bad FROM claim_failures WHERE dimension = 'Completeness' GROUP BY 1, 2)
    SELECT p.npi, r.rule AS rule_name, p.n AS npi_total_rows, coalesce(f.bad, 0) AS npi_affected_rows,
           round_even(100.0::DOUBLE * coalesce(f.bad, 0) / p.n, 4) AS npi_affected_pct,
           round_even(100 - round_even(100.0::DOUBLE * coalesce(f.bad, 0) / p.n, 4), 4) AS npi_completeness_score
    FROM p CROSS JOIN (VALUES ('missing_BENE_ID'), ('missing_CLM_ID'), ('missing_CLM_FROM_DT'), ('missing_CLM_THRU_DT'), ('missing_CLM_PMT_AMT'), ('missing_PRF_PHYSN_NPI')) r(rule)
    LEFT JOIN f ON f.npi = p.npi AND f.rule = r.rule
    """,
)
def _(spark, sf):
    df = Q.prepare(S.claims_text(spark, sf))
    return Q.provider_completeness(df, "PRF_PHYSN_NPI", FILE).select(
        "npi", "rule_name", "npi_total_rows", "npi_affected_rows", "npi_affected_pct",
        "npi_completeness_score",
    )


@query(
    "dc32_ag27_provider_dimensions",
    """
    WITH p AS (SELECT trim(PRF_PHYSN_NPI) AS npi, count(*) AS n FROM ct WHERE trim(PRF_PHYSN_NPI) NOT IN ('', 'nan', 'NaN', 'None') GROUP BY 1),
    f AS (SELECT npi, dimension, count(DISTINCT (BENE_ID, CLM_ID)) AS bad FROM claim_failures GROUP BY 1, 2
          UNION ALL SELECT trim(PRF_PHYSN_NPI), 'Referential Integrity', count(DISTINCT (BENE_ID, CLM_ID, LINE_NUM)) FROM ct JOIN repeated_lines USING (BENE_ID, CLM_ID, LINE_NUM) GROUP BY 1),
    g AS (SELECT npi, dimension, CAST(sum(bad) AS BIGINT) AS bad FROM f GROUP BY 1, 2)
    SELECT p.npi, d.dimension, p.n AS npi_total_rows, coalesce(g.bad, 0) AS npi_affected_rows,
           round_even(100.0::DOUBLE * coalesce(g.bad, 0) / p.n, 4) AS npi_affected_pct,
           round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - round_even(100.0::DOUBLE * coalesce(g.bad, 0) / p.n, 4))), 4) AS npi_dimension_score
    FROM p CROSS JOIN (VALUES ('Correctness'), ('Referential Integrity'), ('Plausibility'), ('Internal Consistency'), ('Conformance')) d(dimension)
    LEFT JOIN g ON g.npi = p.npi AND g.dimension = d.dimension
    """,
)
def _(spark, sf):
    return Q.provider_dimensions(prepared(spark, sf), "PRF_PHYSN_NPI", FILE).select(
        "npi", "dimension", "npi_total_rows", "npi_affected_rows", "npi_affected_pct",
        "npi_dimension_score",
    )


@query(
    "st04_dq_run_table",
    """
    SELECT 'dq_validation' AS step_name, file AS dataset_name, dimension, affected AS affected_rows FROM dq_findings WHERE rule IS NOT NULL
    UNION ALL SELECT 'weighted_dimension_score', file, dimension, affected FROM dq_scores
    UNION ALL SELECT 'weighted_sla_score', file, 'ALL_6_DIMENSIONS', NULL FROM dq_totals
    """,
)
def _(spark, sf):
    run = whole_run(spark, sf)
    table = Q.run_table(run.findings, run.summary, run.scores, None, **run.run_fields)
    return table.select(
        "step_name", "dataset_name", "dimension", "affected_rows"
    )


EVIDENCE_KEYS = ["BENE_ID", "CLM_ID", "LINE_NUM"]


@query(
    "snk05_evidence_samples",
    """
    SELECT dimension, rule, action, count(*) AS sampled, min(CLM_ID) AS first_claim, max(CLM_ID) AS last_claim FROM (
      SELECT *, row_number() OVER (PARTITION BY dimension, rule ORDER BY BENE_ID, CLM_ID, LINE_NUM) AS rn FROM (
        SELECT dimension, rule, action, BENE_ID, CLM_ID, LINE_NUM FROM claim_failures
        UNION ALL SELECT 'Referential Integrity', 'duplicate_claim_line_key', 'quarantine_pend_before_payment', BENE_ID, CLM_ID, LINE_NUM FROM ct JOIN repeated_lines USING (BENE_ID, CLM_ID, LINE_NUM)))
    WHERE rn <= 5000 GROUP BY 1, 2, 3
    """,
)
def _(spark, sf):
    evidence = Q.claim_evidence(prepared(spark, sf), FILE)
    sampled = sample_evidence(evidence, ["file", "dimension", "rule"], EVIDENCE_KEYS, limit=5000)
    return sampled.groupBy("dimension", "rule", "action").agg(
        F.count(F.lit(1)).alias("sampled"),
        F.min("CLM_ID").alias("first_claim"),
        F.max("CLM_ID").alias("last_claim"),
    )


@query(
    "jn02_st03_orphan_ids",
    "SELECT DISTINCT BENE_ID FROM ct WHERE BENE_ID NOT IN (SELECT BENE_ID FROM beneficiary)",
)
def _(spark, sf):
    return Q.orphan_ids(S.claims_text(spark, sf), S.beneficiary(spark, sf))


@query(
    "dc_row_mask_share",
    """SELECT dimension, count(DISTINCT rule) AS failing_rules, count(*) AS failing_rows FROM claim_failures GROUP BY 1""",
)
def _(spark, sf):
    df = prepared(spark, sf)
    from payerlens.operators.rules import evidence_rows

    rows = evidence_rows(df, Q.claim_rules(df), FILE, ["CLM_ID"])
    return rows.groupBy("dimension").agg(
        F.countDistinct("rule").alias("failing_rules"), F.count(F.lit(1)).alias("failing_rows")
    )
