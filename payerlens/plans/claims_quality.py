"""Claims and beneficiary data quality: rules, findings, scores, provider rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.functions import codes
from payerlens.functions import messages as M
from payerlens.functions.clean import clip, half_even, is_blank, number, text_or_empty
from payerlens.functions.dates import age_years, parse_date
from payerlens.functions.text import fill, first_match, fixed
from payerlens.operators.contracts import existing
from payerlens.operators.keyed import first_per_key, mark_orphans, mark_repeated, repeated_keys
from payerlens.operators.rules import (
    Rule,
    all_records,
    count_findings,
    dimensions_of,
    evidence_rows,
    failing_records,
    one_finding,
    severity_of,
)
from payerlens.sources.readers import all_text
from payerlens.sources.sinks import run_rows

# Fixed values.
REQUIRED = ("BENE_ID", "CLM_ID", "CLM_FROM_DT", "CLM_THRU_DT", "CLM_PMT_AMT")
NPI_FIELDS = (
    "ORG_NPI_NUM",
    "AT_PHYSN_NPI",
    "OP_PHYSN_NPI",
    "OT_PHYSN_NPI",
    "RNDRNG_PHYSN_NPI",
    "RFR_PHYSN_NPI",
    "PRF_PHYSN_NPI",
    "CARR_CLM_BLG_NPI_NUM",
    "PRVDR_NPI",
)
DATE_PAIRS = (("CLM_FROM_DT", "CLM_THRU_DT"), ("CLM_ADMSN_DT", "NCH_BENE_DSCHRG_DT"))
DATE_SEQUENCE = ("CLM_ADMSN_DT", "CLM_FROM_DT", "CLM_THRU_DT", "NCH_BENE_DSCHRG_DT")
AMOUNTS = (
    "CLM_PMT_AMT",
    "CLM_TOT_CHRG_AMT",
    "NCH_CLM_BENE_PMT_AMT",
    "LINE_NCH_PMT_AMT",
    "REV_CNTR_PMT_AMT_AMT",
    "REV_CNTR_TOT_CHRG_AMT",
)
UNITS = ("LINE_SRVC_CNT", "REV_CNTR_UNIT_CNT")
LINE_AMOUNTS = ("LINE_NCH_PMT_AMT", "REV_CNTR_PMT_AMT_AMT")
HEADER_AMOUNT = "CLM_PMT_AMT"
TOLERANCE = 1.0
LINE_COLUMNS = ("LINE_NUM", "CLM_LINE_NUM")
PROVIDER_COLUMNS = {
    "carrier": "PRF_PHYSN_NPI",
    "dme": "PRVDR_NPI",
    "hha": "ORG_NPI_NUM",
    "hospice": "ORG_NPI_NUM",
    "inpatient": "ORG_NPI_NUM",
    "outpatient": "ORG_NPI_NUM",
}
BENE_REQUIRED = ("BENE_ID", "STATE_CODE", "BENE_BIRTH_DT", "SEX_IDENT_CD", "BENE_ENROLLMT_REF_YR")
WEIGHTS = {
    "Completeness": 0.20,
    "Correctness": 0.20,
    "Referential Integrity": 0.15,
    "Plausibility": 0.15,
    "Internal Consistency": 0.15,
    "Conformance": 0.15,
}
ORPHAN = "__orphan"
DUPLICATE = "__repeated"
CLAIM_KEY = ["BENE_ID", "CLM_ID"]


def diagnosis_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(code column, version column) for numbered diagnoses, then the principal one."""
    pairs = [(f"ICD_DGNS_CD{i}", f"ICD_DGNS_VRSN_CD{i}") for i in range(1, 26)]
    pairs.append(("PRNCPAL_DGNS_CD", "PRNCPAL_DGNS_VRSN_CD"))
    return [p for p in pairs if p[0] in df.columns]


def _date(c: str) -> str:
    return f"__date_{c}"


def prepare(claims: DataFrame, beneficiaries: DataFrame | None = None) -> DataFrame:
    """All-text claims with parsed dates and, given a master, the orphan flag."""
    df = all_text(claims)
    dates = [c for c in df.columns if c.endswith("_DT") or c.endswith("_DT_ID")]
    df = df.withColumns({_date(c): parse_date(c) for c in dates})
    if beneficiaries is not None and "BENE_ID" in df.columns:
        df = mark_orphans(df, all_text(beneficiaries.select("BENE_ID")), "BENE_ID", ORPHAN)
    return df


def claim_rules(df: DataFrame) -> list[Rule]:
    """Row rules that apply to the columns of a prepared claims frame."""
    has = set(df.columns)
    rules: list[Rule] = []

    def add(dimension, name, action, mask):
        rules.append(Rule(dimension, name, action, mask))

    def date(c):
        return F.col(_date(c))

    for c in existing(df, [*REQUIRED, *NPI_FIELDS]):
        add("Completeness", f"missing_{c}", "quarantine", is_blank(c))

    for c in existing(df, NPI_FIELDS):
        add("Correctness", f"invalid_npi_format_{c}", "quarantine", codes.present_but_not(c, codes.NPI))
    for code, version in diagnosis_columns(df):
        add("Correctness", f"missing_{code}", "quarantine", is_blank(code))
        if version in has:
            valid = codes.valid_diagnosis(code, version)
            add("Correctness", f"invalid_diag_code_{code}", "quarantine", ~valid)
        elif "CLM_FROM_DT" in has:
            inferred = codes.icd_version_on(date("CLM_FROM_DT"))
            bad = inferred.isNotNull() & ~is_blank(code) & ~codes.valid_diagnosis(code, inferred)
            add(
                "Correctness",
                f"invalid_diag_code_inferred_{code}",
                "flag_for_review_inferred_version",
                bad,
            )
    if "HCPCS_CD" in has:
        add("Correctness", "missing_HCPCS_CD", "quarantine", is_blank("HCPCS_CD"))
        bad = codes.present_but_not("HCPCS_CD", codes.HCPCS)
        add("Correctness", "invalid_hcpcs_format", "quarantine", bad)

    if ORPHAN in has:
        add(
            "Referential Integrity",
            "bene_id_not_in_enrollment",
            "route_to_data_exception_queue",
            F.col(ORPHAN),
        )

    for start, end in DATE_PAIRS:
        if start in has and end in has:
            add("Plausibility", f"{end}_before_{start}", "quarantine", date(end) < date(start))
        elif start in has:
            bad = ~is_blank(start) & date(start).isNull()
            add("Plausibility", f"malformed_date_{start}", "quarantine", bad)
    for c in existing(df, AMOUNTS):
        add("Plausibility", f"negative_amount_{c}", "flag_for_review", number(c) < 0)
    for c in existing(df, UNITS):
        add("Plausibility", f"non_positive_units_{c}", "quarantine", number(c) <= 0)
    if "CLM_UTLZTN_DAY_CNT" in has:
        days = number("CLM_UTLZTN_DAY_CNT")
        bad = (days < 0) | (days > 365)
        add("Plausibility", "implausible_utilization_days", "flag_for_review", bad)

    if {"CLM_TOT_CHRG_AMT", "CLM_PMT_AMT"} <= has:
        bad = number("CLM_PMT_AMT") > number("CLM_TOT_CHRG_AMT") + TOLERANCE
        add("Internal Consistency", "payment_exceeds_total_charge", "flag_for_review", bad)
    if set(DATE_SEQUENCE) <= has:
        steps = [date(a) <= date(b) for a, b in zip(DATE_SEQUENCE, DATE_SEQUENCE[1:])]
        known = reduce(lambda a, b: a & b, [date(c).isNotNull() for c in DATE_SEQUENCE])
        in_order = reduce(lambda a, b: a & b, steps)
        add("Internal Consistency", "date_sequence_violation", "quarantine", known & ~in_order)

    for _, version in diagnosis_columns(df):
        if version in has:
            bad = ~F.trim(F.col(version)).isin(*codes.DIAGNOSIS_VERSIONS)
            add("Conformance", f"invalid_diag_version_{version}", "quarantine", bad)
    for c in df.columns:
        if c.endswith("_DT") or c.endswith("_DT_ID"):
            if _date(c) in has:
                bad = ~is_blank(c) & date(c).isNull()
                add("Conformance", f"nonstandard_date_format_{c}", "quarantine", bad)
    if "PRVDR_STATE_CD" in has:
        state = F.upper(F.trim(F.col("PRVDR_STATE_CD")))
        bad = ~is_blank("PRVDR_STATE_CD") & ~state.rlike(codes.USPS_STATE)
        add("Conformance", "nonstandard_state_code", "quarantine", bad)
    return rules


def line_key(df: DataFrame) -> list[str]:
    return CLAIM_KEY + existing(df, LINE_COLUMNS)[:1]


def header_mismatches(df: DataFrame) -> DataFrame | None:
    """Claims whose header amount differs from the sum of their lines by more than 1."""
    line = next(iter(existing(df, LINE_AMOUNTS)), None)
    if line is None or HEADER_AMOUNT not in df.columns or "CLM_ID" not in df.columns:
        return None
    order = F.struct(*[F.col(c) for c in [*existing(df, LINE_COLUMNS)[:1], "BENE_ID"]])
    header = number(HEADER_AMOUNT)
    sums = df.groupBy("CLM_ID").agg(
        F.sum(F.coalesce(number(line), F.lit(0.0))).alias("line_sum"),
        F.min_by(header, F.when(header.isNotNull(), F.struct(order, header))).alias("hdr_amt"),
        F.min_by("BENE_ID", order).alias("bene_id"),
    )
    return sums.filter(
        F.col("hdr_amt").isNotNull() & (F.abs(F.col("line_sum") - F.col("hdr_amt")) > TOLERANCE)
    )


def claim_findings(df: DataFrame, file: str) -> DataFrame:
    """Distinct affected records per rule, and per dimension with rule NULL.

    Rules that identify records by other columns (line keys, claim totals)
    count apart and add to their dimension.
    """
    rules = claim_rules(df)
    parts = [count_findings(failing_records(df, rules, CLAIM_KEY), rules)]
    repeated = repeated_keys(df, line_key(df)).agg(F.count(F.lit(1)).alias("affected"))
    parts.append(
        one_finding(
            repeated,
            "Referential Integrity",
            "duplicate_claim_line_key",
            "quarantine_pend_before_payment",
        )
    )
    mismatched = header_mismatches(df)
    if mismatched is not None:
        line = existing(df, LINE_AMOUNTS)[0]
        counted = mismatched.agg(F.count(F.lit(1)).alias("affected"))
        name = f"header_{HEADER_AMOUNT}_ne_sum_{line}"
        parts.append(one_finding(counted, "Internal Consistency", name, "pend_before_payment"))
    return _merge(parts, file)


def _merge(parts: Sequence[DataFrame], file: str) -> DataFrame:
    merged = reduce(DataFrame.unionByName, parts)
    return (
        merged.groupBy("dimension", "rule", "action")
        .agg(F.sum("affected").alias("affected"))
        .filter("affected > 0")
        .withColumn("file", F.lit(file))
    )


def prepare_beneficiaries(beneficiaries: DataFrame) -> DataFrame:
    df = all_text(beneficiaries)
    dates = existing(df, ("BENE_BIRTH_DT", "BENE_DEATH_DT"))
    return df.withColumns({_date(c): parse_date(c) for c in dates})


def beneficiary_rules(df: DataFrame, today: str) -> list[Rule]:
    has, rules = set(df.columns), []

    def add(dimension, name, mask):
        rules.append(Rule(dimension, name, "quarantine", mask))

    for c in existing(df, BENE_REQUIRED):
        add("Completeness", f"missing_{c}", is_blank(c))
    if "SEX_IDENT_CD" in has:
        sex = F.trim(F.col("SEX_IDENT_CD"))
        add("Correctness", "invalid_sex_code", ~sex.isin(*codes.SEX_CODES))
    if "STATE_CODE" in has:
        add("Correctness", "invalid_state_code", ~codes.matches("STATE_CODE", codes.SSA_STATE))
    if "AGE_AT_END_REF_YR" in has:
        age = number("AGE_AT_END_REF_YR")
        add("Plausibility", "implausible_age", (age < 0) | (age > 115))
    if "BENE_BIRTH_DT" in has:
        born = F.col(_date("BENE_BIRTH_DT"))
        add("Plausibility", "malformed_birth_date", ~is_blank("BENE_BIRTH_DT") & born.isNull())
        add("Plausibility", "birth_date_in_future", born > F.lit(today).cast("date"))
        if "BENE_DEATH_DT" in has:
            add("Plausibility", "death_before_birth", F.col(_date("BENE_DEATH_DT")) < born)
    return rules


def beneficiary_findings(df: DataFrame, file: str, today: str) -> DataFrame:
    rules = beneficiary_rules(df, today)
    repeated = repeated_keys(df, ["BENE_ID"]).agg(F.count(F.lit(1)).alias("affected"))
    return _merge(
        [
            count_findings(failing_records(df, rules, ["BENE_ID"]), rules),
            one_finding(repeated, "Referential Integrity", "duplicate_bene_id", "quarantine"),
        ],
        file,
    )


# -- concordance with enrollment ---------------------------------------------


def concordance_counts(claims: DataFrame, beneficiaries: DataFrame) -> DataFrame:
    """Claim rows that contradict the enrolled person's dates."""
    enrolled = first_per_key(
        prepare_beneficiaries(beneficiaries).select(
            "BENE_ID",
            F.col(_date("BENE_BIRTH_DT")).alias("born"),
            F.col(_date("BENE_DEATH_DT")).alias("died"),
            number("BENE_ENROLLMT_REF_YR").cast("int").alias("enrolled_year"),
        ),
        ["BENE_ID"],
        ["born", "died", "enrolled_year"],
    )
    rows = all_text(claims).select("BENE_ID", parse_date("CLM_FROM_DT").alias("served"))
    joined = rows.join(enrolled, "BENE_ID")
    age = age_years(F.col("born").cast("timestamp"), F.col("served").cast("timestamp"))
    masks = {
        ("service_after_death_date", "quarantine"): F.col("served") > F.col("died"),
        ("claim_year_vs_enrollment_year", "flag"): F.year("served") != F.col("enrolled_year"),
        ("claim_age_vs_birth_date_mismatch", "quarantine"): (age < 0) | (age > 115),
    }
    wide = joined.agg(*[F.count(F.when(m, 1)).alias(n) for (n, _), m in masks.items()])
    entries = [
        F.struct(
            F.lit("Concordance").alias("dimension"),
            F.lit(n).alias("rule"),
            F.lit(a).alias("action"),
            F.col(n).alias("violation_rows"),
        )
        for n, a in masks
    ]
    return wide.select(F.explode(F.array(*entries)).alias("f")).select("f.*")


# -- scores and summaries ------------------------------------------------------


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("total_records")).withColumn("file", F.lit(name))
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dimension_scores(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """Six scores per file: 1 - affected share, with weight and contribution."""
    weights = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight")) for d, w in WEIGHTS.items()]
    )
    grid = counts.select("file", "total_records", F.explode(weights).alias("w")).select(
        "file", "total_records", "w.*"
    )
    by_dimension = findings.filter("rule is null").select("file", "dimension", "affected")
    rows = grid.join(by_dimension, ["file", "dimension"], "left").withColumn(
        "affected", F.coalesce("affected", F.lit(0))
    )
    share = F.col("affected") / F.nullif(F.col("total_records"), F.lit(0))
    empty = F.when(F.col("affected") == 0, 1.0).otherwise(0.0)
    score = F.coalesce(clip(F.lit(1.0) - share, 0.0, 1.0), empty)
    return rows.withColumn("score", score).withColumns(
        {
            "contribution": F.col("score") * F.col("weight"),
            "affected_pct": half_even(F.coalesce(share * 100, F.lit(0.0)), 4),
        }
    )


def weighted_scores(scores: DataFrame) -> DataFrame:
    """Quality (0-10) and risk (10 - quality) per file."""
    return scores.groupBy("file").agg(
        F.max("total_records").alias("total_records"),
        half_even(F.sum("contribution") * 10.0, 4).alias("quality_score"),
    ).withColumn("risk_score", half_even(10.0 - F.col("quality_score"), 4))


def file_summary(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """Totals, violated rules by severity, pass rate and PASS/FAIL per file."""
    rules = findings.filter("rule is not null").withColumn("severity", severity_of(F.col("action")))

    def having(level):
        return F.count(F.when(F.col("severity") == level, 1)).alias(f"{level}_count")

    per_file = rules.groupBy("file").agg(
        F.count("rule").alias("total_rules_checked"),
        F.sum("affected").alias("total_violations"),
        *[having(s) for s in ("critical", "high", "warning", "info")],
    )
    number_columns = [c for c in per_file.columns if c != "file"]
    rows = counts.join(per_file, "file", "left").fillna(0, number_columns)
    total, bad = F.col("total_records"), F.col("total_violations")
    rows = rows.withColumn("failed_records", F.when(total > 0, F.least(bad, total)).otherwise(bad))
    rows = rows.withColumn(
        "passed_records", F.greatest(total - F.col("failed_records"), F.lit(0))
    )
    return rows.withColumns(
        {
            "pass_rate": half_even(F.col("passed_records") / F.nullif(total, F.lit(0)) * 100, 2),
            "overall_status": F.when(bad == 0, "PASS").otherwise("FAIL"),
        }
    )


def explain(rule: Column, dimension: Column) -> tuple[Column, Column]:
    """Root cause and recommendation of a failed rule."""
    out = []
    for i in (0, 1):
        default = F.lit(M.RULE_DEFAULT[i])
        for name, text in M.DIMENSION_TEXT.items():
            default = F.when(dimension == name, F.lit(text[i])).otherwise(default)
        out.append(first_match(rule, [(p, t[i]) for p, t in M.RULE_TEXT], default))
    return out[0], out[1]


# -- providers -------------------------------------------------------------------


def _provider_rows(df: DataFrame, npi: str) -> DataFrame:
    return df.withColumn("npi", F.trim(F.col(npi))).filter(~is_blank(npi))


def provider_completeness(df: DataFrame, npi: str, file: str) -> DataFrame:
    """Distinct incomplete records per provider and field, zeros included."""
    fields = existing(df, [*REQUIRED, *NPI_FIELDS])
    rules = [Rule("Completeness", f"missing_{c}", "quarantine", is_blank(c)) for c in fields]
    rows = _provider_rows(df, npi)
    keys = ["npi", *CLAIM_KEY, *existing(df, LINE_COLUMNS)]
    joined = (
        count_findings(all_records(rows, rules, keys, ["npi"]), rules, ["npi"], "npi_total_rows")
        .filter("rule is not null")
        .select("npi", "rule", "npi_total_rows", "affected")
    )
    return _provider_score(joined, file).withColumns(
        {
            "dimension": F.lit("Completeness"),
            "field_name": F.expr("substring(rule_name, length('missing_') + 1)"),
            "npi_completeness_score": F.col("npi_dimension_score"),
        }
    )


def provider_dimensions(df: DataFrame, npi: str, file: str) -> DataFrame:
    """Distinct affected records per provider for the dimensions besides completeness."""
    rules = [r for r in claim_rules(df) if r.dimension != "Completeness"]
    rows = _provider_rows(df, npi)
    affected = (
        count_findings(failing_records(rows, rules, ["npi", *CLAIM_KEY]), rules, ["npi"])
        .filter("rule is null")
        .select("npi", "dimension", "affected")
    )
    repeated = (
        _provider_rows(mark_repeated(df, line_key(df), DUPLICATE), npi)
        .filter(DUPLICATE)
        .select("npi", *line_key(df))
        .distinct()
        .groupBy("npi")
        .agg(F.count(F.lit(1)).alias("affected"))
        .select("npi", F.lit("Referential Integrity").alias("dimension"), "affected")
    )
    affected = (
        affected.unionByName(repeated)
        .groupBy("npi", "dimension")
        .agg(F.sum("affected").alias("affected"))
    )
    names = F.array(*[F.lit(d) for d in WEIGHTS if d != "Completeness"])
    grid = rows.groupBy("npi").agg(F.count(F.lit(1)).alias("npi_total_rows")).select(
        "npi", "npi_total_rows", F.explode(names).alias("dimension")
    )
    joined = grid.join(affected, ["npi", "dimension"], "left").withColumn(
        "rule", F.lit(None).cast("string")
    )
    return _provider_score(joined, file)


def _provider_score(joined: DataFrame, file: str) -> DataFrame:
    affected = F.coalesce(F.col("affected"), F.lit(0))
    pct = half_even(affected / F.col("npi_total_rows") * 100, 4)
    return (
        joined.withColumns({"npi_affected_rows": affected, "npi_affected_pct": pct})
        .withColumn(
            "npi_dimension_score", half_even(clip(100.0 - F.col("npi_affected_pct"), 0.0, 100.0), 4)
        )
        .withColumns(
            {
                "dataset_name": F.lit(file),
                "rule_name": F.col("rule"),
                "overall_status": F.when(F.col("npi_affected_rows") > 0, "FAIL").otherwise("SUCCESS"),
                "severity": F.when(F.col("npi_affected_rows") > 0, "critical").otherwise("info"),
            }
        )
        .drop("affected", "rule")
    )


# -- whole run --------------------------------------------------------------------


class QualityRun:
    """All result frames of one data-quality run, each planned when first asked for."""

    def __init__(
        self,
        claims: dict[str, DataFrame],
        beneficiaries: DataFrame,
        today: str,
        providers: dict[str, str] = PROVIDER_COLUMNS,
        beneficiary_file: str = "beneficiary",
        **run_fields,
    ):
        self.people = prepare_beneficiaries(beneficiaries)
        self.raw = {**claims, beneficiary_file: beneficiaries}
        self.frames = {name: prepare(df, self.people) for name, df in claims.items()}
        self.today, self.provider_columns = today, providers
        self.beneficiary_file, self.run_fields = beneficiary_file, run_fields

    @cached_property
    def findings(self) -> DataFrame:
        parts = [claim_findings(df, name) for name, df in self.frames.items()]
        parts.append(beneficiary_findings(self.people, self.beneficiary_file, self.today))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def counts(self) -> DataFrame:
        return row_counts(self.raw)

    @cached_property
    def scores(self) -> DataFrame:
        return dimension_scores(self.findings, self.counts)

    @cached_property
    def summary(self) -> DataFrame:
        quality = weighted_scores(self.scores).select("file", "quality_score", "risk_score")
        return file_summary(self.findings, self.counts).join(quality, "file")

    @cached_property
    def providers(self) -> DataFrame | None:
        parts = [
            part(df, self.provider_columns[name], name)
            for name, df in self.frames.items()
            if self.provider_columns.get(name) in df.columns
            for part in (provider_completeness, provider_dimensions)
        ]
        if not parts:
            return None
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    @cached_property
    def run_table(self) -> DataFrame:
        return run_table(
            self.findings, self.summary, self.scores, self.providers, **self.run_fields
        )


def validation_rows(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per violated rule with its file's totals; clean files get one row."""
    rules = findings.filter("rule is not null")
    rows = summary.join(rules, "file", "left")
    cause, action = explain(F.col("rule"), F.col("dimension"))
    broken = F.col("rule").isNotNull()
    text = fill(
        "{} row(s) failed rule '{}' ({}) — action: {}",
        F.col("affected"),
        F.col("rule"),
        F.col("dimension"),
        F.col("action"),
    )
    return rows.withColumns(
        {
            "dataset_name": F.col("file"),
            "records_processed": F.col("total_records"),
            "field_name": F.col("rule"),
            "rule_name": F.col("rule"),
            "affected_rows": F.coalesce("affected", F.lit(0)),
            "affected_pct": half_even(
                F.coalesce("affected", F.lit(0)) / F.nullif(F.col("total_records"), F.lit(0)) * 100, 4
            ),
            "severity": severity_of(F.coalesce("action", F.lit(""))),
            "message": F.when(broken, text).otherwise("No violations found."),
            "root_cause": F.when(broken, cause),
            "recommendation": F.when(broken, action),
        }
    )


def run_table(findings, summary, scores, provider_rows, **run_fields) -> DataFrame:
    """Rule, score and provider rows under the one run-table schema."""
    weighted = fill(
        "Weight={}; dimension_score={}; weighted_contribution={}",
        fixed("weight", 2),
        fixed("score", 4),
        fixed("contribution", 4),
    )
    dims = scores.withColumns(
        {
            "dataset_name": F.col("file"),
            "affected_rows": F.col("affected"),
            "severity": F.lit("info"),
            "message": weighted,
            "overall_status": F.lit("CALCULATED"),
        }
    )
    parts = [
        run_rows(
            validation_rows(findings, summary), step_name="dq_validation", status="SUCCESS", **run_fields
        ),
        run_rows(dims, step_name="weighted_dimension_score", status="SUCCESS", **run_fields),
        run_rows(
            summary.withColumn("dataset_name", F.col("file")).select(
                "dataset_name", "total_records", "quality_score"
            ),
            step_name="weighted_sla_score",
            status="SUCCESS",
            dimension="ALL_6_DIMENSIONS",
            severity="info",
            overall_status="CALCULATED",
            **run_fields,
        ),
    ]
    if provider_rows is not None:
        step = F.when(F.col("dimension") == "Completeness", "provider_completeness").otherwise(
            "provider_dq_dimension"
        )
        cause, action = explain(
            F.coalesce("rule_name", F.lower("dimension")), F.col("dimension")
        )
        bad = F.col("npi_affected_rows") > 0
        rows = provider_rows.withColumns(
            {
                "step_name": step,
                "status": F.when(bad, "FAIL").otherwise("SUCCESS"),
                "affected_rows": F.col("npi_affected_rows"),
                "affected_pct": F.col("npi_affected_pct"),
                "root_cause": F.when(bad, cause),
                "recommendation": F.when(bad, action),
                "total_records": F.col("npi_total_rows"),
            }
        )
        parts.append(run_rows(rows, **run_fields))
    return reduce(DataFrame.unionByName, parts)


def claim_evidence(df: DataFrame, file: str) -> DataFrame:
    """Failing rows per rule with their key, including repeated line keys."""
    rules = claim_rules(df)
    keys = line_key(df)
    repeated = Rule(
        "Referential Integrity",
        "duplicate_claim_line_key",
        "quarantine_pend_before_payment",
        F.col(DUPLICATE),
    )
    return evidence_rows(mark_repeated(df, keys, DUPLICATE), [*rules, repeated], file, keys)


def checked_dimensions(df: DataFrame) -> list[str]:
    return dimensions_of(claim_rules(df))


def ingestion_report(claims: DataFrame, keys: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """Rows, incomplete and repeated keys, bad dates and negative payments in one pass."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])

    def count_if(c):
        return F.count(F.when(c, 1))

    checks = [F.count(F.lit(1)).alias("rows"), count_if(any_null).alias("null_pk_rows")]
    if "CLM_PMT_AMT" in claims.columns:
        checks.append(count_if(F.col("CLM_PMT_AMT") < 0).alias("negative_clm_pmt_amt"))
    if {"CLM_FROM_DT", "CLM_THRU_DT"} <= set(claims.columns):
        before = F.col("CLM_THRU_DT") < F.col("CLM_FROM_DT")
        checks.append(count_if(before).alias("thru_before_from"))
    checks += [count_if(F.col(d).isNull()).alias(f"unparseable_{d}") for d in dates]
    # NULL parts equal each other here, so keys are counted from a grouping.
    per_key = claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    distinct = per_key.agg(F.count(F.lit(1))).scalar()
    report = claims.agg(*checks)
    return report.withColumn("duplicate_pk_rows", F.col("rows") - distinct)


def orphan_ids(claims: DataFrame, master: DataFrame, key: str = "BENE_ID") -> DataFrame:
    """Distinct non-NULL ids of the claims that the master lacks."""
    ids = claims.select(key).filter(F.col(key).isNotNull()).distinct()
    return ids.join(master.select(key).distinct(), key, "left_anti")


def flag_values_outside(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Values other than Y and N per flag column, with their counts."""
    entries = [
        F.struct(F.lit(c).alias("column"), text_or_empty(c).alias("value")) for c in flags
    ]
    long = df.select(F.explode(F.array(*entries)).alias("f")).select("f.*")
    return (
        long.filter(~F.upper(F.trim("value")).isin("Y", "N"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
