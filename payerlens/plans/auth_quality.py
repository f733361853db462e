"""Authorization data quality: a score per record, rule totals, provider scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.functions import messages as M
from payerlens.functions.bands import AUTH_CATEGORY
from payerlens.functions.clean import clip, half_even, npi_digits
from payerlens.functions.dates import days_between
from payerlens.functions.text import fill, joined
from payerlens.operators.contracts import require_columns
from payerlens.operators.keyed import mark_repeated
from payerlens.operators.rules import failed
from payerlens.sources.sinks import run_rows

# Fixed values.
COLUMNS = (
    "authorization_id",
    "bene_id",
    "provider_id",
    "service_code",
    "request_date",
    "approval_date",
    "status",
    "expiry_date",
    "urgency",
    "batch_id",
)
STATUSES = ("Approved", "Denied", "Pending", "Expired", "Cancelled")
URGENCIES = ("Routine", "Urgent", "Emergency")
PENDING_DAYS = 7
SEVERITIES = ("Good", "Low", "Medium", "High", "Critical")
UNKNOWN_PROVIDER = "MISSING_PROVIDER_NPI"
BUSINESS_KEY = ("bene_id", "provider_id", "service_code", "request_date")


@dataclass(frozen=True)
class AuthRule:
    name: str
    dimension: str
    deduction: int
    severity: str
    cause: str
    action: str
    mask: Column


def standardized(auth: DataFrame) -> DataFrame:
    """Trimmed texts, provider ids without a float tail, dates as timestamps."""
    texts = ("authorization_id", "bene_id", "service_code", "status", "urgency", "batch_id")
    dates = ("request_date", "approval_date", "expiry_date")
    df = require_columns(auth, COLUMNS)
    return df.withColumns(
        {c: F.trim(F.col(c).cast("string")) for c in texts}
        | {"provider_id": npi_digits("provider_id")}
        | {c: F.col(c).try_cast("timestamp") for c in dates}
    )


def rules(today: str) -> list[AuthRule]:
    """The sixteen record rules. Needs the two repeat flags of :func:`flagged`."""

    def missing(c):
        return F.col(c).isNull() | (F.col(c) == "")

    asked, approved, expires = (
        F.col(c) for c in ("request_date", "approval_date", "expiry_date")
    )
    status, urgency = F.col("status"), F.col("urgency")
    provider = F.coalesce("provider_id", F.lit(""))
    waiting = days_between(asked, F.lit(today).cast("timestamp")) > PENDING_DAYS
    # Name, dimension, deduction, severity, cause and action of each rule.
    return [
        AuthRule("Missing Authorization ID", "Completeness", 30, "Critical", "Authorization ID is missing", "Populate a valid unique authorization ID", missing("authorization_id")),
        AuthRule("Missing Beneficiary ID", "Completeness", 15, "Critical", "Beneficiary ID is missing", "Populate a valid beneficiary ID", missing("bene_id")),
        AuthRule("Missing Provider NPI", "Completeness", 15, "Critical", "Provider NPI is missing", "Populate a valid provider NPI", missing("provider_id")),
        AuthRule("Invalid Provider NPI Format", "Validity", 25, "Critical", "Provider NPI is not exactly 10 numeric digits", "Correct provider_id using a valid 10-digit NPI", (provider != "") & ~provider.rlike(r"^\d{10}$")),
        AuthRule("Missing Service Code", "Completeness", 15, "High", "Service code is missing", "Populate a valid service code", missing("service_code")),
        AuthRule("Missing or Invalid Request Date", "Completeness", 15, "High", "Request date is missing or invalid", "Provide a valid authorization request date", asked.isNull()),
        AuthRule("Invalid Authorization Status", "Validity", 15, "High", "Status is outside the allowed authorization status values", "Use Approved, Denied, Pending, Expired, or Cancelled", ~status.isin(*STATUSES)),
        AuthRule("Invalid Urgency", "Validity", 10, "Medium", "Urgency value is invalid", "Use Routine, Urgent, or Emergency", ~urgency.isin(*URGENCIES)),
        AuthRule("Approval Before Request", "Consistency", 20, "Critical", "Approval date occurs before request date", "Correct the authorization timestamps", approved < asked),
        AuthRule("Expiry Before Approval", "Consistency", 20, "Critical", "Expiry date occurs before approval date", "Correct the approval and expiry dates", expires < approved),
        AuthRule("Approved Without Approval Date", "Consistency", 20, "Critical", "Authorization is Approved but approval date is missing", "Populate approval date or correct authorization status", (status == "Approved") & approved.isNull()),
        AuthRule("Expired Without Expiry Date", "Consistency", 20, "Critical", "Authorization is Expired but expiry date is missing", "Populate expiry date or correct authorization status", (status == "Expired") & expires.isNull()),
        AuthRule("Pending With Approval Date", "Consistency", 15, "High", "Authorization is Pending even though an approval date exists", "Review authorization status and approval information", (status == "Pending") & approved.isNotNull()),
        AuthRule("Duplicate Authorization ID", "Uniqueness", 25, "Critical", "Authorization ID appears more than once", "Investigate and remove unintended duplicate records", F.col("authorization_id").isNotNull() & F.col("__same_id")),
        AuthRule("Duplicate Authorization Business Record", "Uniqueness", 20, "High", "Same beneficiary, provider, service and request date occur multiple times", "Review the records and remove unintended duplicates", reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in BUSINESS_KEY]) & F.col("__same_business")),
        AuthRule("Pending Beyond SLA", "Timeliness", 15, "High", "Authorization has remained Pending beyond the configured SLA", "Review and process the pending authorization", (status == "Pending") & waiting),
    ]


def flagged(auth: DataFrame) -> DataFrame:
    df = mark_repeated(standardized(auth), ["authorization_id"], "__same_id")
    return mark_repeated(df, list(BUSINESS_KEY), "__same_business")


def _rank(severity: str) -> int:
    return SEVERITIES.index(severity)


def _severity(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def scored_records(auth: DataFrame, today: str) -> DataFrame:
    """Every record with its score, category, failed rules and worst severity."""
    all_rules = rules(today)
    bits = {f"__m{i}": failed(r.mask) for i, r in enumerate(all_rules)}
    df = flagged(auth).withColumns(bits)
    broken = [F.col(b) for b in bits]
    lost = reduce(
        lambda a, b: a + b,
        [F.when(m, float(r.deduction)).otherwise(0.0) for m, r in zip(broken, all_rules)],
    )
    worst = F.greatest(
        F.lit(0), *[F.when(m, _rank(r.severity)).otherwise(0) for m, r in zip(broken, all_rules)]
    )

    def texts(field):
        return joined([F.when(m, getattr(r, field)) for m, r in zip(broken, all_rules)], "; ")

    clean = reduce(lambda a, b: a & b, [~m for m in broken])
    none, no_cause, no_action = M.AUTH_CLEAN
    return df.withColumns(
        {
            "quality_score": half_even(clip(100.0 - lost, 0.0, 100.0), 2),
            "failed_rules": F.when(clean, none).otherwise(texts("name")),
            "root_cause": F.when(clean, no_cause).otherwise(texts("cause")),
            "recommendation": F.when(clean, no_action).otherwise(texts("action")),
            "severity": _severity(worst),
        }
    ).withColumn("quality_category", AUTH_CATEGORY("quality_score"))


def public(records: DataFrame) -> DataFrame:
    """Without the working columns."""
    return records.drop(*[c for c in records.columns if c.startswith("__")])


def rule_results(records: DataFrame, today: str) -> DataFrame:
    """Failed records and rate per rule, all rules listed."""
    all_rules = rules(today)
    wide = records.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count(F.when(F.col(f"__m{i}"), 1)).alias(f"r{i}") for i in range(len(all_rules))],
    )
    entries = [
        F.struct(
            F.lit(r.name).alias("rule_name"),
            F.lit(r.dimension).alias("dq_dimension"),
            F.col(f"r{i}").alias("failed_records"),
            F.lit(r.severity).alias("severity"),
        )
        for i, r in enumerate(all_rules)
    ]
    rate = half_even(F.col("failed_records") / F.col("total_records") * 100, 2)
    return (
        wide.select("total_records", F.explode(F.array(*entries)).alias("r"))
        .select("total_records", "r.*")
        .withColumn("failure_rate_pct", rate)
    )


def _merged_texts(
    all_rules: Sequence[AuthRule], field: str, clean_text: str, order: Sequence[str]
) -> Column:
    """Aggregate: distinct texts in the order they first appear in a group.

    Only the first position of each of the sixteen texts is kept, never the
    group's rows.
    """
    position = F.struct(*order)
    clean = reduce(lambda a, b: a & b, [~F.col(f"__m{i}") for i in range(len(all_rules))])
    firsts = [
        (F.min(F.when(F.col(f"__m{i}"), position)), i, getattr(r, field))
        for i, r in enumerate(all_rules)
    ]
    firsts.append((F.min(F.when(clean, position)), len(all_rules), clean_text))
    entries = F.array(
        *[
            F.struct(at.alias("at"), F.lit(i).alias("i"), F.lit(text).alias("text"))
            for at, i, text in firsts
        ]
    )
    seen = F.array_sort(F.filter(entries, lambda e: e["at"].isNotNull()))
    return F.array_join(F.transform(seen, lambda e: e["text"]), "; ")


def provider_scores(
    records: DataFrame, today: str, order: Sequence[str] = ("authorization_id", "request_date")
) -> DataFrame:
    """Mean score, failures, worst severity and merged texts per provider.

    Texts are listed in the order of the records, given by ``order``.
    """
    all_rules = rules(today)
    none, no_cause, no_action = M.AUTH_CLEAN
    provider = F.coalesce(F.nullif(F.col("provider_id"), F.lit("")), F.lit(UNKNOWN_PROVIDER))
    worst = F.max(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")) - 1)
    grouped = records.groupBy(provider.alias("__provider")).agg(
        F.count(F.lit(1)).alias("total_authorizations"),
        F.count(F.when(F.col("failed_rules") != none, 1)).alias("failed_authorizations"),
        half_even(F.avg("quality_score"), 2).alias("provider_quality_score"),
        worst.cast("int").alias("worst"),
        _merged_texts(all_rules, "name", none, order).alias("failed_rules"),
        _merged_texts(all_rules, "cause", no_cause, order).alias("root_cause"),
        _merged_texts(all_rules, "action", no_action, order).alias("recommendation"),
    )
    rate = F.col("failed_authorizations") / F.col("total_authorizations") * 100
    return grouped.select(
        F.col("__provider").alias("provider_id"),
        "total_authorizations",
        "failed_authorizations",
        "provider_quality_score",
        half_even(rate, 2).alias("dq_failure_rate_pct"),
        AUTH_CATEGORY("provider_quality_score").alias("quality_category"),
        _severity(F.col("worst")).alias("severity"),
        "failed_rules",
        "root_cause",
        "recommendation",
    )


def run_table(providers: DataFrame, results: DataFrame, rule_count: int, **run_fields) -> DataFrame:
    """Provider and rule rows under the one run-table schema."""
    bad, total = F.col("failed_authorizations"), F.col("total_authorizations")

    def one_if(level):
        return (F.col("severity") == level).cast("int")

    by_provider = providers.withColumns(
        {
            "records_processed": total,
            "affected_rows": bad,
            "affected_pct": F.col("dq_failure_rate_pct"),
            "message": fill(
                "Provider {}: {} failed authorization(s) out of {}; provider quality score = {}",
                F.col("provider_id"),
                bad,
                total,
                F.col("provider_quality_score"),
            ),
            "total_records": total,
            "passed_records": total - bad,
            "failed_records": bad,
            "total_violations": bad,
            "critical_count": one_if("Critical"),
            "high_count": one_if("High"),
            "warning_count": one_if("Medium"),
            "info_count": one_if("Good"),
            "quality_score": F.col("provider_quality_score"),
            "overall_status": F.when(bad > 0, "FAIL").otherwise("SUCCESS"),
            "npi": F.col("provider_id"),
            "npi_total_rows": total,
            "npi_affected_rows": bad,
            "npi_affected_pct": F.col("dq_failure_rate_pct"),
            "npi_dimension_score": F.col("provider_quality_score"),
        }
    )
    hit = F.col("failed_records") > 0

    def hit_and(level):
        return (hit & (F.col("severity") == level)).cast("int")

    by_rule = results.withColumns(
        {
            "dimension": F.col("dq_dimension"),
            "records_processed": F.col("total_records"),
            "affected_rows": F.col("failed_records"),
            "affected_pct": F.col("failure_rate_pct"),
            "message": fill(
                "Rule {}: {} affected row(s) out of {}",
                F.col("rule_name"),
                F.col("failed_records"),
                F.col("total_records"),
            ),
            "passed_records": F.col("total_records") - F.col("failed_records"),
            "total_violations": F.col("failed_records"),
            "critical_count": hit_and("Critical"),
            "high_count": hit_and("High"),
            "warning_count": hit_and("Medium"),
            "info_count": (~hit).cast("int"),
            "overall_status": F.when(hit, "FAIL").otherwise("SUCCESS"),
        }
    )
    common = {"status": "SUCCESS", "dataset_name": "authorization_dataset", **run_fields}
    return run_rows(
        by_provider,
        step_name="authorization_provider_dq",
        dimension="ALL_DQ_DIMENSIONS",
        field_name="provider_id",
        rule_name="PROVIDER_DQ_SCORE",
        total_rules_checked=rule_count,
        **common,
    ).unionByName(
        run_rows(by_rule, step_name="authorization_dq_rule", total_rules_checked=1, **common)
    )


def auth_quality(auth: DataFrame, today: str, **run_fields) -> dict[str, DataFrame]:
    records = scored_records(auth, today)
    providers = provider_scores(records, today)
    results = rule_results(records, today)
    return {
        "records": public(records),
        "providers": providers,
        "rules": results,
        "dq_run_output": run_table(providers, results, len(rules(today)), **run_fields),
    }
