"""SLA compliance of runs and authorizations, and volume behaviour over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.functions import messages as M
from payerlens.functions.clean import number, trim_text
from payerlens.functions.dates import hours_between, month_key, normalize_period
from payerlens.functions.text import distinct_json, fill, fixed
from payerlens.operators import periods
from payerlens.operators.keyed import latest_per_key, null_safe_join

# Fixed values.
RUN_LIMIT_MINUTES = 60.0
CLAIM_MINOR_MINUTES = 3.0
MINOR_PCT = 5.0
AUTH_LIMIT_HOURS = 72.0
BEHAVIOR_PERIODS = 3
BEHAVIOR_LIMIT_PCT = 50.0
CLAIM_STEP = "run_claims_checks"
PHARMACY_STEP = "data_quality"
NO_PROVIDER = ("", "nan", "None", "<NA>")


def status_by_limit(value: Column, limit: float, minor_limit: float, minor_label: str) -> Column:
    """MET up to the limit, the minor label up to the minor limit, else BREACHED."""
    return (
        F.when(value.isNull(), "N/A")
        .when(value <= limit, "MET")
        .when(value <= minor_limit, minor_label)
        .otherwise("BREACHED")
    )


def preferred_steps(runs: DataFrame, step: str, contains: str | None = None) -> DataFrame:
    """Rows of the wanted step; without any, of steps like it; else all timed rows.

    One aggregate finds the best choice available, no job runs in between.
    """
    name = F.lower(F.col("step_name").cast("string"))
    timed = F.col("duration_seconds").isNotNull()
    like = F.coalesce(name.contains(contains), F.lit(False)) if contains else F.lit(False)
    choice = F.when(name == step, 3).when(timed & like, 2).when(timed, 1).otherwise(0)
    ranked = runs.withColumn("__choice", choice)
    best = ranked.agg(F.max("__choice")).scalar()
    return ranked.filter((F.col("__choice") == best) & (best > 0)).drop("__choice")


def run_compliance(
    runs: DataFrame,
    step: str = CLAIM_STEP,
    contains: str | None = "claim",
    limit: float = RUN_LIMIT_MINUTES,
    minor_limit: float = RUN_LIMIT_MINUTES + CLAIM_MINOR_MINUTES,
    minor_label: str = "MINOR_OVERRUN",
) -> DataFrame:
    """Last row of each run of the preferred step with its SLA status and run totals."""
    runs = runs.withColumn("duration_seconds", number("duration_seconds"))
    last = latest_per_key(
        preferred_steps(runs, step, contains), ["run_id"], ["started_at", "completed_at"]
    )
    minutes = F.col("duration_seconds") / 60.0
    rated = last.withColumns(
        {
            "processing_time_minutes": minutes,
            "sla_limit_minutes": F.lit(limit),
            "sla_status": status_by_limit(minutes, limit, minor_limit, minor_label),
        }
    )
    return rated.withColumns(compliance_totals(rated, minor_label, split_minor=False))


def claim_runs(runs: DataFrame) -> DataFrame:
    rated = run_compliance(runs)
    minutes, limit = F.col("processing_time_minutes"), F.col("sla_limit_minutes")
    over = fixed(minutes - limit, 2)
    causes = M.CLAIM_SLA_ROOT_CAUSE
    status = F.col("sla_status")
    return rated.withColumns(
        {
            "root_cause": F.when(status == "BREACHED", fill(causes["BREACHED"], over, fixed(limit, 2)))
            .when(status == "MINOR_OVERRUN", fill(causes["MINOR_OVERRUN"], over))
            .when(status == "MET", causes["MET"])
            .otherwise(causes["N/A"]),
            "recommendation": lookup(status, M.CLAIM_SLA_RECOMMENDATION),
        }
    )


def pharmacy_runs(runs: DataFrame) -> DataFrame:
    rated = run_compliance(
        runs,
        PHARMACY_STEP,
        None,
        minor_limit=RUN_LIMIT_MINUTES * (1 + MINOR_PCT / 100),
        minor_label="MINOR_BREACH",
    )
    cause, action = pharmacy_explanation(
        F.col("step_name"), F.col("status"), F.col("sla_status"), F.lit(None), F.lit(None)
    )
    late = F.col("sla_status").isin("MINOR_BREACH", "BREACHED")
    return rated.withColumns({"root_cause": F.when(late, cause), "recommendation": F.when(late, action)})


def lookup(key: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(key == name, F.lit(text)).otherwise(out)
    return out


def compliance_totals(rated: DataFrame, minor_label: str, split_minor: bool) -> dict[str, Column]:
    """Grand totals as columns; the share of MET among rows that could be judged."""
    status = F.col("sla_status")

    def count_of(*labels):
        return F.count(F.when(status.isin(*labels), 1))

    judged = ("MET", minor_label, "BREACHED")
    late = ("BREACHED",) if split_minor else (minor_label, "BREACHED")
    totals = rated.agg(
        F.struct(
            F.try_divide(count_of("MET").cast("double"), count_of(*judged)).alias("share"),
            count_of("MET").alias("met"),
            count_of(minor_label).alias("minor"),
            count_of(*late).alias("breached"),
            count_of(*judged).alias("judged"),
        ).alias("t")
    ).scalar()
    out = {
        "sla_compliance_percentage": totals["share"] * 100.0,
        "sla_met_count": totals["met"],
        "sla_breached_count": totals["breached"],
    }
    if split_minor:
        return out | {
            "sla_minor_breach_count": totals["minor"],
            "sla_evaluable_requests": totals["judged"],
        }
    return out | {"sla_evaluable_runs": totals["judged"]}


def behavior(
    series: DataFrame, volume: str, order: str, reasons: dict[str, str], baseline: str
) -> DataFrame:
    """Status of each period against the mean of the three before it.

    ``series`` holds one row per calendar period, so its window needs one task.
    A positive volume after an all-zero baseline is anomalous with no deviation.
    """
    base, now = F.col(baseline), F.col(volume).cast("double")
    rows = series.withColumn(
        baseline, periods.previous_mean(volume, [], order, BEHAVIOR_PERIODS)
    ).withColumn(
        "behavior_deviation_pct",
        F.when((base == 0) & (now == 0), 0.0).when(base != 0, F.abs(now - base) / base * 100.0),
    )
    dev = F.col("behavior_deviation_pct")
    direction = F.when(now > base, "increased").otherwise("decreased")
    return rows.withColumns(
        {
            "behavior_status": F.when(base.isNull(), "N/A")
            .when(dev.isNull() | (dev > BEHAVIOR_LIMIT_PCT), "ANOMALOUS")
            .otherwise("NORMAL"),
            "behavior_reason": F.when(base.isNull(), reasons["short"])
            .when((base == 0) & (now == 0), reasons["zero"])
            .when(base == 0, reasons["from_zero"])
            .when(dev > BEHAVIOR_LIMIT_PCT, fill(reasons["changed"], direction, fixed(dev, 2)))
            .otherwise(reasons["normal"]),
        }
    )


def claim_period_volume(volume_risk: DataFrame) -> DataFrame:
    """Volume, providers and risk per period of a volume risk (or history) table."""
    rows = volume_risk.withColumns(
        {
            "current_period": normalize_period("current_period"),
            "current_month_volume": number("current_month_volume"),
            "volume_risk": number("volume_risk"),
        }
    ).filter(F.col("current_period").isNotNull())
    return rows.groupBy("current_period").agg(
        F.coalesce(F.sum("current_month_volume"), F.lit(0.0)).alias("total_claim_volume"),
        F.countDistinct("NPI").alias("provider_count"),
        F.avg("volume_risk").alias("average_volume_risk"),
        F.max("volume_risk").alias("maximum_volume_risk"),
        F.count("NPI").alias("provider_rows"),
    )


def claim_behavior(volume_risk: DataFrame) -> DataFrame:
    filled = periods.fill_months(
        claim_period_volume(volume_risk),
        [],
        "current_period",
        ["total_claim_volume", "provider_count"],
    )
    rows = behavior(
        filled,
        "total_claim_volume",
        "current_period",
        M.BEHAVIOR_REASONS["CLAIM"],
        "behavior_baseline_volume",
    )
    status, now, base = (
        F.col(c) for c in ("behavior_status", "total_claim_volume", "behavior_baseline_volume")
    )
    text, dev = M.CLAIM_BEHAVIOR, F.col("behavior_deviation_pct")
    direction = F.when(now > base, "increased").otherwise("decreased")
    detail = fill(text["root_cause"], direction, fixed(now, 2), fixed(base, 2), fixed(dev, 2))
    return rows.withColumns(
        {
            "root_cause": F.when(
                status == "ANOMALOUS", F.when(dev.isNotNull(), detail).otherwise(F.col("behavior_reason"))
            )
            .when(status == "NORMAL", text["normal_cause"])
            .otherwise(text["na_cause"]),
            "recommendation": F.when((status == "ANOMALOUS") & (now > base), text["up"])
            .when(status == "ANOMALOUS", text["down"])
            .when(status == "NORMAL", text["normal_action"])
            .otherwise(text["na_action"]),
        }
    )


def pharmacy_explanation(step, status, sla, behavior_status, reason) -> tuple[Column, Column]:
    """Failure before breach before minor breach before anomaly before none."""

    def clean(c):
        return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))

    step = F.trim(F.coalesce(step.cast("string"), F.lit("")))
    failed = clean(status).isin("FAILED", "FAIL", "ERROR")
    anomaly = clean(behavior_status) == "ANOMALOUS"
    out = []
    for i in (0, 1):
        why = (
            fill(M.PHARMACY_ANOMALOUS[i], F.coalesce(reason.cast("string"), F.lit("")))
            if "{}" in M.PHARMACY_ANOMALOUS[i]
            else F.lit(M.PHARMACY_ANOMALOUS[i])
        )
        out.append(
            F.when(failed, fill(M.PHARMACY_FAILED[i], step))
            .when(clean(sla) == "BREACHED", M.PHARMACY_BREACHED[i])
            .when(clean(sla) == "MINOR_BREACH", M.PHARMACY_MINOR[i])
            .when(anomaly, why)
            .otherwise(M.PHARMACY_NONE[i])
        )
    return out[0], out[1]


def pharmacy_behavior(annual: DataFrame) -> DataFrame:
    """Annual claims against the three years before; ``annual`` is the yearly risk table."""
    zeros = [
        "total_claims",
        "total_standardized_30_day_fills",
        "total_beneficiaries",
        "total_prescribers",
    ]
    yearly = annual.select(
        F.col("calendar_year").cast("int").alias("calendar_year"),
        *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in zeros],
        number("final_volume_risk_score").alias("final_volume_risk_score"),
        "volume_risk_level",
    ).filter(F.col("calendar_year").isNotNull())
    filled = periods.fill_years(
        latest_per_key(yearly, ["calendar_year"], ["total_claims"]), [], "calendar_year", zeros
    ).withColumn("volume_risk_level", F.coalesce("volume_risk_level", F.lit("N/A")))
    rows = behavior(
        filled,
        "total_claims",
        "calendar_year",
        M.BEHAVIOR_REASONS["PHARMACY"],
        "behavior_baseline_claims",
    )
    none = F.lit(None)
    cause, action = pharmacy_explanation(
        none, none, none, F.col("behavior_status"), F.col("behavior_reason")
    )
    return rows.withColumns({"root_cause": cause, "recommendation": action})


# -- authorizations -------------------------------------------------------------


def auth_requests(auth: DataFrame) -> DataFrame:
    """Every request with turnaround hours, SLA status, totals and explanation."""
    hours = hours_between("request_date", "approval_date")
    rows = auth.withColumn("turnaround_hours", hours)
    usable = F.when(F.col("turnaround_hours") >= 0, F.col("turnaround_hours"))
    limit = AUTH_LIMIT_HOURS * (1 + MINOR_PCT / 100)
    rated = rows.withColumn(
        "sla_status", status_by_limit(usable, AUTH_LIMIT_HOURS, limit, "MINOR_BREACH")
    )
    rated = rated.withColumns(compliance_totals(rated, "MINOR_BREACH", split_minor=True))
    over = F.col("turnaround_hours") - AUTH_LIMIT_HOURS
    status = F.col("sla_status")
    late = status.isin("MINOR_BREACH", "BREACHED")
    causes = M.AUTH_SLA_ROOT_CAUSE
    return rated.withColumns(
        {
            "excess_hours": F.when(late, over).otherwise(0.0),
            "severity": F.when(status == "BREACHED", "critical")
            .when(status == "MINOR_BREACH", "warning")
            .otherwise("info"),
            "root_cause": F.when(status == "BREACHED", fill(causes["BREACHED"], fixed(over, 2))).when(
                status == "MINOR_BREACH", fill(causes["MINOR_BREACH"], fixed(over, 2))
            ),
            "recommendation": lookup(status, M.AUTH_SLA_RECOMMENDATION),
        }
    )


AUTH_COUNTS = (
    "authorization_count",
    "unique_beneficiaries",
    "unique_providers",
    "unique_services",
    "urgent_count",
)


def auth_months(auth: DataFrame) -> DataFrame:
    """Authorizations, distinct parties and urgent requests per request month."""
    urgent = F.lower(F.trim(F.coalesce(F.col("urgency").cast("string"), F.lit("")))) == "urgent"
    return (
        auth.filter(F.col("request_date").isNotNull())
        .groupBy(month_key("request_date").alias("request_month"))
        .agg(
            F.count("authorization_id").alias(AUTH_COUNTS[0]),
            F.countDistinct("bene_id").alias(AUTH_COUNTS[1]),
            F.countDistinct("provider_id").alias(AUTH_COUNTS[2]),
            F.countDistinct("service_code").alias(AUTH_COUNTS[3]),
            F.sum(urgent.cast("int")).alias(AUTH_COUNTS[4]),
        )
    )


def auth_behavior(auth: DataFrame) -> DataFrame:
    filled = periods.fill_months(auth_months(auth), [], "request_month", AUTH_COUNTS)
    rows = behavior(
        filled,
        "authorization_count",
        "request_month",
        M.BEHAVIOR_REASONS["AUTH"],
        "behavior_baseline_volume",
    )
    now, base = F.col("authorization_count"), F.col("behavior_baseline_volume")
    odd = F.col("behavior_status") == "ANOMALOUS"
    direction = F.when(now > base, "increased").otherwise("decreased")
    text = M.AUTH_BEHAVIOR
    deviation = F.coalesce(fixed("behavior_deviation_pct", 2), F.lit("inf"))
    return rows.withColumns(
        {
            "root_cause": F.when(
                odd, fill(text["root_cause"], direction, fixed(now, 0), fixed(base, 2), deviation)
            ),
            "recommendation": F.when(odd & (now > base), text["up"]).when(odd, text["down"]),
        }
    )


def provider_key(c: str) -> Column:
    text = trim_text(c)
    return F.when(~text.isin(*NO_PROVIDER), text)


def auth_provider_metrics(requests: DataFrame) -> DataFrame:
    """Requests, late requests and completeness per provider; unknown ones are a group."""
    late = F.col("sla_status").isin("MINOR_BREACH", "BREACHED").cast("int")
    grouped = requests.groupBy(provider_key("provider_id").alias("npi")).agg(
        F.count("authorization_id").alias("npi_total_rows"),
        F.sum(late).alias("npi_affected_rows"),
    )
    pct = F.when(
        F.col("npi_total_rows") > 0, F.col("npi_affected_rows") / F.col("npi_total_rows") * 100.0
    ).otherwise(0.0)
    complete = F.when(F.col("npi").isNotNull(), 100.0).otherwise(0.0)
    return grouped.withColumns(
        {
            "npi_affected_pct": pct,
            "npi_completeness_score": complete,
            "npi_dimension_score": complete,
        }
    )


def auth_detail(requests: DataFrame) -> DataFrame:
    """Requests with their provider's metrics attached."""
    metrics = auth_provider_metrics(requests)
    return null_safe_join(
        requests.withColumn("npi", provider_key("provider_id")), metrics, ["npi"], "left"
    )


def auth_provider_list(requests: DataFrame) -> DataFrame:
    """Provider ids of each batch as a sorted JSON list; ids repeat per batch only once."""
    ids = requests.select("batch_id", provider_key("provider_id").alias("npi")).distinct()
    return ids.groupBy("batch_id").agg(distinct_json("npi").alias("providers"))


def auth_run_summary(requests: DataFrame) -> DataFrame:
    """One row for the whole batch: worst status, counts and the first late explanation."""
    status = F.col("sla_status")

    def count_of(label):
        return F.count(F.when(status == label, 1))

    def first_text(name, label):
        return F.min_by(
            F.when(status == label, F.col(name)),
            F.when(status == label, F.struct("request_date", "authorization_id")),
        )

    totals = requests.agg(
        F.count(F.lit(1)).alias("total_records"),
        count_of("MET").alias("passed_records"),
        count_of("MINOR_BREACH").alias("warning_count"),
        count_of("BREACHED").alias("critical_count"),
        *[
            first_text(n, s).alias(f"{n}_{s}")
            for n in ("root_cause", "recommendation")
            for s in ("MINOR_BREACH", "BREACHED")
        ],
        (F.avg(F.col("provider_id").isNotNull().cast("int")) * 100.0).alias("npi_completeness_score"),
    )
    breached, minor = F.col("critical_count") > 0, F.col("warning_count") > 0
    late = F.col("warning_count") + F.col("critical_count")
    return totals.select(
        "total_records",
        "passed_records",
        late.alias("failed_records"),
        "critical_count",
        "warning_count",
        F.when(breached, "BREACHED").when(minor, "MINOR_BREACH").otherwise("MET").alias("overall_status"),
        F.when(breached, "critical").when(minor, "warning").otherwise("info").alias("severity"),
        F.coalesce(
            fill(
                "Authorization SLA compliance: {}%",
                fixed(F.col("passed_records") / F.nullif(F.col("passed_records") + late, F.lit(0)) * 100, 2),
            ),
            F.lit("Authorization SLA compliance: N/A"),
        ).alias("message"),
        F.when(breached, F.col("root_cause_BREACHED"))
        .when(minor, F.col("root_cause_MINOR_BREACH"))
        .alias("root_cause"),
        F.when(breached, F.col("recommendation_BREACHED"))
        .when(minor, F.col("recommendation_MINOR_BREACH"))
        .alias("recommendation"),
        F.coalesce("npi_completeness_score", F.lit(0.0)).alias("npi_completeness_score"),
    )


def last_rows(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The latest n rows in rising order."""
    newest = df.orderBy(F.desc_nulls_last(by), *ties).limit(n)
    return newest.orderBy(by, *ties)
