"""Report queries over the result tables. Each returns a small frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payerlens.functions.bands import GAUGE, health_score
from payerlens.functions.clean import npi
from payerlens.functions.dates import month_prefix
from payerlens.operators.keyed import latest_per_key

# Order of levels in charts, label of a blank level.
LEVEL_ORDER = ("LOW", "MODERATE", "MEDIUM", "HIGH", "CRITICAL", "LOW_VOLUME", "INSUFFICIENT_HISTORY")
UNKNOWN = "UNKNOWN"
ELEVATED = ("HIGH", "CRITICAL")


def level(c: str) -> Column:
    return F.upper(F.coalesce(F.col(c), F.lit("")))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# -- filters, listings -----------------------------------------------------------


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the text in any of the columns, in any case."""
    found = reduce(
        lambda a, b: a | b, [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns]
    )
    return df.filter(F.coalesce(found, F.lit(False)))


def with_level(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    return df.filter(level(column).isin(*[x.upper() for x in levels]))


def between_days(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    return df.filter(F.to_date(column).between(start, end))


def page(
    df: DataFrame,
    sort: str,
    allowed: Sequence[str],
    ties: Sequence[str],
    descending: bool = True,
    number: int = 1,
    size: int = 25,
) -> DataFrame:
    """One page of a listing; an unknown sort column falls back to the first allowed one."""
    by = F.col(sort if sort in allowed else allowed[0])
    order = by.desc_nulls_last() if descending else by.asc_nulls_first()
    size = max(1, size)
    return df.orderBy(order, *ties).offset((max(1, number) - 1) * size).limit(size)


def page_after(
    df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence | None, size: int
) -> DataFrame:
    """The next ``size`` rows of a listing behind the row with the keys ``last`` (None: the first ones).

    ``order`` names the keys and whether each descends; together they tell rows apart. Nulls
    come last in descending and first in ascending keys. The condition on the keys reaches
    the scan, so rows of earlier pages are not sorted again, and no page is counted off.
    """
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, last, strict=True):
            key = F.col(name)
            if value is None:
                behind = F.lit(False) if descending else key.isNotNull()
                equal = key.isNull()
            else:
                behind = ((key < value) | key.isNull()) if descending else key > value
                equal = key == value
            beyond, same = beyond | (same & behind), same & equal
        df = df.filter(beyond)
    keys = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c, descending in order]
    return df.orderBy(*keys).limit(size)


def listing_totals(df: DataFrame, **measures: Column) -> DataFrame:
    """Row count and further totals of a filtered listing."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[m.alias(n) for n, m in measures.items()])


def options(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """All values to choose from, in order; a limit only where the caller gives one."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
    return found if limit is None else found.limit(limit)


# -- top and latest ---------------------------------------------------------------


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def latest(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The newest n rows, oldest of them first."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n).orderBy(by, *ties)


# -- distributions ------------------------------------------------------------------


def frequency(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, blank counted as UNKNOWN."""
    label = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(UNKNOWN))
    return df.groupBy(label.alias(column)).agg(F.count(F.lit(1)).alias(name))


def ordered_levels(counts: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Distribution in chart order, unlisted labels last."""
    place = F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), F.upper(column))
    return counts.withColumn("position", F.when(place > 0, place).otherwise(99)).orderBy(
        "position", F.desc(name), column
    )


def share_elevated(df: DataFrame, column: str) -> DataFrame:
    high = level(column).isin(*ELEVATED)
    return df.agg(
        F.count(F.lit(1)).alias("providers"),
        count_if(high).alias("elevated"),
        (F.avg(high.cast("int")) * 100.0).alias("elevated_pct"),
        (100.0 - F.avg(high.cast("int")) * 100.0).alias("stable_pct"),
    )


def risk_points(df: DataFrame, *measures: str) -> DataFrame:
    """Rows that have all the measures of a scatter chart."""
    return df.dropna("any", subset=list(measures))


# -- anomalies -----------------------------------------------------------------------


def all_anomalies(drug: DataFrame, claim: DataFrame) -> DataFrame:
    """Drug and claim anomalies under one schema, tagged by type."""
    shared = ("provider_id", "robust_z_score", "psi_score", "anomaly_count", "severity")
    left = drug.select(
        F.lit("DRUG").alias("anomaly_type"), F.col("drug").alias("subject"), F.lit(None).cast("string").alias("month"), *shared
    )
    right = claim.select(
        F.lit("CLAIM").alias("anomaly_type"), F.col("claim_type").alias("subject"), F.col("batch_month").alias("month"), *shared
    )
    return left.unionByName(right)


def severity_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy(level("severity").alias("severity")).agg(F.count(F.lit(1)).alias("count"))


def type_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))


def busiest_providers(anomalies: DataFrame, n: int) -> DataFrame:
    counts = (
        anomalies.filter("provider_id is not null")
        .groupBy("provider_id")
        .agg(F.count(F.lit(1)).alias("anomalies"), count_if(level("severity") == "HIGH").alias("high"))
    )
    return top(counts, "anomalies", n, "provider_id")


def score_points(anomalies: DataFrame, n: int | None = None) -> DataFrame:
    """All points with both scores; the strongest n where n is given."""
    both = anomalies.filter("robust_z_score is not null and psi_score is not null")
    return both if n is None else top(both, "robust_z_score", n, "anomaly_type", "provider_id", "subject", "month")


def alerts(drug: DataFrame, claim: DataFrame, n: int) -> DataFrame:
    """The strongest HIGH anomalies of both kinds."""
    ties = ("provider_id", "subject", "month")
    parts = []
    for kind in ("DRUG", "CLAIM"):
        rows = all_anomalies(drug, claim).filter(
            (F.col("anomaly_type") == kind) & (level("severity") == "HIGH")
        )
        parts.append(rows.orderBy(F.desc("anomaly_count"), F.desc_nulls_last("robust_z_score"), *ties).limit(n))
    return parts[0].unionByName(parts[1])


def issue_distribution(levels: DataFrame, column: str) -> DataFrame:
    """Critical, high, medium and low issues; each row counts once."""
    value = level(column)
    return levels.agg(
        count_if(value == "CRITICAL").alias("critical"),
        count_if(value == "HIGH").alias("high"),
        count_if(value.isin("MEDIUM", "MODERATE")).alias("medium"),
        count_if(value == "LOW").alias("low"),
    )


def drill_down(tables: dict[str, tuple[DataFrame, str, str, str]], wanted: str, n: int) -> DataFrame:
    """The n strongest rows of one level from each table: (frame, level column, id column, score column)."""
    parts = []
    for source, (df, level_column, id_column, score) in tables.items():
        rows = with_level(df, level_column, [wanted]).select(
            F.lit(source).alias("source"),
            F.col(id_column).cast("string").alias("id"),
            F.col(score).cast("double").alias("score"),
        )
        parts.append(top(rows, "score", n, "id"))
    return reduce(DataFrame.unionByName, parts)


def root_causes(frames: Sequence[DataFrame], n: int) -> DataFrame:
    texts = reduce(DataFrame.unionByName, [f.select("root_cause") for f in frames])
    known = texts.filter(F.trim(F.coalesce("root_cause", F.lit(""))) != "")
    return top(frequency(known, "root_cause", "occurrences"), "occurrences", n, "root_cause")


# -- dashboards ------------------------------------------------------------------------


def claim_kpis(volume: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Headline numbers of the claims view in one row."""
    facts = anomalies.agg(
        F.struct(
            F.count(F.lit(1)).alias("anomalies"),
            count_if(level("severity") == "HIGH").alias("high"),
            F.countDistinct("provider_id").alias("providers"),
        ).alias("t")
    ).scalar()
    return volume.agg(
        F.count(F.lit(1)).alias("providers"),
        F.sum("total_claim_volume").alias("claims"),
        F.avg("volume_risk").alias("average_risk"),
        count_if(level("risk_level").isin(*ELEVATED)).alias("elevated_providers"),
    ).select(
        "*",
        facts["anomalies"].alias("anomalies"),
        facts["high"].alias("high_anomalies"),
        facts["providers"].alias("anomalous_providers"),
    )


def dashboard(**facts: DataFrame | Column | int | None) -> DataFrame:
    """One row of headline numbers; one-row frames are joined, constants and columns added."""
    frames = [f for f in facts.values() if isinstance(f, DataFrame)]
    # every frame is a single aggregate row
    rows = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)
    return rows.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in facts.items() if not isinstance(v, DataFrame)})


def anomaly_facts(drug: DataFrame, claim: DataFrame) -> DataFrame:
    """Counts over both anomaly tables in one row; a provider found in both counts once."""
    shared = ("provider_id", "severity", "psi_anomaly", "robust_z_anomaly")
    both = drug.select(F.lit(1).alias("is_drug"), *shared).unionByName(claim.select(F.lit(0).alias("is_drug"), *shared))
    return both.agg(
        count_if(F.col("is_drug") == 1).alias("drug_anomalies"),
        count_if(F.col("is_drug") == 0).alias("claim_anomalies"),
        F.count(F.lit(1)).alias("total_anomalies"),
        count_if(level("severity") == "HIGH").alias("high_risk"),
        F.countDistinct("provider_id").alias("affected_providers"),
        count_if(F.col("psi_anomaly") == 1).alias("psi_anomalies"),
        count_if(F.col("robust_z_anomaly") == 1).alias("robust_z_anomalies"),
    )


def claims_dashboard(
    claims: DataFrame, volume: DataFrame, runs: DataFrame, quality: DataFrame, drug: DataFrame, claim: DataFrame
) -> DataFrame:
    """Claims mode: records, providers, late runs, alerts of three kinds and anomalies."""
    status = F.col("sla_status")
    rows = dashboard(
        records=claims.agg(F.count(F.lit(1)).alias("total_records")),
        providers=volume.agg(
            F.countDistinct("NPI").alias("total_providers"),
            count_if(level("risk_level").isin(*ELEVATED)).alias("volume_alerts"),
        ),
        runs=runs.agg(
            F.sum("records_processed").cast("bigint").alias("processed_claims"),
            count_if(status == "BREACHED").alias("sla_breaches"),
            count_if(status.isin("MET", "MINOR_OVERRUN", "BREACHED")).alias("rated_runs"),
            count_if(status == "MET").alias("met_runs"),
        ),
        quality=quality.agg(count_if(level("severity").isin(*ELEVATED)).alias("dq_alerts")),
        anomalies=anomaly_facts(drug, claim),
    )
    share = F.round(F.col("met_runs") / F.nullif("rated_runs", F.lit(0)) * 100, 2)
    return rows.withColumns(
        {
            "module": F.lit("claims"),
            "sla_compliance": share,
            "sla_alerts": F.col("sla_breaches"),
            "active_alerts": F.col("dq_alerts") + F.col("volume_alerts") + F.col("sla_breaches"),
        }
    ).drop("rated_runs", "met_runs")


def drugs_dashboard(drugs: DataFrame, providers: DataFrame) -> DataFrame:
    """Drug mode: listed drugs, brands, providers, elevated risks and alerts."""
    high = level("volume_risk_level").isin(*ELEVATED)
    named = F.when(F.trim("Brnd_Name") != "", F.col("Brnd_Name"))
    seen = F.when(F.trim("Prscrbr_NPI") != "", F.col("Prscrbr_NPI"))
    return dashboard(
        drugs=drugs.agg(
            F.count(F.lit(1)).alias("total_records"),
            F.countDistinct(named).alias("processed_claims"),
            count_if(high).alias("sla_breaches"),
            count_if(high | (F.coalesce("high_risk_flag_count", F.lit(0)) > 0)).alias("active_alerts"),
        ),
        providers=providers.agg(F.countDistinct(seen).alias("total_providers")),
        module="drugs",
        total_anomalies=F.col("sla_breaches"),
        affected_providers=F.col("total_providers"),
    )


def authorization_dashboard(volume: DataFrame, rules: DataFrame, requests: DataFrame) -> DataFrame:
    """Authorization mode: requests, failed rules, elevated volumes of the latest months and late decisions."""
    known = volume.filter(F.trim(F.coalesce("NPI", F.lit(""))) != "")
    newest = latest_per_key(known, ["NPI"], ["current_period"])
    status, late = F.col("sla_status"), F.col("sla_status").isin("MINOR_BREACH", "BREACHED")
    rows = dashboard(
        requests=requests.agg(
            F.count(F.lit(1)).alias("total_records"),
            count_if(late).alias("sla_breaches"),
            count_if(status == "MET").alias("met"),
        ),
        providers=newest.agg(
            F.count(F.lit(1)).alias("total_providers"), count_if(level("risk_level").isin(*ELEVATED)).alias("volume_alerts")
        ),
        rules=rules.agg(
            F.sum(F.when(level("severity").isin(*ELEVATED), F.col("failed_records")).otherwise(0)).cast("bigint").alias("dq_alerts")
        ),
    )
    share = F.round(F.col("met") / F.nullif(F.col("met") + F.col("sla_breaches"), F.lit(0)) * 100, 2)
    return rows.withColumns(
        {
            "module": F.lit("authorization"),
            "sla_compliance": share,
            "sla_alerts": F.col("sla_breaches"),
            "active_alerts": F.col("dq_alerts"),
            "total_anomalies": F.col("dq_alerts") + F.col("volume_alerts"),
        }
    ).drop("met")


def distinct_providers(left: DataFrame, right: DataFrame, column: str = "provider_id") -> DataFrame:
    """Providers found in either table."""
    both = left.select(column).unionByName(right.select(column)).filter(F.col(column).isNotNull())
    return both.agg(F.countDistinct(column).alias("providers"))


def drug_summary(drugs: DataFrame) -> DataFrame:
    return drugs.agg(
        F.count(F.lit(1)).alias("drugs"),
        F.countDistinct("Gnrc_Name").alias("generics"),
        count_if(level("volume_risk_level").isin(*ELEVATED)).alias("elevated_drugs"),
        F.sum("total_claims").alias("total_claims"),
        count_if(F.col("high_risk_flag_count") > 0).alias("flagged_drugs"),
    )


def quality_overview(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("providers"),
        F.avg("quality_score").alias("average_score"),
        F.min("quality_score").alias("lowest_score"),
        F.sum("total_violations").alias("violations"),
        F.sum("critical_count").alias("critical"),
    )


def auth_funnel(auth: DataFrame) -> DataFrame:
    """Requests by status and by SLA outcome."""
    status = F.col("status")
    return auth.agg(
        F.count(F.lit(1)).alias("submitted"),
        count_if(F.col("approval_date").isNotNull()).alias("decided"),
        count_if(status == "Approved").alias("approved"),
        count_if(status == "Denied").alias("denied"),
        count_if(status == "Pending").alias("pending"),
        count_if(F.col("sla_status") == "MET").alias("within_sla"),
        count_if(F.col("sla_status").isin("MINOR_BREACH", "BREACHED")).alias("late"),
    )


def breach_by_provider(auth: DataFrame, volume: DataFrame, n: int) -> DataFrame:
    """Late share per provider next to its newest volume risk, worst first."""
    late = F.col("sla_status").isin("MINOR_BREACH", "BREACHED")
    rates = auth.groupBy(npi("provider_id").alias("NPI")).agg(
        F.count(F.lit(1)).alias("requests"), count_if(late).alias("late_requests")
    )
    newest = latest_per_key(
        volume.select(npi("NPI").alias("NPI"), "current_period", "current_month_volume", "risk_level"),
        ["NPI"],
        ["current_period"],
    )
    rate = F.round(F.col("late_requests") * 100.0 / F.col("requests"), 2)
    return top(rates.join(newest, "NPI").withColumn("breach_rate", rate), "breach_rate", n, "NPI")


def sla_trend(auth: DataFrame, months: int) -> DataFrame:
    """Mean and largest turnaround and late share of the newest months."""
    late = F.col("sla_status").isin("MINOR_BREACH", "BREACHED")
    rows = (
        auth.filter(F.col("request_date").isNotNull() & (F.col("turnaround_hours") >= 0))
        .groupBy(month_prefix("request_date").alias("month"))
        .agg(
            F.avg("turnaround_hours").alias("average_hours"),
            F.max("turnaround_hours").alias("longest_hours"),
            (F.avg(late.cast("int")) * 100.0).alias("late_pct"),
            F.lit(72.0).alias("limit_hours"),
        )
    )
    return latest(rows, "month", months)


def latest_signals(tables: dict[str, DataFrame]) -> DataFrame:
    """The newest finished run of each domain: frames with run_id, started_at, sla_status."""
    parts = []
    for domain, df in tables.items():
        rows = df.withColumn("g", F.lit(domain)).select("g", "started_at", "run_id", "sla_status")
        newest = latest_per_key(rows, ["g"], ["started_at", "run_id"])
        parts.append(newest.withColumnRenamed("g", "domain"))
    return reduce(DataFrame.unionByName, parts)


def volume_trend(monthly: DataFrame, history: DataFrame, months: int) -> DataFrame:
    """Claims and mean baseline of the newest periods."""
    base = history.select("NPI", "period", "baseline_volume")
    rows = (
        monthly.join(base, ["NPI", "period"], "left")
        .groupBy("period")
        .agg(F.sum("monthly_volume").alias("claims"), F.avg("baseline_volume").alias("average_baseline"))
    )
    return latest(rows, "period", months)


def trend_facts(trend: DataFrame, period: str, value: str) -> DataFrame:
    """Latest, average and peak of a trend."""
    return trend.agg(
        F.max_by(value, period).alias("latest"),
        F.avg(value).alias("average"),
        F.max(value).alias("peak"),
        F.max_by(period, F.struct(value, period)).alias("peak_period"),
    )


def radar(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Mean of each risk axis with its share of all axes."""
    means = df.agg(*[F.avg(c).alias(name) for name, c in axes.items()])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in axes])
    entries = [
        F.struct(
            F.lit(n).alias("metric"),
            F.col(n).alias("value"),
            (F.col(n) / F.nullif(total, F.lit(0.0)) * 100.0).alias("contribution_pct"),
        )
        for n in axes
    ]
    return means.select(F.explode(F.array(*entries)).alias("a")).select("a.*")


def risk_trend(history: DataFrame, periods: int) -> DataFrame:
    rows = history.groupBy("period").agg(
        F.avg("volume_risk").alias("average_risk"), count_if(F.col("volume_risk") >= 0.8).alias("high_risk_providers")
    )
    return latest(rows, "period", periods)


def portfolio(risk: DataFrame, score: str, components: Sequence[str] = ()) -> DataFrame:
    """Mean, lowest and highest score, gauge band and health of a risk table."""
    facts = risk.agg(
        F.count(F.lit(1)).alias("providers"),
        F.avg(score).alias("average_score"),
        F.min(score).alias("lowest_score"),
        F.max(score).alias("highest_score"),
        *[F.avg(c).alias(f"average_{c}") for c in components],
    )
    return facts.withColumns(
        {"gauge": GAUGE("average_score"), "health": health_score("average_score")}
    )


def gauge_bands(risk: DataFrame, score: str) -> DataFrame:
    return risk.groupBy(GAUGE(score).alias("gauge")).agg(F.count(F.lit(1)).alias("providers"))


def level_counts(risk: DataFrame, column: str) -> DataFrame:
    """Rows per risk level; an unknown level counts as LOW."""
    return risk.groupBy(F.coalesce(F.nullif(level(column), F.lit("")), F.lit("LOW")).alias("risk_level")).agg(
        F.count(F.lit(1)).alias("providers")
    )


def executive_index(claims: DataFrame, pharmacy: DataFrame) -> DataFrame:
    """Mean of two portfolios' mean scores with health and gauge: frames of ``portfolio``."""
    rows = claims.select("providers", "average_score").unionByName(pharmacy.select("providers", "average_score"))
    mean = F.round(F.avg(F.round("average_score", 4)), 4)
    return rows.agg(F.sum("providers").alias("providers"), mean.alias("combined_score")).select(
        "providers",
        "combined_score",
        F.round(health_score("combined_score"), 1).alias("health_index"),
        GAUGE("combined_score").alias("gauge"),
    )


def combined_index(*portfolios: DataFrame) -> DataFrame:
    """Provider-weighted mean score over several portfolios."""
    rows = reduce(
        DataFrame.unionByName, [p.select("providers", "average_score") for p in portfolios]
    )
    total = F.sum("providers")
    mean = F.sum(F.col("providers") * F.col("average_score")) / total
    return rows.agg(total.alias("providers"), mean.alias("combined_score")).withColumn(
        "gauge", GAUGE("combined_score")
    )


def highest_claims(detail: DataFrame, claim: str, value: str, n: int) -> DataFrame:
    totals = detail.groupBy(claim).agg(F.sum(value).alias("total"))
    peak = totals.agg(F.max("total")).scalar()
    return top(totals, "total", n, claim).withColumn("share_of_peak", F.col("total") / peak)


# -- single provider or claim ------------------------------------------------------------


def provider_profile(
    volume: DataFrame,
    history: DataFrame,
    claim: DataFrame,
    drug: DataFrame,
    quality: DataFrame,
    periods: int,
    provider: str | None = None,
) -> DataFrame:
    """Everything known about each provider, or the given one, as
    (NPI, section, period, label, value) rows."""

    def part(df, key, section, period, label, value):
        chosen = F.lit(True) if provider is None else npi(key) == provider
        return df.filter(chosen).select(
            npi(key).alias("NPI"),
            F.lit(section).alias("section"),
            period.cast("string").alias("period"),
            label.cast("string").alias("label"),
            value.cast("double").alias("value"),
        )

    c = F.col
    parts = [
        part(volume, "NPI", "volume", c("current_period"), c("risk_level"), c("volume_risk")),
        part(latest_per_provider(history, periods), "NPI", "history", c("period"), c("risk_level"), c("monthly_volume")),
        part(claim, "provider_id", "claim_anomaly", c("batch_month"), c("severity"), c("robust_z_score")),
        part(drug, "provider_id", "drug_anomaly", F.lit(None), c("drug"), c("robust_z_score")),
        part(quality, "npi", "quality", F.lit(None), c("field_name"), c("npi_completeness_score")),
    ]
    return reduce(DataFrame.unionByName, parts)


def latest_per_provider(history: DataFrame, n: int) -> DataFrame:
    """The newest n periods of each provider; a provider has one row per calendar month."""
    newest = Window.partitionBy("NPI").orderBy(F.desc("period"))
    return history.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n).drop("__n")


def claim_detail(claims: DataFrame, volume: DataFrame, quality: DataFrame) -> DataFrame:
    """Claims with their provider's newest volume risk and mean quality score."""
    risk = latest_per_key(
        volume.select("NPI", "current_period", "risk_level", "volume_risk"), ["NPI"], ["current_period"]
    )
    score = quality.groupBy(npi("npi").alias("NPI")).agg(F.avg("npi_completeness_score").alias("quality_score"))
    return claims.join(risk, "NPI", "left").join(score, "NPI", "left")
