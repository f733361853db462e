"""Provider volume against its own history: claims (6 months) and authorizations (3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.functions import messages as M
from payerlens.functions.bands import AUTH_RISK_LEVEL, VOLUME_DEVIATION_RISK, volume_risk_level
from payerlens.functions.clean import (
    half_even,
    is_valid_claim_key,
    is_valid_npi_key,
    npi,
    trim_text,
)
from payerlens.functions.dates import month_key
from payerlens.functions.text import fill, fixed
from payerlens.operators import periods
from payerlens.operators.keyed import first_per_key

# Fixed values.
CLAIM_BASELINE_MONTHS = 6
AUTH_BASELINE_MONTHS = 3
LOW_VOLUME_BASELINE = 5


def valid_claims(claims: DataFrame) -> DataFrame:
    """Cleaned (source, CLM_ID, NPI, DT, period), each claim once per source.

    Of several rows of a claim the earliest date, then the smallest NPI counts.
    """
    clean = claims.select(
        "source",
        trim_text("CLM_ID").alias("CLM_ID"),
        npi("NPI").alias("NPI"),
        F.col("DT").try_cast("timestamp").alias("DT"),
    ).filter(is_valid_npi_key("NPI") & is_valid_claim_key("CLM_ID") & F.col("DT").isNotNull())
    # By claim first: rows are sorted by their keys, and the few sources would tell hardly any apart.
    once = first_per_key(clean, ["CLM_ID", "source"], ["DT", "NPI"])
    return once.select("source", "NPI", "CLM_ID", "DT", month_key("DT").alias("period"))


def monthly_volume(valid: DataFrame) -> DataFrame:
    """Claims per provider and month, with the set of sources seen."""
    return valid.groupBy("NPI", "period").agg(
        F.count("CLM_ID").alias("monthly_volume"), F.collect_set("source").alias("month_sources")
    )


def volume_explanation(level, deviation, baseline, current, history) -> list[Column]:
    """root_cause and recommendation of a claims volume risk level."""
    dev = F.coalesce(fill(M.VOLUME_DEVIATION_CLAUSE, fixed(deviation, 2)), F.lit(""))
    size = F.coalesce(
        fill(M.VOLUME_LEVEL_CLAUSE, fixed(current, 0), fixed(baseline, 2)), F.lit("")
    )
    level = F.col(level)
    cause, action = F.lit(M.VOLUME_NO_ISSUE[0]), F.lit(M.VOLUME_NO_ISSUE[1])
    for name, text in M.VOLUME_ROOT_CAUSE.items():
        text = F.lit(text)
        if name in ("CRITICAL", "HIGH", "MEDIUM"):
            text = F.concat(text, F.when(F.col(deviation).isNotNull(), dev).otherwise(""),
                            F.when(F.col(baseline).isNotNull(), size).otherwise(""))
        elif name == "MODERATE":
            text = F.concat(text, F.when(F.col(deviation).isNotNull(), dev).otherwise(""))
        cause = F.when(level == name, text).otherwise(cause)
    for name, text in M.VOLUME_RECOMMENDATION.items():
        action = F.when(level == name, F.lit(text)).otherwise(action)
    action = F.when(
        level == "INSUFFICIENT_HISTORY",
        fill(M.VOLUME_HISTORY_RECOMMENDATION, F.col(history).cast("string")),
    ).otherwise(action)
    return [cause.alias("root_cause"), action.alias("recommendation")]


def rolling_history(monthly: DataFrame, months: int = CLAIM_BASELINE_MONTHS) -> DataFrame:
    """Every calendar month of each provider with baseline, deviation and risk.

    Risk is banded on the unrounded deviation; baseline and deviation are
    stored with two decimals.
    """
    filled = periods.fill_months(monthly, ["NPI"], "period", ["monthly_volume"])
    key, v = ["NPI"], "monthly_volume"
    rows = filled.withColumns(
        {
            "base": periods.previous_median(v, key, "period", months),
            "history_months": periods.previous_count(v, key, "period", months),
            "baseline_periods": periods.previous_labels("period", key, "period", months, ", "),
        }
    )
    deviation = F.when(
        F.col("base") > 0, F.abs(F.col(v) - F.col("base")) / F.col("base") * 100
    )
    rows = rows.withColumn("dev", deviation).withColumn("volume_risk", VOLUME_DEVIATION_RISK("dev"))
    return rows.select(
        "NPI",
        "period",
        "monthly_volume",
        half_even("base", 2).alias("baseline_volume"),
        F.when(F.col("base").isNotNull(), "ROLLING_6_MONTH_MEDIAN")
        .otherwise("INSUFFICIENT_HISTORY")
        .alias("baseline_method"),
        "baseline_periods",
        half_even("dev", 2).alias("deviation_pct"),
        "volume_risk",
        volume_risk_level("volume_risk").alias("risk_level"),
        "history_months",
        "month_sources",
    )


def explained_history(history: DataFrame) -> DataFrame:
    text = volume_explanation(
        "risk_level", "deviation_pct", "baseline_volume", "monthly_volume", "history_months"
    )
    return history.drop("month_sources").select("*", *text)


def provider_volume_risk(history: DataFrame) -> DataFrame:
    """Latest month of each provider with totals and sources.

    One aggregate by provider; the rows already are partitioned that way.
    """
    latest = [c for c in history.columns if c not in ("NPI", "month_sources")]
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list("month_sources"))))
    rows = history.groupBy("NPI").agg(
        F.max_by(F.struct(*latest), "period").alias("last"),
        F.sum("monthly_volume").alias("total_claim_volume"),
        F.count("period").alias("months_available"),
        sources.alias("source_list"),
    )
    rows = rows.select(
        "NPI",
        F.col("last.period").alias("current_period"),
        F.col("last.monthly_volume").alias("current_month_volume"),
        *[F.col(f"last.{c}").alias(c) for c in latest if c not in ("period", "monthly_volume")],
        "total_claim_volume",
        F.size("source_list").alias("source_count"),
        F.array_join("source_list", ", ").alias("sources"),
        "months_available",
    )
    return rows.select(
        "*",
        *volume_explanation(
            "risk_level",
            "deviation_pct",
            "baseline_volume",
            "current_month_volume",
            "history_months",
        ),
    )


def by_risk(risk: DataFrame) -> DataFrame:
    """Riskiest first, unknown last, NPI as tiebreak."""
    return risk.orderBy(F.desc_nulls_last("volume_risk"), F.desc_nulls_last("deviation_pct"), "NPI")


def source_summary(claims: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows loaded and valid claims, providers and months per source."""
    loaded = claims.groupBy("source").agg(F.count(F.lit(1)).alias("rows_loaded"))
    usable = valid.groupBy("source").agg(
        F.count(F.lit(1)).alias("valid_claims"),
        F.countDistinct("NPI").alias("unique_providers"),
        F.countDistinct("period").alias("months"),
    )
    cause, action = M.VOLUME_SUMMARY_TEXT
    return loaded.join(usable, "source").select(
        "*", F.lit(cause).alias("root_cause"), F.lit(action).alias("recommendation")
    )


def claims_volume(claims: DataFrame) -> dict[str, DataFrame]:
    """All five claims volume tables from (source, CLM_ID, DT, NPI) rows."""
    valid = valid_claims(claims)
    monthly = monthly_volume(valid)
    history = rolling_history(monthly)
    no_issue = [
        F.lit(M.VOLUME_NO_ISSUE[0]).alias("root_cause"),
        F.lit(M.VOLUME_NO_ISSUE[1]).alias("recommendation"),
    ]
    return {
        "combined_provider_claims": valid.select("*", *no_issue),
        "provider_monthly_volume": monthly.drop("month_sources").select("*", *no_issue),
        "provider_volume_rolling_history": explained_history(history),
        "provider_volume_risk": provider_volume_risk(history),
        "volume_dataset_summary": source_summary(claims, valid),
    }


def auth_monthly_volume(auth: DataFrame) -> DataFrame:
    """Authorizations per provider and request month."""
    clean = auth.select(
        npi("provider_id").alias("NPI"),
        F.col("request_date").try_cast("timestamp").alias("request_date"),
        "authorization_id",
    ).filter(F.col("NPI").isNotNull() & (F.col("NPI") != "") & F.col("request_date").isNotNull())
    return clean.groupBy("NPI", month_key("request_date").alias("period")).agg(
        F.count("authorization_id").alias("monthly_volume")
    )


def auth_volume_risk(monthly: DataFrame, months: int = AUTH_BASELINE_MONTHS) -> DataFrame:
    """Every calendar month of each provider against its previous three months."""
    key, v = ["NPI"], "monthly_volume"
    rows = periods.fill_months(monthly, key, "period", [v]).withColumns(
        {
            "baseline_volume": periods.previous_median(v, key, "period", months),
            "history_months": periods.previous_count(v, key, "period", months),
            "baseline_periods": F.coalesce(
                periods.previous_labels("period", key, "period", months, ","), F.lit("")
            ),
        }
    )
    base, now = F.col("baseline_volume"), F.col(v)
    rows = rows.withColumn(
        "deviation_pct",
        F.when((base == 0) & (now == 0), 0.0).when(base > 0, F.abs(now - base) / base * 100.0),
    ).withColumn("volume_risk", F.least(F.col("deviation_pct") / 100.0, F.lit(1.0)))
    rows = rows.withColumn(
        "volume_risk", F.when(F.col("deviation_pct").isNotNull(), F.col("volume_risk"))
    )
    level = (
        F.when(F.col("volume_risk").isNull(), "INSUFFICIENT_HISTORY")
        .when(base == 0, "LOW")
        .when(base < LOW_VOLUME_BASELINE, "LOW_VOLUME")
        .otherwise(AUTH_RISK_LEVEL("volume_risk"))
    )
    rows = rows.withColumn("risk_level", level).withColumn(
        "baseline_method",
        F.when(base.isNotNull(), "ROLLING_3_MONTH_MEDIAN").otherwise("INSUFFICIENT_HISTORY"),
    )
    return rows.select(
        "NPI",
        F.col("period").alias("current_period"),
        now.alias("current_month_volume"),
        "baseline_volume",
        "baseline_method",
        "baseline_periods",
        "deviation_pct",
        "volume_risk",
        "risk_level",
        "history_months",
        *_auth_explanation(now),
    )


def _auth_explanation(now: Column) -> list[Column]:
    level, base, who = F.col("risk_level"), F.col("baseline_volume"), F.col("NPI")
    causes, actions = M.AUTH_VOLUME_ROOT_CAUSE, M.AUTH_VOLUME_RECOMMENDATION
    direction = F.when(now > base, "increased").otherwise("decreased")
    cause = (
        F.when(level == "INSUFFICIENT_HISTORY", causes["INSUFFICIENT_HISTORY"])
        .when(level == "LOW_VOLUME", fill(causes["LOW_VOLUME"], who, fixed(base, 0)))
        .when(
            level.isin("CRITICAL", "HIGH", "MODERATE"),
            fill(
                causes["DEVIATING"],
                who,
                direction,
                fixed(now, 0),
                fixed(base, 2),
                fixed("deviation_pct", 2),
            ),
        )
        .otherwise(fill(causes["NORMAL"], who))
    )
    action = (
        F.when(level == "INSUFFICIENT_HISTORY", fill(actions["INSUFFICIENT_HISTORY"], who))
        .when(level == "LOW_VOLUME", fill(actions["LOW_VOLUME"], who))
        .when((level == "CRITICAL") & (now > base), fill(actions["CRITICAL_UP"], who))
        .when(level == "CRITICAL", fill(actions["CRITICAL_DOWN"], who))
        .when(level == "HIGH", fill(actions["HIGH"], who))
        .when(level == "MODERATE", fill(actions["MODERATE"], who))
        .otherwise(fill(actions["NORMAL"], who))
    )
    return [cause.alias("root_cause"), action.alias("recommendation")]


def explained_auth_months(monthly: DataFrame, risk: DataFrame) -> DataFrame:
    """Observed months with the explanation of their risk row."""
    texts = risk.select("NPI", F.col("current_period").alias("period"), "root_cause", "recommendation")
    cause, action = M.AUTH_VOLUME_DEFAULT
    return monthly.join(texts, ["NPI", "period"], "left").withColumns(
        {
            "root_cause": F.coalesce("root_cause", F.lit(cause)),
            "recommendation": F.coalesce("recommendation", F.lit(action)),
        }
    )


def auth_volume(auth: DataFrame) -> dict[str, DataFrame]:
    """Both authorization volume tables, with per-provider and dataset totals."""
    monthly = auth_monthly_volume(auth)
    risk = auth_volume_risk(monthly)
    dataset_total = monthly.agg(F.sum("monthly_volume")).scalar()
    by_provider = monthly.groupBy("NPI").agg(
        F.sum("monthly_volume").alias("provider_authorization_volume"),
        F.count("period").alias("provider_months"),
    )
    table = risk.join(by_provider, "NPI").withColumns(
        {
            "total_authorization_volume": dataset_total,
            "source_count": F.lit(1),
            "sources": F.lit("authorization"),
            "months_available": F.col("history_months"),
        }
    )
    return {
        "authorization_provider_monthly_volume": explained_auth_months(monthly, risk),
        "authorization_provider_volume_risk": table,
    }
