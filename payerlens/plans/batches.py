"""Weekly equipment-claim batches: features, anomaly score and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.functions.clean import non_negative, number, ratio
from payerlens.functions.dates import days_between
from payerlens.operators import forest
from payerlens.operators.quantiles import exact_median
from payerlens.operators.stages import settle

# Fixed values.
FEATURES = (
    "batch_volume",
    "avg_lag_days",
    "max_lag_days",
    "avg_submitted_amt",
    "allowed_submitted_ratio",
    "missing_hcpcs_ratio",
)
ANOMALY, HEALTHY = "CRITICAL ANOMALY", "HEALTHY"
OUTLIER_SCORE = 0.6


def batch_features(lines: DataFrame) -> DataFrame:
    """One row per processing date; unknown features take their median, then 0."""
    lag = non_negative(days_between("CLM_FROM_DT", "NCH_WKLY_PROC_DT"))
    rows = lines.withColumns(
        {
            "lag": lag,
            "submitted": number("LINE_SBMTD_CHRG_AMT"),
            "allowed": number("LINE_ALOWD_CHRG_AMT"),
        }
    )
    batches = (
        rows.filter(F.col("NCH_WKLY_PROC_DT").isNotNull())
        .groupBy("NCH_WKLY_PROC_DT")
        .agg(
            F.count("CLM_ID").alias("batch_volume"),
            F.avg("lag").alias("avg_lag_days"),
            F.max("lag").cast("double").alias("max_lag_days"),
            F.avg("submitted").alias("avg_submitted_amt"),
            F.avg("allowed").alias("avg_allowed_amt"),
            F.avg(F.col("HCPCS_CD").isNull().cast("int")).alias("missing_hcpcs_ratio"),
        )
        .withColumn("allowed_submitted_ratio", ratio("avg_allowed_amt", "avg_submitted_amt"))
    )
    batches = settle(batches.withColumn("__g", F.lit(0)))
    medians = exact_median(batches, ["__g"], FEATURES, "__med")
    # The medians are a single row.
    joined = batches.join(F.broadcast(medians), "__g")
    filled = {f: F.coalesce(F.col(f).cast("double"), F.col(f"{f}__med"), F.lit(0.0)) for f in FEATURES}
    return joined.withColumns(filled).drop("__g", *[f"{f}__med" for f in FEATURES])


def finding(message: Column) -> Column:
    """Structured note kept with an anomalous batch."""
    return F.to_json(
        F.struct(
            F.col("status").alias("anomaly_status"),
            F.col("anomaly_score").alias("anomaly_score"),
            F.lit("Isolation Forest anomaly").alias("primary_cause"),
            F.lit("Requires operational review").alias("impact"),
            message.alias("root_cause_interpretation"),
            F.lit("Review the batch metrics and source claims manually.").alias("recommended_action"),
            message.alias("analyst_summary"),
        )
    )


def batch_anomalies(
    lines: DataFrame, limit: float = OUTLIER_SCORE, message: str = "No enrichment available"
) -> DataFrame:
    """Batches with their isolation score and status."""
    features = batch_features(lines)
    scored = forest.score(features, forest.fit(features, "NCH_WKLY_PROC_DT", FEATURES), FEATURES)
    status = F.when(F.col("anomaly_score") >= limit, ANOMALY).otherwise(HEALTHY)
    rows = scored.withColumn("status", status)
    note = F.when(F.col("status") == ANOMALY, finding(F.lit(message)))
    return rows.withColumn("analysis", note)
