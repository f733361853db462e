"""Writers. Each takes a lazy frame and runs it once."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_run(df: DataFrame, path: str) -> None:
    """Append one run's rows; runs are separate partitions, so latest-run reads prune."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def write_batches(df: DataFrame, path: str, rows: int = 1000) -> None:
    """CSV files of at most ``rows`` rows each."""
    df.write.mode("overwrite").options(header=True, maxRecordsPerFile=rows).csv(path)


def export_report(frames: list[DataFrame] | DataFrame, path: str) -> None:
    """Quoted CSV; several frames share the union of their columns."""
    frames = frames if isinstance(frames, list) else [frames]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    merged.write.mode("overwrite").options(header=True, quoteAll=True).csv(path)


def merge_runs(old: DataFrame, new: DataFrame, obsolete: tuple[str, ...] = ()) -> DataFrame:
    """Old and new rows under the newer schema: new columns added, obsolete ones dropped."""
    return old.drop(*obsolete).unionByName(new.drop(*obsolete), allowMissingColumns=True)


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def sample_evidence(
    evidence: DataFrame, keys: list[str], order: list[str], limit: int | None
) -> DataFrame:
    """At most ``limit`` example rows per rule, the first ones in the given order; all with None.

    A rank against a limit lets Spark cut each rule to ``limit`` rows in every task before
    the shuffle (window group limit), so a rule that fails on most rows sends few of
    them; the session's threshold for that is raised where it is lower.
    """
    if limit is None:
        return evidence
    spark = evidence.sparkSession
    if int(spark.conf.get(GROUP_LIMIT)) < limit:
        spark.conf.set(GROUP_LIMIT, str(limit))
    first = Window.partitionBy(*keys).orderBy(*order)
    return evidence.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= limit).drop("__rank")


def write_evidence(
    evidence: DataFrame, summary: DataFrame, path: str, order: list[str], limit: int | None
) -> None:
    """Up to ``limit`` example rows (None: all) by file, dimension and rule, plus a JSON summary."""
    keys = ["file", "dimension", "rule"]
    sample_evidence(evidence, keys, order, limit).write.mode("overwrite").partitionBy(*keys).option(
        "header", True
    ).csv(f"{path}/samples")
    summary.write.mode("overwrite").json(f"{path}/summary")


RUN_COLUMNS = {
    "run_id": "string",
    "step_name": "string",
    "status": "string",
    "started_at": "timestamp",
    "completed_at": "timestamp",
    "duration_seconds": "double",
    "records_processed": "bigint",
    "dataset_name": "string",
    "batch_id": "string",
    "error_message": "string",
    "dimension": "string",
    "field_name": "string",
    "rule_name": "string",
    "affected_rows": "bigint",
    "affected_pct": "double",
    "severity": "string",
    "message": "string",
    "total_records": "bigint",
    "passed_records": "bigint",
    "failed_records": "bigint",
    "total_rules_checked": "bigint",
    "total_violations": "bigint",
    "critical_count": "bigint",
    "high_count": "bigint",
    "warning_count": "bigint",
    "info_count": "bigint",
    "quality_score": "double",
    "overall_status": "string",
    "root_cause": "string",
    "recommendation": "string",
    "npi": "string",
    "npi_total_rows": "bigint",
    "npi_affected_rows": "bigint",
    "npi_affected_pct": "double",
    "npi_completeness_score": "double",
    "created_at": "timestamp",
    "npi_dimension_score": "double",
}


def run_rows(df: DataFrame, **fixed) -> DataFrame:
    """Bring rows to the run-table schema; ``fixed`` gives constants, the rest is NULL."""
    out = []
    for name, kind in RUN_COLUMNS.items():
        if name in fixed:
            value = F.lit(fixed[name])
        elif name in df.columns:
            value = F.col(name)
        else:
            value = F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def step_row(
    spark: SparkSession,
    run_id: str,
    step: str,
    status: str,
    started: datetime,
    completed: datetime,
    **more,
) -> DataFrame:
    """One audit row for a finished step."""
    return run_rows(
        spark.range(1),
        run_id=run_id,
        step_name=step,
        status=status,
        started_at=started,
        completed_at=completed,
        duration_seconds=(completed - started).total_seconds(),
        created_at=completed,
        **more,
    )


def audited(spark: SparkSession, run_id: str, step: str, action, path: str, **more):
    """Run an action and append its audit row, also when it fails."""
    started = datetime.now()
    status, error = "SUCCESS", None
    try:
        return action()
    except Exception as e:
        status, error = "FAILED", str(e)
        raise
    finally:
        row = step_row(
            spark, run_id, step, status, started, datetime.now(), error_message=error, **more
        )
        append_run(row, path)
