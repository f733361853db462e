"""Result tables by run: each run is a partition, replaced as a whole, and seen only once it is finished."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payerlens.sources.sinks import audited

RUNS, AUDIT = "_runs", "_audit"
_MARKER = "started timestamp, version int, tables array<string>, run_id string"


def run_id(kind: str, started: datetime, inputs: Sequence[str] = ()) -> str:
    """Id of a run, the same for the same kind, start and inputs: ``20250131_080000_claims_1a2b3c4d``."""
    text = "\n".join([kind, started.isoformat(), *sorted(inputs)])
    return f"{started:%Y%m%d_%H%M%S}_{kind}_{hashlib.sha256(text.encode()).hexdigest()[:8]}"


class ResultStore:
    """Tables of Parquet folders ``<folder>/<table>/run_id=<id>`` and a marker row per finished run.

    ``folder`` lies in a store that driver and executors share. A table's partition is
    replaced by dynamic overwrite, so a repeated run leaves the other runs alone. Readers
    ask the markers first and then read one partition, so a run that failed half way
    leaves the last finished one in sight.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _exists(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def write(self, run: str, table: str, rows: DataFrame) -> None:
        """Replace one run's part of a table."""
        (
            rows.withColumn("run_id", F.lit(run))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(self.path(table))
        )

    def commit(self, run: str, tables: Sequence[str], started: datetime, version: int = 1) -> None:
        """Make the run visible."""
        row = self.spark.createDataFrame([(started, version, list(tables), run)], _MARKER)
        self.write(run, RUNS, row.drop("run_id"))

    def runs(self) -> DataFrame:
        """(started, version, tables, run_id) of the finished runs."""
        if not self._exists(self.path(RUNS)):
            return self.spark.createDataFrame([], _MARKER)
        return self.spark.read.schema(_MARKER).parquet(self.path(RUNS))

    def latest_run(self, table: str) -> str | None:
        """Id of the newest finished run with the table."""
        with_it = self.runs().filter(F.array_contains("tables", table))
        return with_it.agg(F.max_by("run_id", F.struct("started", "run_id"))).first()[0]

    def read(self, table: str, run: str) -> DataFrame:
        """One run's rows; the other partitions are not listed."""
        return self.spark.read.parquet(f"{self.path(table)}/run_id={run}")

    def latest(self, table: str) -> DataFrame:
        run = self.latest_run(table)
        if run is None:
            raise LookupError(f"no finished run has written {table}")
        return self.read(table, run)

    def history(
        self, table: str, renamed: dict[str, str] | None = None, obsolete: Sequence[str] = ()
    ) -> DataFrame:
        """All finished runs of a table under its newest schema, with run_id.

        Columns that a run lacks are null. ``renamed`` maps former names to the present
        ones, whose values they fill; ``obsolete`` columns are left out.
        """
        done = self.runs().filter(F.array_contains("tables", table)).select("run_id")
        rows = self.spark.read.option("mergeSchema", True).parquet(self.path(table))
        rows = rows.join(F.broadcast(done), "run_id", "left_semi").drop(*obsolete)
        for old, new in (renamed or {}).items():
            if old in rows.columns:
                value = F.coalesce(new, old) if new in rows.columns else F.col(old)
                rows = rows.withColumn(new, value).drop(old)
        return rows

    def run(
        self,
        kind: str,
        builders: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]],
        started: datetime,
        inputs: Sequence[str] = (),
        version: int = 1,
    ) -> str:
        """Write all tables of one run in order, each with its audit row, and make the run visible.

        A builder gets a function that reads the tables this run has written before.
        """
        run = run_id(kind, started, inputs)
        for table, build in builders.items():
            step = lambda: self.write(run, table, build(lambda name: self.read(name, run)))
            audited(self.spark, run, table, step, self.path(AUDIT))
        self.commit(run, list(builders), started, version)
        return run
