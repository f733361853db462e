"""Text-first readers: no type inference, so ids keep zeros and signs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payerlens.functions.clean import text_or_empty
from payerlens.operators.contracts import existing, has_any


def read_text(spark: SparkSession, path: str, sep: str = "|", empty_is_null: bool = False):
    """Delimited file with a header, every column text.

    Empty fields are '' unless ``empty_is_null``, where only they are NULL.
    """
    df = spark.read.options(header=True, sep=sep, inferSchema=False).csv(path)
    if empty_is_null:
        return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns])
    return df.select(*[text_or_empty(c).alias(c) for c in df.columns])


def read_tagged(spark: SparkSession, paths: dict[str, str], sep: str = "|") -> DataFrame:
    """Several files as one frame with a ``file`` column; absent columns are NULL."""
    parts = [read_text(spark, p, sep).withColumn("file", F.lit(name)) for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_delimited(
    spark: SparkSession, files: dict[str, str], columns: list[str], sep: str = "|", header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows: file and the columns as text, bad: file and record) of several files or folders in one scan.

    A record is a line; one with fewer or more fields than ``columns`` is kept apart as it
    stands, empty fields are '' and blank lines are skipped. With ``header``, lines that name the
    columns are left out. ``files`` maps a name to its path; no path may lie in another one.
    """
    fields = ", ".join(f"`{c}` string" for c in [*columns, "_bad"])
    lines = spark.read.text(list(files.values())).filter("value <> ''")
    if header:
        lines = lines.filter(F.col("value") != sep.join(columns))
    place = F.col("_metadata.file_path")
    file = F.coalesce(*[F.when(F.contains(place, F.lit(p.split("://")[-1].rstrip("/"))), F.lit(n)) for n, p in files.items()])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    named = lines.select(file.alias("file"), F.from_csv("value", fields, options).alias("r")).select("file", "r.*")
    rows = named.filter(F.col("_bad").isNull()).select("file", *[text_or_empty(c).alias(c) for c in columns])
    return rows, named.filter(F.col("_bad").isNotNull()).select("file", F.col("_bad").alias("record"))


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, NULL as ''."""
    return df.select(*[text_or_empty(c).alias(c) for c in df.columns])


def wanted_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the wanted columns that exist; Parquet reads nothing else."""
    return df.select(*existing(df, wanted))


def find_table(spark: SparkSession, name: str) -> DataFrame | None:
    """Catalog table by name in any case, or None."""
    for t in spark.catalog.listTables():
        if t.name.lower() == name.strip().lower():
            return spark.table(t.name)
    return None


@dataclass(frozen=True)
class ClaimSource:
    """Where one claim file keeps its claim id, service date and provider id."""

    name: str
    claim_id: str = "CLM_ID"
    date: str = "CLM_FROM_DT"
    npi: str = "ORG_NPI_NUM"


# Provider column of each claim file.
CLAIM_SOURCES = (
    ClaimSource("outpatient"),
    ClaimSource("carrier", npi="PRF_PHYSN_NPI"),
    ClaimSource("dme", npi="PRVDR_NPI"),
    ClaimSource("hha"),
    ClaimSource("hospice"),
    ClaimSource("inpatient"),
    ClaimSource("snf"),
)


def combine_sources(frames: dict[str, DataFrame], sources=CLAIM_SOURCES) -> DataFrame:
    """Claim id, date and provider of every available source as one frame.

    Sources without a frame, or whose frame lacks a needed column, are skipped.
    """
    parts = []
    for s in sources:
        df = frames.get(s.name)
        if df is None or not all(has_any(df, [c]) for c in (s.claim_id, s.date, s.npi)):
            continue
        parts.append(
            df.select(
                F.lit(s.name).alias("source"),
                F.col(s.claim_id).cast("string").alias("CLM_ID"),
                F.col(s.date).alias("DT"),
                F.col(s.npi).cast("string").alias("NPI"),
            )
        )
    if not parts:
        raise ValueError("no usable claim source")
    return reduce(DataFrame.unionByName, parts)
