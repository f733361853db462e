"""Schema contracts, column resolution and row-count invariants.

Checks of the schema fail before any data is read. Checks of values and row counts are
part of the plan and fail when it is run; only ``drop_empty_columns`` runs a job itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """The input does not have the agreed shape."""


def require_exact_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Columns must be exactly the expected ones in the expected order."""
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    if missing or extra or list(df.columns) != list(expected):
        raise ContractError(
            f"column contract broken: missing={missing}, unexpected={extra}, "
            f"order_ok={not missing and not extra and list(df.columns) == list(expected)}"
        )
    return df


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ContractError("missing required columns: " + ", ".join(missing))
    return df


def require_tables(spark: SparkSession, names: Sequence[str]) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ContractError("missing required tables: " + ", ".join(missing))


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def first_existing(df: DataFrame, candidates: Sequence[str], cast: str = "string") -> Column:
    """First candidate column present in the schema, or a typed NULL."""
    for c in candidates:
        if c in df.columns:
            return F.col(c).cast(cast)
    return F.lit(None).cast(cast)


def has_any(df: DataFrame, candidates: Sequence[str]) -> bool:
    return any(c in df.columns for c in candidates)


def family(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name fits a pattern, in any case, in schema order."""
    rx = re.compile(pattern, re.IGNORECASE)
    return [c for c in df.columns if rx.fullmatch(c)]


def snake_name(name: str) -> str:
    lower = " ".join(name.lower().split()).replace("(age 65+)", "age65plus")
    return re.sub(r"[^a-z0-9]+", "_", lower).strip("_")


def normalize_headers(df: DataFrame, known: dict[str, str]) -> DataFrame:
    """Rename known headers by map, all others to snake case."""
    return df.toDF(*[known.get(c.strip(), snake_name(c)) for c in df.columns])


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.strip().lower())


def resolve_columns(df: DataFrame, standard: Sequence[str]) -> DataFrame:
    """Rename columns to their standard names, comparing letters and digits only."""
    found = {plain_name(c): c for c in df.columns}
    missing = [s for s in standard if plain_name(s) not in found]
    if missing:
        raise ContractError("columns not found: " + ", ".join(missing))
    return df.withColumnsRenamed({found[plain_name(s)]: s for s in standard})


def safe_identifiers(df: DataFrame, longest: int = 64) -> DataFrame:
    """Column names a database accepts: too long ones become column_<i>."""
    names = []
    for i, c in enumerate(df.columns):
        name = c.strip()
        if len(name) > longest:
            name = f"column_{i + 1}"
        names.append(name.translate(str.maketrans(" -/", "___", ",()")))
    return df.toDF(*names)


# Declared type fragments and the Spark type they stand for.
DECLARED_TYPES = (
    (("INT",), "bigint"),
    (("CHAR", "CLOB", "TEXT"), "string"),
    (("REAL", "FLOA", "DOUB"), "double"),
    (("DECIMAL", "NUMERIC"), "decimal(18,4)"),
    (("BLOB",), "binary"),
    (("DATE", "TIME"), "timestamp"),
)


def declared_type(text: str | None) -> str:
    upper = (text or "").upper()
    for fragments, spark_type in DECLARED_TYPES:
        if any(f in upper for f in fragments):
            return spark_type
    return "string"


def cast_declared(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Cast columns to their declared types; unreadable values become NULL."""
    return df.withColumns(
        {c: F.col(c).try_cast(declared_type(t)) for c, t in declared.items() if c in df.columns}
    )


def holding(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """The rows, which fail with the message where the condition is not true.

    Part of the plan: no job runs when it is built, and the check costs no pass of its own.
    """
    return df.filter(F.assert_true(F.coalesce(condition, F.lit(False)), message).isNull())


def numeric_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows as they are; a non-blank value that is not a number fails the run that reads it."""

    def bad(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        return (text != "") & text.try_cast("double").isNull()

    found = F.coalesce(*[F.when(bad(c), F.concat(F.lit(f"not numeric: {c}: "), F.col(c).cast("string"))) for c in columns])
    return holding(df, found.isNull(), found)


def require_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strict cast to double; see ``numeric_text``."""
    return numeric_text(df, columns).withColumns({c: F.col(c).try_cast("double") for c in columns})


def _with_count(df: DataFrame, counted: DataFrame, condition: Column, message: Column) -> DataFrame:
    """The rows, where a count that the plan takes beside them holds the condition (on ``found``)."""
    check = counted.agg(F.count(F.lit(1)).alias("found")).select(F.assert_true(condition, message).alias("ok"))
    return df.filter(check.scalar().isNull())


def require_row_count(df: DataFrame, expected: int) -> DataFrame:
    """The frame, which fails when it is run with another number of rows."""
    message = F.concat(F.lit(f"expected {expected} rows, found "), F.col("found").cast("string"))
    return _with_count(df, df, F.col("found") == expected, message)


def require_unchanged_count(after: DataFrame, before: DataFrame) -> DataFrame:
    """The frame, which fails when it is run if it has not as many rows as ``before``."""
    earlier = before.agg(F.count(F.lit(1))).scalar()
    message = F.concat(F.lit("expected "), earlier.cast("string"), F.lit(" rows as before, found "), F.col("found").cast("string"))
    return _with_count(after, after, F.col("found") == earlier, message)


SHEET_LIMIT = 1_048_576


def looks_truncated(rows: int) -> bool:
    """A row count at a spreadsheet's limit means the export was probably cut off."""
    return rows >= SHEET_LIMIT - 1


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value. One aggregate over the frame decides."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")
