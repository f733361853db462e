"""One-row-per-key picks, duplicates, orphans and null-safe joins.

All picks are aggregates, not row_number windows, so a key that holds a large
part of the rows is reduced on the map side before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join where NULL keys equal each other; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], latest: bool):
    """One struct of the order values and the rest of the row is compared and carried."""
    payload = [c for c in df.columns if c not in keys]
    first = [(F.col(o) if isinstance(o, str) else o).alias(f"__order{i}") for i, o in enumerate(order)]
    choose = F.max if latest else F.min
    picked = df.groupBy(*keys).agg(choose(F.struct(*first, *payload)).alias("__row"))
    return picked.select(*keys, *[F.col("__row").getField(c).alias(c) for c in payload])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]):
    """Row with the largest order values per key.

    The remaining columns break ties, so the result does not depend on the
    row order. NULL counts as the smallest value.
    """
    return _pick(df, keys, order, latest=True)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]):
    """Row with the smallest order values per key; ties as in latest_per_key."""
    return _pick(df, keys, order, latest=False)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys carried by more than one row (NULL equals NULL), with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).filter("key_rows > 1")


def mark_repeated(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Flag every member of a repeated key. Only the repeated keys are joined back."""
    flagged = repeated_keys(df, keys).select(*keys, F.lit(True).alias(name))
    return null_safe_join(df, flagged, keys, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def mark_orphans(df: DataFrame, master: DataFrame, key: str, name: str) -> DataFrame:
    """Flag rows whose non-blank key is missing from the master.

    Text keys that are blank find no partner under names of their own, which spreads them
    over the partitions of the join.
    """
    from payerlens.functions.clean import is_blank

    blank = is_blank(key)
    found = F.col(key)
    if dict(df.dtypes)[key] == "string":
        spread = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(1000)))
        found = F.when(blank, spread).otherwise(found)
    known = master.select(F.col(key).alias("__key")).distinct().withColumn("__known", F.lit(True))
    return (
        df.withColumn("__key", found)
        .join(known, "__key", "left")
        .withColumn(name, F.col("__known").isNull() & ~blank)
        .select(*df.columns, name)
    )


def row_total(df: DataFrame, *aggregates: Column) -> Column:
    """One-row aggregate of a frame as a struct column for use in other frames.

    Runs as a scalar subquery, so attaching a grand total needs no join.
    """
    return df.agg(F.struct(*aggregates).alias("totals")).scalar()
