"""Calendar-complete series and rolling baselines over previous periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_months(
    counts: DataFrame, keys: Sequence[str], period: str, zeros: Sequence[str]
) -> DataFrame:
    """Add the missing months between the first and last month of each key.

    Each row is repeated up to the month before the next one; the added months
    carry 0 in ``zeros`` and NULL elsewhere. One window by key, no join, and the
    rolling windows that follow reuse its partitioning.
    """
    month = F.to_date(F.concat(F.col(period), F.lit("-01")))
    ordered = Window.partitionBy(*keys).orderBy("__month")
    # With no key the series has one row per calendar month, so one task is enough.
    rows = counts.withColumn("__month", month)
    following = F.coalesce(
        F.add_months(F.lead("__month").over(ordered), F.lit(-1)), F.col("__month")
    )
    rows = rows.withColumn("__until", following).withColumn(
        "__at", F.explode(F.expr("sequence(__month, __until, interval 1 month)"))
    )
    return _zeroed(
        rows, F.col("__at") == F.col("__month"), keys, period, zeros, F.date_format("__at", "yyyy-MM")
    )


def fill_years(
    counts: DataFrame, keys: Sequence[str], year: str, zeros: Sequence[str]
) -> DataFrame:
    """As :func:`fill_months` for an integer year column."""
    ordered = Window.partitionBy(*keys).orderBy(year)
    rows = counts.withColumn(
        "__until", F.coalesce(F.lead(year).over(ordered) - 1, F.col(year))
    ).withColumn("__at", F.explode(F.sequence(F.col(year), F.col("__until"))))
    return _zeroed(rows, F.col("__at") == F.col(year), keys, year, zeros, F.col("__at"))


def _zeroed(rows, original, keys, period, zeros, label):
    columns = [c for c in rows.columns if not c.startswith("__")]
    out = []
    for c in columns:
        if c == period:
            out.append(label.alias(c))
        elif c in keys:
            out.append(F.col(c))
        elif c in zeros:
            out.append(F.when(original, F.col(c)).otherwise(F.lit(0)).alias(c))
        else:
            out.append(F.when(original, F.col(c)).alias(c))
    return rows.select(*out)


def previous(keys: Sequence[str], order: str, size: int):
    """Window of the ``size`` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-size, -1)


def previous_median(c: str, keys, order: str, size: int) -> Column:
    """Median of the previous rows, NULL until ``size`` of them exist."""
    w = previous(keys, order, size)
    return F.when(
        F.count(c).over(w) == size, F.percentile(F.col(c).cast("double"), F.lit(0.5)).over(w)
    )


def previous_mean(c: str, keys, order: str, size: int) -> Column:
    w = previous(keys, order, size)
    return F.when(F.count(c).over(w) == size, F.avg(F.col(c).cast("double")).over(w))


def previous_std(c: str, keys, order: str, size: int) -> Column:
    w = previous(keys, order, size)
    return F.when(F.count(c).over(w) == size, F.stddev_samp(F.col(c).cast("double")).over(w))


def previous_count(c: str, keys, order: str, size: int) -> Column:
    return F.count(c).over(previous(keys, order, size))


def previous_labels(period: str, keys, order: str, size: int, separator: str) -> Column:
    """Labels of the previous ``size`` periods, NULL until that many exist."""
    w = previous(keys, order, size)
    return F.when(
        F.count(period).over(w) == size,
        F.array_join(F.sort_array(F.collect_list(period).over(w)), separator),
    )
