"""Exact medians, robust Z-scores and percent ranks that survive hot groups.

``F.percentile`` keeps every distinct value of a group in one task. That is
fine for ordinary groups and stays the fast path here. A group with more rows
than ``hot_rows`` is instead narrowed by counting its rows in bins, which spreads
over all tasks and shuffles only counts, level by level until at most SLICE rows of a
group are left to sort. Both ways give the same medians, also for groups without values. A
count of the group sizes, run when the plan is built, decides between the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payerlens.operators.keyed import null_safe_join
from payerlens.operators.stages import settle

HOT_ROWS = 2_000_000
BINS = 1024
SLICE = 50_000
ROW = "__row"
ROBUST_Z_FACTOR = 0.6745


FINITE = "abs(value) < double('inf')"


def _bin(value, low, high, bins):
    """Bin of a value between the finite ends; infinities and NaN have bins of their own at the ends."""
    position = F.floor(F.try_divide(value - low, high - low) * bins)
    inner = F.coalesce(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("long")
    endless = F.lit(float("inf"))
    return F.when(F.isnan(value), bins + 1).when(value == endless, bins).when(value == -endless, -1).otherwise(inner)


def _narrowed(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The bin, or the two bins, of each group's median among the rows of its present range."""
    binned = rows.withColumn("bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    per_bin = binned.groupBy(*keys, "lower", "upper", "before", "bin").agg(
        F.count(F.lit(1)).alias("held"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    # At most `bins` rows per group, and one for each endless value, reach this window.
    run = Window.partitionBy(*keys).orderBy("bin")
    upto = per_bin.withColumn("upto", F.col("before") + F.sum("held").over(run))
    start = F.col("upto") - F.col("held")
    wanted = upto.withColumn("start", start).filter(
        ((start < F.col("lower")) & (F.col("lower") <= F.col("upto")))
        | ((start < F.col("upper")) & (F.col("upper") <= F.col("upto")))
    )
    # In two bins, the ranks are the last of the first and the first of the second.
    parted = F.count(F.lit(1)) > 1
    return wanted.groupBy(*keys, "lower", "upper").agg(
        F.min("start").alias("before"),
        F.sum("held").alias("held"),
        F.when(parted, F.min_by("most", "bin")).otherwise(F.min("least")).alias("least"),
        F.when(parted, F.max_by("least", "bin")).otherwise(F.max("most")).alias("most"),
        parted.alias("parted"),
    ).withColumns({"lo": F.col("least"), "hi": F.col("most")})


def _select_medians(values: DataFrame, keys: list[str], bins: int, most: int) -> DataFrame:
    """Medians of (keys, value) rows without gathering any group in one task.

    The values are read again at each level and stay where they are: only counts by bin are
    shuffled, and at the end the values of the last bins. A group's range is one row; the
    ranges are settled, so that their joins with the values are broadcast.
    """
    finite = F.when(F.expr(FINITE), F.col("value"))
    whole = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("held"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.min(finite).alias("lo"),
        F.max(finite).alias("hi"),
    )
    ranges = settle(
        whole.withColumns(
            {
                "lower": F.floor((F.col("held") + 1) / 2),
                "upper": F.floor(F.col("held") / 2 + 1),
                "before": F.lit(0).cast("bigint"),
                "parted": F.lit(False),
            }
        )
    )

    def inside():
        rows = null_safe_join(values, ranges.filter(~F.col("parted")), keys)
        return rows.filter(F.col("value").between(F.col("least"), F.col("most")))

    def largest():
        """Most rows left in a range; one whose values have met needs no further level."""
        return ranges.filter("least < most and not parted").agg(F.max("held")).first()[0] or 0

    before, left = None, largest()
    while left > most and left != before:
        done = ranges.filter("parted")
        ranges = settle(_narrowed(inside(), keys, bins).unionByName(done))
        before, left = left, largest()
    counted = inside().groupBy(*keys, "lower", "upper", "before", "value").agg(F.count(F.lit(1)).alias("cnt"))
    # At most ``most`` distinct values of each group are left.
    run = Window.partitionBy(*keys).orderBy("value")
    ranked = counted.withColumn("upto", F.col("before") + F.sum("cnt").over(run))
    low = F.min(F.when(F.col("upto") >= F.col("lower"), F.col("value")))
    high = F.min(F.when(F.col("upto") >= F.col("upper"), F.col("value")))
    middle = ranked.groupBy(*keys).agg(((low + high) / 2).alias("median"))
    between = ((F.col("least") + F.col("most")) / 2).alias("median")
    return middle.unionByName(ranges.filter("parted").select(*keys, between))


def _plain_medians(df: DataFrame, keys: list[str], columns: Sequence[str], suffix: str):
    return df.groupBy(*keys).agg(
        *[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(f"{c}{suffix}") for c in columns]
    )


def _split_medians(df, keys, columns, suffix, hot, bins, most):
    """Ordinary groups at once, the groups listed in ``hot`` by counting in bins; all groups are kept."""
    cold = _plain_medians(null_safe_join(df, hot, keys, "left_anti"), keys, columns, suffix)
    entries = [
        F.struct(F.lit(i).alias("measure"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)
    ]
    values = null_safe_join(df, hot, keys).select(*keys, F.inline(F.array(*entries))).filter("value is not null")
    picked = _select_medians(values, [*keys, "measure"], bins, most)
    wide = picked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("measure") == i, F.col("median"))).alias(f"{c}{suffix}")
            for i, c in enumerate(columns)
        ]
    )
    return cold.unionByName(null_safe_join(hot, wide, keys, "left"))


def _hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Keys of groups above the limit, or None; at most rows / hot_rows of them."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.filter(F.col("__n") > hot_rows).select(*keys)
    if hot.isEmpty():
        return None
    return settle(hot)


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    suffix: str = "_median",
    hot_rows: int = HOT_ROWS,
    bins: int = BINS,
    most: int = SLICE,
) -> DataFrame:
    """Exact median of each column per group, ignoring NULL; NULL keys are a group.

    Counts the group sizes when called to choose the way.
    """
    keys = list(keys)
    slim = df.select(*keys, *columns)
    hot = _hot_keys(slim, keys, hot_rows)
    if hot is None:
        return _plain_medians(slim, keys, columns, suffix)
    return _split_medians(slim, keys, columns, suffix, hot, bins, most)


def robust_z(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    min_size: int = 5,
    count_missing: bool = False,
    suffix: str = "_z",
    keep_stats: bool = False,
    hot_rows: int = HOT_ROWS,
    settled: bool = False,
) -> DataFrame:
    """Robust Z ``0.6745 * (x - median) / MAD`` of every feature inside its group.

    NULL where the MAD is zero or unknown or the group has fewer than
    ``min_size`` members (valid values, or all rows with ``count_missing``).
    The input is settled first (unless it is ``settled``, or as cheap to read again), then its
    group sizes decide between the direct medians and the ones for hot groups. The groups'
    medians are settled too: their size is known to the joins, which shuffle the rows
    only where the groups are too many to broadcast.
    """
    keys, rows = list(keys), df if settled else settle(df)
    size = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(f).alias(f"{f}__n") for f in features]
    )
    hot = _hot_keys(rows, keys, hot_rows)

    def medians(frame, columns, name):
        slim = frame.select(*keys, *columns)
        if hot is None:
            return _plain_medians(slim, keys, columns, name)
        return _split_medians(slim, keys, columns, name, hot, BINS, SLICE)

    stats = settle(null_safe_join(size, medians(rows, features, "__med"), keys, "left"))
    rows = null_safe_join(rows, stats, keys, "left")
    dev = {f"{f}__dev": F.abs(F.col(f).cast("double") - F.col(f"{f}__med")) for f in features}
    rows = rows.withColumns(dev)
    rows = null_safe_join(rows, settle(medians(rows, list(dev), "_mad")), keys, "left")
    z = {}
    for f in features:
        enough = F.col("__rows" if count_missing else f"{f}__n") >= min_size
        spread = F.col(f"{f}__dev_mad")
        z[f"{f}{suffix}"] = F.when(
            enough & (spread > 0),
            ROBUST_Z_FACTOR * (F.col(f).cast("double") - F.col(f"{f}__med")) / spread,
        )
    rows = rows.withColumns(z)
    drop = ["__rows", *dev]
    if keep_stats:
        rows = rows.withColumnsRenamed(
            {f"{f}__med": f"{f}_peer_median" for f in features}
            | {f"{f}__n": f"{f}_peer_count" for f in features}
            | {f"{f}__dev_mad": f"{f}_peer_mad" for f in features}
        )
    else:
        drop += [f"{f}{t}" for f in features for t in ("__med", "__n", "__dev_mad")]
    return rows.drop(*drop)


def percent_ranks(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Average-tie percent rank (times 100) over the whole frame, per measure.

    ``measures`` maps a column to the name of its rank column. A NULL has no rank, NaN ranks
    above all numbers, repeated rows are ranked each, an empty frame stays empty. The frame is
    settled first with a number for each row, and only these numbers travel with the values.
    No window spans the frame: the distinct values with their counts are dealt by range, so a
    value lies in one part however often it occurs; the parts' totals (a row per part and
    measure) give where each begins, and a window runs inside a part.
    """
    df = settle(df.withColumn(ROW, F.monotonically_increasing_id()))
    entries = [
        F.struct(F.lit(i).alias("measure"), F.col(c).cast("double").alias("value")) for i, c in enumerate(measures)
    ]
    long = df.select(ROW, F.inline(F.array(*entries))).filter("value is not null")
    counted = long.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("cnt"))
    parted = settle(
        counted.repartitionByRange("measure", "value").withColumn("part", F.spark_partition_id())
    )
    totals = parted.groupBy("measure", "part").agg(F.sum("cnt").alias("held"), F.min("value").alias("least"))
    # A row per part of a measure reaches these windows.
    ahead, whole = Window.partitionBy("measure").orderBy("least"), Window.partitionBy("measure")
    places = totals.select(
        "measure",
        "part",
        (F.sum("held").over(ahead) - F.col("held")).alias("start"),
        F.sum("held").over(whole).alias("n"),
    )
    within = Window.partitionBy("measure", "part").orderBy("value")
    upto = parted.withColumn("upto", F.sum("cnt").over(within))
    middle = F.col("start") + F.col("upto") - F.col("cnt") + 1 + (F.col("cnt") - 1) / 2
    ranked = upto.join(places, ["measure", "part"]).select(
        "measure", "value", (middle / F.col("n") * 100.0).alias("pct")
    )
    picked = [F.max(F.when(F.col("measure") == i, F.col("pct"))).alias(name) for i, name in enumerate(measures.values())]
    wide = long.join(ranked, ["measure", "value"]).groupBy(ROW).agg(*picked)
    return df.join(wide, ROW, "left").drop(ROW)
