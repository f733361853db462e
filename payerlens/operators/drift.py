"""Population stability index (PSI) over counted categories and weighted bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

# Fixed values.
PSI_FLOOR = 0.0001
MIN_CATEGORY_SHARE = 0.02
MIN_CATEGORIES = 2
RARE = "OTHER_RARE"
WEIGHTED_PSI_FLOOR = 1e-6


def psi_term(actual: Column, expected: Column, floor: float = PSI_FLOOR) -> Column:
    """Contribution of one category, both shares lifted to the floor."""
    a, e = F.greatest(actual, F.lit(floor)), F.greatest(expected, F.lit(floor))
    return (a - e) * F.log(a / e)


def category_counts(
    df: DataFrame, keys: Sequence[str], fields: dict[str, Column | str], name: str = "cnt"
) -> DataFrame:
    """Count every (field, category) per key in one pass; NULL categories are left out."""
    entries = [
        F.struct(
            F.lit(label).alias("field"),
            (F.col(c) if isinstance(c, str) else c).cast("string").alias("category"),
        )
        for label, c in fields.items()
    ]
    return (
        df.select(*keys, F.explode(F.array(*entries)).alias("e"))
        .select(*keys, "e.field", "e.category")
        .filter("category is not null")
        .groupBy(*keys, "field", "category")
        .agg(F.count(F.lit(1)).alias(name))
    )


def shares(counts: DataFrame, keys: Sequence[str], count: str, name: str = "share") -> DataFrame:
    """Share of each category within its key."""
    totals = counts.groupBy(*keys).agg(F.sum(count).alias("__total"))
    return counts.join(totals, list(keys)).withColumn(name, F.col(count) / F.col("__total"))


def _totals(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Baseline and current totals of each key next to its categories.

    A key's rows are one per category of a code set, so a window by key holds a
    bounded number of rows however many records were counted.
    """
    by_key = Window.partitionBy(*keys)
    return both.withColumns(
        {"base_n": F.sum("base").over(by_key), "curr_n": F.sum("curr").over(by_key)}
    ).filter("base_n > 0 and curr_n > 0")


def _side_by_side(baseline: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and category with both counts, 0 where a side lacks it."""
    left = baseline.select(*keys, "category", F.col("cnt").alias("base"), F.lit(0).alias("curr"))
    right = current.select(*keys, "category", F.lit(0).alias("base"), F.col("cnt").alias("curr"))
    return (
        left.unionByName(right)
        .groupBy(*keys, "category")
        .agg(F.sum("base").alias("base"), F.sum("curr").alias("curr"))
    )


def _score(both: DataFrame, keys: Sequence[str], floor: float, *more: Column) -> DataFrame:
    term = psi_term(F.col("curr") / F.col("curr_n"), F.col("base") / F.col("base_n"), floor)
    return both.groupBy(*keys).agg(F.sum(term).alias("psi"), *more)


def categorical_psi(
    baseline: DataFrame, current: DataFrame, keys: Sequence[str], floor: float = PSI_FLOOR
) -> DataFrame:
    """PSI per key of two count frames (keys, category, cnt).

    Keys missing on either side give no row. Categories missing on one side
    count with the floor share.
    """
    keys = list(keys)
    both = _totals(_side_by_side(baseline, current, keys), keys)
    sizes = [F.max("base_n").alias("baseline_rows"), F.max("curr_n").alias("current_rows")]
    return _score(both, keys, floor, *sizes)


def common_category_psi(
    baseline: DataFrame, current: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """As categorical_psi with uncommon baseline categories merged into one.

    Categories below 2 % of the baseline are uncommon; keys with fewer than two
    common categories give no row. ``kept`` counts the common ones.
    """
    keys = list(keys)
    both = _totals(_side_by_side(baseline, current, keys), keys)
    common = F.col("base") / F.col("base_n") >= MIN_CATEGORY_SHARE
    flagged = both.withColumn("common", common).withColumn(
        "kept", F.sum(F.col("common").cast("int")).over(Window.partitionBy(*keys))
    )
    merged = (
        flagged.filter(F.col("kept") >= MIN_CATEGORIES)
        .withColumn("category", F.when(F.col("common"), F.col("category")).otherwise(RARE))
        .groupBy(*keys, "kept", "base_n", "curr_n", "category")
        .agg(F.sum("base").alias("base"), F.sum("curr").alias("curr"))
    )
    return _score(merged, keys, PSI_FLOOR, F.max("kept").alias("kept"))


ALL_ROWS = "all rows"


def rolling_psi(
    df: DataFrame,
    group: str,
    month: str,
    fields: dict[str, Column | str],
    baseline_months: int = 6,
    min_baseline_rows: int = 1000,
    min_current_rows: int = 300,
) -> DataFrame:
    """PSI of each (group, field, month) against the previous observed months.

    The records are read once to count categories, and all rows, by month; the
    counts are settled. A month's baseline is built by handing each counted
    category on to the six months after it, so neither records nor months are
    joined with each other.
    """
    counts = settle(category_counts(df, [group, month], fields | {ALL_ROWS: F.lit(ALL_ROWS)}))
    # One row per group and calendar month.
    order = Window.partitionBy(group).orderBy(month)
    before = order.rowsBetween(-baseline_months, -1)
    months = (
        counts.filter(F.col("field") == ALL_ROWS)
        .select(group, month, F.col("cnt").alias("current_rows"))
        .withColumns(
            {
                "idx": F.row_number().over(order),
                "baseline_rows": F.sum("current_rows").over(before),
                "baseline_periods": F.array_join(
                    F.sort_array(F.collect_list(month).over(before)), ","
                ),
            }
        )
    )
    ready = months.filter(
        (F.col("idx") > baseline_months)
        & (F.col("baseline_rows") >= min_baseline_rows)
        & (F.col("current_rows") >= min_current_rows)
    )
    indexed = counts.filter(F.col("field") != ALL_ROWS).join(
        months.select(group, month, "idx"), [group, month]
    )
    keys = [group, "field", "idx"]
    baseline = (
        indexed.select(
            group,
            "field",
            "category",
            "cnt",
            F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + baseline_months)).alias("idx"),
        )
        .groupBy(*keys, "category")
        .agg(F.sum("cnt").alias("cnt"))
    )
    psi = common_category_psi(baseline, indexed.select(*keys, "category", "cnt"), keys)
    return psi.join(ready, [group, "idx"]).select(
        group,
        "field",
        F.col(month).alias("month"),
        F.col("psi").alias("psi_score"),
        "baseline_periods",
        "baseline_rows",
        "current_rows",
        (F.col("kept") + 1).alias("baseline_categories"),
    )


def population_psi(df: DataFrame, group: str, category: str) -> DataFrame:
    """PSI of each group's category mix against the whole frame's mix.

    Only categories seen in a group are joined; the part of the score due to
    absent ones is the whole baseline's contribution minus the seen part.
    """
    text = F.trim(F.col(category).cast("string"))
    counts = settle(
        df.select(group, text.alias("category"))
        .filter("category is not null")
        .groupBy(group, "category")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    overall = counts.groupBy("category").agg(F.sum("cnt").alias("cnt"))
    n = overall.agg(F.sum("cnt")).scalar()
    overall = overall.withColumn("share", F.col("cnt") / n)
    common, absent = F.col("share") >= MIN_CATEGORY_SHARE, F.lit(0.0)
    facts = overall.agg(
        F.struct(
            F.count(F.when(common, 1)).alias("kept"),
            F.coalesce(F.sum(F.when(~common, F.col("share"))), F.lit(0.0)).alias("rare"),
            F.sum(F.when(common, psi_term(absent, F.col("share")))).alias("unseen"),
        )
    ).scalar()
    rare = facts["rare"]
    base_total = facts["unseen"] + F.when(rare > 0, psi_term(absent, rare)).otherwise(0.0)
    # At most 50 categories can hold 2 % each.
    expected = overall.filter(common).select("category", F.col("share").alias("expected"))
    seen = (
        counts.join(F.broadcast(expected), "category", "left")
        .withColumn(
            "category", F.when(F.col("expected").isNull(), RARE).otherwise(F.col("category"))
        )
        .groupBy(group, "category")
        .agg(F.sum("cnt").alias("cnt"), F.max("expected").alias("expected"))
        .withColumn("expected", F.coalesce(F.col("expected"), rare))
    )
    totals = seen.groupBy(group).agg(F.sum("cnt").alias("n"))
    joined = seen.join(totals, group)
    in_baseline = F.col("expected") > 0
    gain = psi_term(F.col("cnt") / F.col("n"), F.col("expected")) - F.when(
        in_baseline, psi_term(absent, F.col("expected"))
    ).otherwise(0.0)
    return (
        joined.groupBy(group)
        .agg(F.sum(gain).alias("gain"))
        .select(
            group,
            F.when(facts["kept"] >= MIN_CATEGORIES, F.col("gain") + base_total).alias("psi"),
        )
    )


def bin_weights(value: Column, weight: Column, edges: Sequence[float]) -> Column:
    """Aggregate: array of the total weight per bin.

    Bins are closed below, the last one on both sides.
    """
    out = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        upper = value <= high if i == len(edges) - 2 else value < high
        inside = (value >= low) & upper
        weight_in = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
        out.append(F.sum(F.when(inside, weight_in).otherwise(0.0)))
    return F.array(*out)


def _array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def weighted_psi(df: DataFrame, base: str, current: str, name: str = "psi") -> DataFrame:
    """Add the PSI of two weighted histograms kept as arrays of bin totals.

    Shares are lifted to the floor and brought back to a total of one; never
    negative, and 0 for an empty current histogram.
    """
    def share(c: str) -> Column:
        total = F.col(f"__{c}_total")
        lifted = F.lit(WEIGHTED_PSI_FLOOR)
        return F.transform(
            F.col(c), lambda x: F.greatest(F.when(total > 0, x / total).otherwise(0.0), lifted)
        )

    steps = df
    for c in (base, current):
        steps = steps.withColumn(f"__{c}_total", _array_sum(F.col(c)))
        steps = steps.withColumn(f"__{c}_share", share(c))
        steps = steps.withColumn(f"__{c}_all", _array_sum(F.col(f"__{c}_share")))
    terms = F.zip_with(
        f"__{current}_share",
        f"__{base}_share",
        lambda x, y: (x / F.col(f"__{current}_all") - y / F.col(f"__{base}_all"))
        * F.log((x / F.col(f"__{current}_all")) / (y / F.col(f"__{base}_all"))),
    )
    score = F.greatest(_array_sum(terms), F.lit(0.0))
    steps = steps.withColumn(name, F.when(F.col(f"__{current}_total") > 0, score).otherwise(0.0))
    return steps.drop(*[f"__{c}_{t}" for c in (base, current) for t in ("total", "share", "all")])
