"""Isolation forest: trees fitted on small samples, scored in column expressions.

Each of the trees sees at most 256 rows chosen by hash (Liu, Ting and Zhou,
2008), so fitting needs no more than trees x 256 rows however large the input.
Fitting one such sample is the only Python step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 256
TREES = 100
EULER = 0.5772156649015329
_NODES = "feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"


def average_depth(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, limit: int, rng: np.random.Generator) -> dict[str, list]:
    nodes = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}
    pending = [(values, 0, -1, "")]
    while pending:
        rows, depth, parent, side = pending.pop()
        at = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = at
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(values.shape[1])
        usable = np.flatnonzero(spread > 0)
        split = depth < limit and len(rows) > 1 and len(usable) > 0
        feature = int(rng.choice(usable)) if split else -1
        cut = 0.0
        if split:
            low, high = rows[:, feature].min(), rows[:, feature].max()
            cut = float(rng.uniform(low, high))
            inside = rows[:, feature] < cut
            pending.append((rows[~inside], depth + 1, at, "right"))
            pending.append((rows[inside], depth + 1, at, "left"))
        nodes["feature"].append(feature)
        nodes["threshold"].append(cut)
        nodes["left"].append(-1)
        nodes["right"].append(-1)
        nodes["depth"].append(0.0 if split else depth + average_depth(len(rows)))
    return nodes


def fit(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 7,
    oversample: float = 2.0,
) -> DataFrame:
    """One row of node arrays per tree.

    A tree draws rows by hash at the rate ``oversample * sample / rows`` and keeps the
    ``sample`` lowest draws; fewer come only from tables with hardly more rows than that.
    """
    features = list(features)
    total = df.agg(F.count(F.lit(1))).scalar()
    rate = F.lit(sample * oversample) / total

    def draw(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.col("__rate"))
    rows = df.withColumn("__rate", rate).select(
        key, *[F.col(f).cast("double").alias(f) for f in features], F.explode(chosen).alias("tree")
    ).withColumn("draw", draw(F.col("tree")))
    limit = math.ceil(math.log2(sample))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        part = part.nsmallest(sample, ["draw"])
        nodes = _grow(part[features].to_numpy(float), limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "size": [len(part)], **{k: [v] for k, v in nodes.items()}})

    return rows.groupBy("tree").applyInPandas(grow, f"tree int, size int, {_NODES}")


def score(
    df: DataFrame, trees: DataFrame, features: Sequence[str], name: str = "anomaly_score", sample: int = SAMPLE
) -> DataFrame:
    """Add the anomaly score 2 ** (-mean path / expected path), near 1 for outliers.

    The trees travel as one constant (at most trees x (2 * sample - 1) nodes); ``sample`` is the
    one that they were fitted with.
    """
    forest = trees.agg(
        F.struct(
            F.array_sort(F.collect_list(F.struct("tree", "size", "feature", "threshold", "left", "right", "depth"))).alias("trees"),
            F.max("size").alias("size"),
        )
    ).scalar()
    point = F.array(*[F.col(f).cast("double") for f in features])
    depth = math.ceil(math.log2(sample)) + 1

    def path(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], node)
            goes_left = F.get(F.col("__point"), feature) < F.get(tree["threshold"], node)
            child = F.when(goes_left, F.get(tree["left"], node)).otherwise(F.get(tree["right"], node))
            return F.when(feature < 0, node).otherwise(child)

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
        return F.get(tree["depth"], leaf)

    rows = df.withColumn("__point", point).withColumn("__forest", forest)
    paths = F.transform(F.col("__forest.trees"), path)
    mean = F.aggregate(paths, F.lit(0.0), lambda a, x: a + x) / F.size(F.col("__forest.trees"))
    n = F.col("__forest.size").cast("double")
    expected = F.when(
        n > 2, 2.0 * (F.log(n - 1) + EULER) - 2.0 * (n - 1) / n
    ).otherwise(1.0)
    return rows.withColumn(name, F.pow(F.lit(2.0), -mean / expected)).drop("__point", "__forest")
