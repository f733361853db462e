"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from payerlens.operators.stages import settle


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a stage, and what tells their state, observed while they are written."""
    digest = F.xxhash64("u", "v")
    seen = Observation()
    out = settle(
        edges.observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.sum(digest.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
            F.sum(F.shiftrightunsigned(digest, 32)).alias("high"),
        )
    )
    return out, tuple(seen.get[k] for k in ("n", "low", "high"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    ``links`` has two bigint columns. Alternates the large-star and the small-star
    step (every node links its larger, then its smaller neighbours to the smallest one)
    until nothing changes; each step is one minimum and one join, written to a stage, so
    neither a hub's neighbours nor the links as a whole meet in one place.
    """
    a, b = links.columns
    edges, state = _written(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges, now = _written(
            small.select(F.col("u"), F.col("m").alias("v"))
            .unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
