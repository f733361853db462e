"""Shards by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with u a hash of the row's key and the child's name; the
smallest draw wins. A child wins in proportion to its weight, and a changed
weight moves rows only into or out of the subtrees whose weights change: draws of
the other children stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import join_small, ordered

#: name -> (weight, children) or, for a shard, (weight, number)
Tree = dict[str, tuple[float, "Tree | int"]]


def topology(shards: int, racks: int = 2, per_rack: int = 2, added: int = 0) -> Tree:
    """Shards in racks of ``per_rack`` and regions of ``racks``; each added shard in a region of its own.

    A region of its own makes the added shard the only place that gains rows.
    """
    tree: Tree = {}
    for shard in range(shards):
        region, rack = f"g{shard // (racks * per_rack)}", f"r{shard // per_rack}"
        weight, children = tree.get(region, (0.0, {}))
        held, leaves = children.get(rack, (0.0, {}))
        leaves[f"s{shard}"] = (1.0, shard)
        children[rack] = (held + 1.0, leaves)
        tree[region] = (weight + 1.0, children)
    for shard in range(shards, shards + added):
        tree[f"g+{shard}"] = (1.0, {f"r+{shard}": (1.0, {f"s{shard}": (1.0, shard)})})
    return tree


def place(key: Column, tree: Tree) -> Column:
    """The shard number of a key; a null key has a fixed place. Weights of 0 get no rows."""

    def draw(name: str, weight: float) -> Column:
        # 52 bits of the hash, never 0, as a number between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12) + F.lit(0.5)) / F.lit(2.0**52)
        return -F.log(u) / F.lit(weight)

    children = [(n, w, below) for n, (w, below) in sorted(tree.items()) if w > 0]
    if not children:
        raise ValueError("a subtree needs a child with a weight above 0")
    below = [F.lit(b) if isinstance(b, int) else place(key, b) for _, _, b in children]
    if len(children) == 1:
        return below[0]
    draws = [F.struct(draw(n, w).alias("d"), F.lit(i).alias("i")) for i, (n, w, _) in enumerate(children)]
    winner = F.least(*draws)["i"]
    return reduce(
        lambda rest, i: F.when(winner == i, below[i]).otherwise(rest),
        range(len(children) - 2, -1, -1),
        below[-1],
    )


def shard_rows(docs: DataFrame, shards: int, extra: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    size is the UTF-8 length plus 1 (null text: 1); slots count the rows of a shard from 0
    in doc_id order, repeated rows and null doc_ids included. Texts are read once
    and not shuffled; slots come from counts of each (partition, shard) and a running
    number inside it, so no shard is gathered in one task.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.col("doc_id")
    rows = rows.select(
        "*",
        place(key, topology(shards)).cast("int").alias("shard"),
        place(key, topology(shards, added=extra)).cast("int").alias("grown_shard"),
    )
    placed = settle(
        ordered(rows, "doc_id").select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
        )
    )
    from pyspark.sql import Window

    counts = settle(placed.groupBy("part", "shard").count())
    before = F.sum("count").over(
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select("part", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "shard").orderBy("place")) - 1
    return join_small(placed.withColumn("inside", inside), starts, ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        (F.col("before") + F.col("inside")).alias("slot"),
        "grown_shard",
    )
