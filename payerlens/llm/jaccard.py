"""Exact join of documents by the Jaccard similarity of their word n-grams.

A document is its set of n-gram hashes and a point: the numbers of its n-grams in
``GROUPS`` hash groups. The intersection of two sets is at most the sum of the
coordinate minima of their points. Linked sets of sizes a and b share at least
4/9 (a + b) n-grams at 0.8, so a pair below that bound, or an R-tree box below it, is
out; survivors are compared exactly.

Points meet where they can be near: equal sets become one node; of a set of n the
smallest n - ceil(0.8 n) + 1 n-grams in one global order are its keys, and linked sets
share a key. Frequent keys go to the end of that order, which spares buckets of
passages that many documents share. First each node is held against the best-connected
node that it shares keys with. Then buckets with nodes of different components are
searched by an R-tree of their points, boxes of one component left out: at first each
node of a bucket gives its nearest point of another component, which joins groups of
near copies in linear work, then all pairs that are still left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import join_rows, join_small, map_arrow, small_slices, text_key, whole_text
from .components import components
from .hashing import grams, scramble, words_of

GROUPS = 256
#: Hash groups of the finer points that distinct survivors are held against before their sets.
FINE = 1024
#: A key is frequent if this share of a partition's documents, and SEEN of them, have it.
FREQUENT = 0.002
SEEN = 8
#: The most frequent keys, so many at most, go last in the order.
MOST_FREQUENT = 100_000
LEAF = 32
#: Every second byte, every second pair of bytes of a word.
_BYTES, _PAIRS = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0000FFFF0000FFFF)
#: Larger buckets are searched as pairs of chunks.
CHUNK = 20_000
#: Keys that one reducing block holds on average.
BLOCK = 250_000


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; fewer words are one n-gram."""
    words = words_of(texts)
    whole = grams(words.hashes, size)
    out = []
    for r in range(len(texts)):
        own = words.of(r)
        n = own.stop - own.start
        if n >= size:
            found = np.sort(whole[own.start : own.stop - size + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif n:
            out.append(scramble(grams(words.hashes[own], n) ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def name(found: np.ndarray) -> int:
    """The node of a set: 63 bits of a digest of it."""
    raw = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little") >> 1


def least_common(n: int, percent: int) -> int:
    """Fewest n-grams that a set of n shares with any linked set."""
    return -(-n * percent // 100)


def keys(found: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The set's first n - least_common + 1 hashes, frequent ones last in the order."""
    n = len(found) - least_common(len(found), percent) + 1
    if not len(frequent):
        return found[:n]
    near = np.searchsorted(frequent, found).clip(max=len(frequent) - 1)
    last = frequent[near] == found
    return np.concatenate([found[~last], found[last]])[:n]


def point(found: np.ndarray, groups: int) -> bytes:
    """Numbers of the hashes in each group, one byte each, or four where one byte is too small."""
    counts = np.bincount(((found >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def points(packed: list[bytes], groups: int) -> np.ndarray:
    """The points as rows."""
    if all(len(p) == groups for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, groups)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == groups else np.uint32).astype(np.uint32) for p in packed])


def overlap(point: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of the coordinate minima of the points and ``q``, which is one point or as many."""
    least = np.minimum(point, q)
    if least.dtype != np.uint8 or least.shape[1] % 8 or least.shape[1] > 1024:
        return least.sum(axis=1, dtype=np.int64)
    # eight bytes at once: 16-bit lanes of a word hold the sums of up to 1024 bytes
    words = least.view(np.uint64)
    odd = (words >> np.uint64(8)) & _BYTES
    words &= _BYTES
    words += odd
    lanes = words.sum(axis=1, dtype=np.uint64)
    lanes = (lanes & _PAIRS) + ((lanes >> np.uint64(16)) & _PAIRS)
    return ((lanes & np.uint64(0xFFFFFFFF)) + (lanes >> np.uint64(32))).astype(np.int64)


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, key, n, node and point of every row (doc_id, key, text); also rows (often, node) for the keys frequent in a partition."""
    none = np.zeros(0, np.uint64)

    def work(batches):
        often: dict[int, int] = {}
        seen: set[int] = set()
        for batch in small_slices(batches):
            found = sets_of(batch.column(2), size)
            nodes = [name(s) if len(s) else None for s in found]
            new = [s for s, v in zip(found, nodes) if v is not None and v not in seen]
            seen.update(v for v in nodes if v is not None)
            if new:
                each, counts = np.unique(np.concatenate([keys(s, none, percent) for s in new]), return_counts=True)
                for k, c in zip(each[counts > 1].view(np.int64).tolist(), counts[counts > 1].tolist()):
                    often[k] = often.get(k, 0) + c
            if len(often) > 1_000_000:  # keys seen twice in few slices are not frequent
                often = {k: c for k, c in often.items() if c > len(seen) * FREQUENT / 2}
            if len(seen) > 500_000:
                seen = set()
            n = len(found)
            sizes, packed = [len(s) for s in found], [point(s, GROUPS) for s in found]
            yield [batch.column(0), batch.column(1), sizes, nodes, packed, [None] * n]
        hot = {k: c for k, c in often.items() if c >= max(SEEN, FREQUENT * len(seen))}
        if hot:
            n = len(hot)
            yield [[None] * n, [None] * n, [None] * n, list(hot), [None] * n, list(hot.values())]

    schema = "doc_id bigint, key bigint, n bigint, node bigint, point binary, often bigint"
    return map_arrow(docs.select("doc_id", "key", "text"), work, schema)


def _buckets(docs: DataFrame, frequent: np.ndarray, blocks: int, size: int, percent: int) -> DataFrame:
    """(key, node) of every key that two nodes of near enough sizes share.

    Tasks send their keys packed by block, each set once; a block's keys are sorted as
    arrays. A node stays in a bucket if its next smaller or larger one there is in reach.
    """

    def send(batches):
        seen: set[int] = set()
        for batch in small_slices(batches):
            each, of, many = [], [], []
            for s in sets_of(batch.column(1), size):
                if not len(s) or (v := name(s)) in seen:
                    continue
                seen.add(v)
                own = keys(s, frequent, percent)
                each.append(own)
                of.append(np.full(len(own), v, np.int64))
                many.append(np.full(len(own), len(s), np.int32))
            if len(seen) > 500_000:
                seen = set()
            if not each:
                continue
            key, node, sizes = np.concatenate(each), np.concatenate(of), np.concatenate(many)
            block = (scramble(key) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) > 0, [True]]))
            runs = [order[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield [
                [int(block[r[0]]) for r in runs],
                [key[r].tobytes() for r in runs],
                [node[r].tobytes() for r in runs],
                [sizes[r].tobytes() for r in runs],
            ]

    def meet(batches):
        held, block = ([], [], []), None

        def close():
            key, node = (np.frombuffer(b"".join(held[i]), np.int64) for i in range(2))
            n = np.frombuffer(b"".join(held[2]), np.int32).astype(np.int64)
            order = np.lexsort((node, n, key))
            key, node, n = key[order], node[order], n[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node, n = key[new], node[new], n[new]
            near = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            shared = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            return [key[shared], node[shared]]

        for batch in batches:
            for at, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block:
                    if held[0]:
                        yield close()
                    held, block = ([], [], []), at
                for column, value in zip(held, packed):
                    column.append(value)
        if held[0]:
            yield close()

    sent = map_arrow(docs.select("doc_id", "text"), send, "block int, keys binary, nodes binary, sizes binary")
    return map_arrow(sent.repartition("block").sortWithinPartitions("block"), meet, "key bigint, node bigint")


def _bags(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, point, hashes): sets and fine points of the wanted nodes (node, rep), from their documents' texts."""

    def work(batches):
        for batch in small_slices(batches):
            nodes = batch.column(0).to_pylist()
            kept = [(v, s) for v, s in zip(nodes, sets_of(batch.column(1), size)) if len(s) and name(s) == v]
            yield [
                [v for v, _ in kept],
                [len(s) for _, s in kept],
                [point(s, FINE) for _, s in kept],
                [s.tobytes() for _, s in kept],
            ]

    of = F.coalesce("rep.doc_id", "rep.key").alias("at")
    texts = join_small(docs.select("at", "text"), wanted.select(of, "node"), ["at"])
    schema = "node bigint, n bigint, point binary, hashes binary"
    return map_arrow(texts.select("node", "text"), work, schema).dropDuplicates(["node"])


def _near(pairs: DataFrame, nodes: DataFrame, groups: int, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the bound on their points."""
    of = nodes.select("node", "n", "point")
    left = of.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    right = of.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy() for i in (2, 3))
                left, right = (points(batch.column(i).to_pylist(), groups) for i in (4, 5))
                bound = overlap(left, right)
                kept = pa.array((100 + percent) * bound >= percent * (na + nb))
                yield [batch.column(0).filter(kept), batch.column(1).filter(kept)]

    return map_arrow(both, work, "a bigint, b bigint")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough: by finer points, then by their n-grams."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    bags = settle(_bags(docs, nodes.join(both, "node", "left_semi"), size))
    close = settle(_near(pairs, bags, FINE, percent))
    left = bags.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = bags.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = close.join(left, "a").join(right, "b").select("a", "b", "ha", "hb")

    def work(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                # both are sorted and distinct, so a shared hash is a pair of equal neighbours
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                kept.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = pa.array(kept, pa.bool_())
            yield [batch.column(0).filter(kept), batch.column(1).filter(kept)]

    return map_arrow(both, work, "a bigint, b bigint")


class Tree:
    """R-tree over count points: boxes of LEAF points, and boxes of LEAF boxes above them."""

    def __init__(self, point: np.ndarray, n: np.ndarray, label: np.ndarray):
        # sorted tiles: by size, then by the largest group within runs of equal length
        order = np.lexsort((point.argmax(axis=1), n))
        self.order, self.point, self.n, self.label = order, point[order], n[order], label[order]
        self.levels = []
        top, least = self.point, self.n
        first, last = self.label, self.label
        while len(top) > LEAF or not self.levels:
            cut = np.arange(0, len(top), LEAF)
            top = np.maximum.reduceat(top, cut, axis=0)
            least = np.minimum.reduceat(least, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            self.levels.append((top, least, first, last))

    def search(self, q: np.ndarray, n: int, label: int, percent: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the tree's order from ``start`` on, overlap) of the points that may be linked to the query."""

        found = None
        for top, least, first, last in reversed(self.levels):
            found = np.arange(len(top)) if found is None else _below(found, len(top))
            found = found[(first[found] != label) | (last[found] != label)]
            found = found[(100 + percent) * overlap(top[found], q) >= percent * (n + least[found])]
        found = _below(found, len(self.n))
        found = found[found >= start]
        sizes = self.n[found]
        found = found[(self.label[found] != label) & (100 * sizes >= percent * n) & (100 * n >= percent * sizes)]
        bound = self._overlap(found, q)
        ok = (100 + percent) * bound >= percent * (n + self.n[found])
        return found[ok], bound[ok]

    def _overlap(self, found: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Overlaps of the points at these rising places, read as a run where they fill most of one."""
        if not len(found):
            return np.zeros(0, np.int64)
        first, stop = int(found[0]), int(found[-1]) + 1
        if 2 * len(found) < stop - first:
            return overlap(self.point[found], q)
        return overlap(self.point[first:stop], q)[found - first]


def _below(boxes: np.ndarray, count: int) -> np.ndarray:
    found = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
    return found[found < count]


def survivors(
    node: np.ndarray,
    label: np.ndarray,
    n: np.ndarray,
    point: np.ndarray,
    side: np.ndarray,
    percent: int,
    nearest: bool = False,
) -> Iterator[tuple[int, int]]:
    """Pairs of nodes of one bucket that the points don't rule out; each node's nearest only, if asked.

    ``side`` is 0 for all rows of a whole bucket, else -1 and 1: only pairs across.
    """
    across = bool(side.any())
    left, right = (side < 0, side > 0) if across else (np.ones(len(n), bool),) * 2
    if not left.any() or not right.any():
        return
    tree = Tree(point[right], n[right], label[right])
    names = node[right][tree.order]
    if across:
        queries = zip(node[left], point[left], n[left], label[left])
    else:
        queries = zip(names, tree.point, tree.n, tree.label)
    for i, (mark, q, size, own) in enumerate(queries):
        found, bound = tree.search(q, size, own, percent, 0 if across or nearest else i + 1)
        if nearest and len(found):
            found = found[[int((bound / (tree.n[found] + size)).argmax())]]
        for j in found:
            yield mark, names[j]


def small_survivors(
    group: np.ndarray,
    node: np.ndarray,
    label: np.ndarray,
    n: np.ndarray,
    point: np.ndarray,
    percent: int,
    nearest: bool = False,
) -> np.ndarray:
    """The same (two rows of nodes) for whole buckets of at most LEAF rows, which are a box each, side by side."""
    first, second = [], []
    for d in range(1, min(LEAF, len(group))):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        j = i + d
        ok = (label[i] != label[j]) & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
        first.append(i[ok])
        second.append(j[ok])
    if not first:
        return np.zeros((2, 0), np.int64)
    i, j = np.concatenate(first), np.concatenate(second)
    if not nearest and len(i):
        pair = np.unique(np.sort(np.stack([node[i], node[j]]), axis=0), axis=1, return_index=True)[1]
        i, j = i[pair], j[pair]
    bound = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 50_000):
        p, q = i[at : at + 50_000], j[at : at + 50_000]
        bound[at : at + 50_000] = overlap(point[p], point[q])
    ok = (100 + percent) * bound >= percent * (n[i] + n[j])
    i, j, near = i[ok], j[ok], (bound[ok] / (n[i[ok]] + n[j[ok]]))
    if nearest and len(i):
        ends, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
        order = np.lexsort((pair, -near[pair], ends))
        best = order[np.concatenate([[True], np.diff(ends[order]) > 0])]
        pair = np.unique(pair[best])
        i, j = i[pair], j[pair]
    return np.stack([node[i], node[j]])


def _searched(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Distinct surviving pairs of rows (key, chunk, side, node, label, n, point), bucket by bucket."""

    def found(batch: pa.RecordBatch) -> list:
        """Pairs of whole buckets."""
        key, chunk, side, node, label, n = (batch.column(i).to_numpy() for i in range(6))
        point = points(batch.column(6).to_pylist(), GROUPS)
        edges = np.flatnonzero(
            np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]), [True]])
        )
        sizes = np.diff(edges)
        group = np.repeat(np.arange(len(sizes)), sizes)
        parted = np.logical_or.reduceat(side != 0, edges[:-1])
        small = ((sizes <= LEAF) & ~parted)[group]
        out = [small_survivors(group[small], node[small], label[small], n[small], point[small], percent, nearest)]
        for g in np.flatnonzero((sizes > LEAF) | parted).tolist():
            own = slice(edges[g], edges[g + 1])
            pairs = list(survivors(node[own], label[own], n[own], point[own], side[own], percent, nearest))
            if pairs:
                out.append(np.array(pairs, np.int64).T)
        a, b = np.concatenate(out, axis=1)
        return [np.minimum(a, b), np.maximum(a, b)]

    def work(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # the last bucket of a batch may go on in the next one
            go = np.flatnonzero((key != key[-1]) | (chunk != chunk[-1]))
            cut = int(go[-1]) + 1 if len(go) else 0
            if not cut and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (key[-1], chunk[-1]):
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
            yield from map(found, whole)
            held = [batch.slice(cut)]
        if held:
            yield from map(found, pa.Table.from_batches(held).combine_chunks().to_batches())

    dealt = (
        rows.select("key", "chunk", "side", "node", "label", "n", "point")
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk")
    )
    return map_arrow(dealt, work, "a bigint, b bigint").distinct()


def _across(buckets: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, chunk, side, node, label, n, point) of the buckets with nodes of several components."""
    labelled = settle(
        join_small(buckets, roots, ["node"], "left").select(
            "key", "node", F.coalesce("root", "node").alias("label")
        )
    )
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("df"))
        .where("low < high")
        .select("key", "df")
    )
    inside = labelled.join(mixed, "key").join(nodes.select("node", "n", "point"), "node")
    parts = F.ceil(F.col("df") / F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda j: F.struct(
            F.least(own, j).alias("i"),
            F.greatest(own, j).alias("j"),
            F.when(own == j, 0).when(own < j, -1).otherwise(1).alias("side"),
        ),
    )
    chunk = (F.col("p.i") * F.lit(1 << 20) + F.col("p.j")).alias("chunk")
    return inside.select("*", F.explode(pair).alias("p")).select(
        "key", chunk, "p.side", "node", "label", "n", "point"
    )


def _classified(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, key, n of every row and the first row (no_id, doc_id, key) of its component, null without n-grams."""
    of = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), whole_text(docs).alias("text"), text_key(docs).alias("key")
    )
    texts = of.withColumn("at", F.coalesce("doc_id", "key"))
    settled = settle(_sets(texts, size, percent))
    rows = settled.where("often IS NULL")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = settle(
        rows.where("n > 0")
        .groupBy("node")
        .agg(F.min(row).alias("rep"), F.max("n").alias("n"), F.max("point").alias("point"))
    )
    frequent = np.sort(
        settled.where("often IS NOT NULL")
        .groupBy("node")
        .agg(F.sum("often").alias("often"))
        .orderBy(F.desc("often"), "node")
        .limit(MOST_FREQUENT)
        .select("node")
        .toPandas()["node"]
        .to_numpy(np.int64)
        .view(np.uint64)
    )
    many = nodes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = settle(_buckets(texts, frequent, max(16, int(many / BLOCK)), size, percent))

    # each node against the best-connected node that it shares keys with
    score = buckets.groupBy("node").agg(F.count(F.lit(1)).alias("score"))
    scored = join_small(buckets, score, ["node"])
    pivot = scored.groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("pivot"))
    star = (
        buckets.join(pivot, "key")
        .where("node <> pivot")
        .groupBy("node", "pivot")
        .count()
        .groupBy("node")
        .agg(F.max(F.struct("count", "pivot"))["pivot"].alias("pivot"))
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )
    near = settle(_near(star, nodes, GROUPS, percent))
    roots = components(_linked(near, texts, nodes, size, percent))
    for nearest in (True, False):
        found = settle(_searched(_across(buckets, roots, nodes), percent, nearest))
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(known.unionByName(_linked(found, texts, nodes, size, percent)))

    named = settle(
        join_small(nodes.select("node", "rep"), roots, ["node"], "left").select(
            "node", "rep", F.coalesce("root", "node").alias("root")
        )
    )
    smallest = named.groupBy("root").agg(F.min("rep").alias("first"))
    first = named.join(smallest, "root").select("node", "first")
    return rows.join(first, "node", "left").select("doc_id", "key", "n", "first")


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the smallest doc_id that links reach. Null, empty and blank texts have
    no n-grams and their own doc_id. Repeated rows give a row each. A row with a null
    doc_id links like others but names no component, so one of such rows alone has a null
    component_id; an empty table gives no rows.
    """
    return _classified(docs, size, percent).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
    )


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component, that of the smallest doc_id, all columns kept.

    Rows with a null doc_id come last in a component, and of different texts under one
    doc_id that are near copies one stays. Texts without n-grams are linked with nothing. Rows
    alike in doc_id and text, a null one counting as empty, are one row: any of them stays.
    """
    found = settle(_classified(docs, size, percent))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    gone = settle(found.where((F.col("n") > 0) & ~is_first).select("doc_id", "key").distinct())
    again = settle(found.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    kept = join_rows(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    place = next(c for c in map("text_key_{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    several = join_rows(kept, again, "left_semi").withColumn(place, text_key(kept))
    return join_rows(kept, again, "left_anti").unionByName(several.dropDuplicates(["doc_id", place]).drop(place))
