"""SimHash fingerprints and their search by permuted block tables.

Terms are pairs of neighbouring words (a single word where there is no pair), weighted
by their length, as long terms say more than function words. The hash of every term
votes with its weight on 64 signed bits; the sign of each sum is a bit.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import map_arrow, ordered, partition_id, small_slices, whole_text
from .hashing import grams, scramble, words_of

BITS = 64
_CHUNK = 8192


def fingerprints(texts: pa.Array) -> list[int]:
    """64-bit SimHash of each text; texts without words have 0."""
    words = words_of(texts)
    length = (words.ends - words.begins).astype(np.float32)
    pairs = grams(words.hashes, 2)
    alone = scramble(words.hashes)
    out = []
    for r in range(len(texts)):
        own = words.of(r)
        n = own.stop - own.start
        if not n:
            out.append(0)
            continue
        terms = alone[own] if n == 1 else pairs[own.start : own.stop - 1]
        weights = length[own] if n == 1 else length[own][1:] + length[own][:-1]
        votes = np.zeros(BITS, np.float64)
        for at in range(0, len(terms), _CHUNK):
            raw = terms[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            votes += weights[at : at + _CHUNK] @ bits
        signs = votes * 2 > weights.sum(dtype=np.float64)
        out.append(int(np.packbits(signs, bitorder="little").view(np.uint64)[0]))
    return out


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text whose last quarter is replaced by as many first characters of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint bigint, "
    "edited_fingerprint bigint, near_edited double, near_next double"
)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text with the next document's beginning.

    The next document is the next row in ascending doc_id order (nulls first, repeated
    ids in the order of the input), after the last row the first. One row alone is its
    own next. Rows are sorted in ranges; only the two outer texts of each range
    meet in a join.
    """
    texts = ordered(
        docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), whole_text(docs).alias("text")), "doc_id"
    )

    def compared(docs_, texts_, own, following, upcoming):
        """Result rows of texts with their fingerprints and those of the next ones."""
        changed = [edited(t, f) for t, f in zip(texts_, following)]
        other = fingerprints(pa.array(changed, pa.string()))
        return [
            docs_,
            [len(t) for t in texts_],
            [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            np.array(own, np.uint64).view(np.int64),
            np.array(other, np.uint64).view(np.int64),
            [likeness(x, y) for x, y in zip(own, other)],
            [likeness(x, y) for x, y in zip(own, upcoming)],
        ]

    def work(batches):
        part, held = partition_id(), None
        for batch in small_slices(batches):
            ids, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            marks = fingerprints(batch.column(1))
            if held is None:
                yield [[None]] * 7 + [[part], ["first"], [texts_[0]]]
            else:
                ids, texts_, marks = [held[0], *ids], [held[1], *texts_], [held[2], *marks]
            if len(ids) > 1:
                n = len(ids) - 1
                rows = compared(ids[:-1], texts_[:-1], marks[:-1], texts_[1:], marks[1:])
                yield rows + [[part] * n, [None] * n, [None] * n]
            held = (ids[-1], texts_[-1], marks[-1])
        if held is not None:
            yield [[held[0]]] + [[None]] * 6 + [[part], ["last"], [held[1]]]

    rows = settle(map_arrow(texts, work, f"{_ROW}, part int, edge string, text string"))
    parts = [r[0] for r in rows.where("edge = 'first'").select("part").orderBy("part").collect()]
    after = dict(zip(parts, parts[1:] + parts[:1]))  # one entry a partition
    if not parts:
        return rows.drop("part", "edge", "text")
    turns = docs.sparkSession.createDataFrame(list(after.items()), "part int, following int")
    last = rows.where("edge = 'last'").select("doc_id", "text", "part").join(turns, "part")
    first = rows.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next"))

    def close(batches):
        for batch in batches:
            ids, texts_, upcoming = (c.to_pylist() for c in batch.columns)
            yield compared(ids, texts_, fingerprints(batch.column(1)), upcoming, fingerprints(batch.column(2)))

    ends = map_arrow(last.join(first, "following").select("doc_id", "text", "next"), close, _ROW)
    return rows.where("edge IS NULL").drop("part", "edge", "text").unionByName(ends)


def near_pairs(queries: DataFrame, prints: DataFrame, radius: int = 3, spare: int = 2) -> DataFrame:
    """All (query, fingerprint, distance) within ``radius`` bits; both inputs have a column fingerprint.

    Bits are cut into radius + spare blocks. Two fingerprints within the radius agree in
    at least ``spare`` blocks, so each choice of ``spare`` blocks is a table keyed by their
    bits (the fingerprint permuted so that they lead), and every pair meets in one of them.
    Equal fingerprints are searched once.
    """
    blocks = radius + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    mask = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    tables = [sum(mask[i] for i in chosen) for chosen in combinations(range(blocks), spare)]
    tables = [m - (1 << 64) if m >> 63 else m for m in tables]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)])
        return df.select(name, F.explode(keys).alias("k")).select(name, "k.t", "k.key")

    left = keyed(queries.select(F.col("fingerprint").alias("query")).distinct(), "query")
    right = keyed(prints.select("fingerprint").distinct(), "fingerprint")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return (
        left.join(right, ["t", "key"])
        .select("query", "fingerprint", distance.alias("distance"))
        .where(F.col("distance") <= radius)
        .distinct()
    )


def near_counts(rows: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """(fingerprint, n_near): for rows whose doc_id is divisible by ``every``, how many rows are that near."""
    counts = settle(rows.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") % every == 0).alias("asked")
    ))
    pairs = near_pairs(counts.where("asked"), counts, radius)
    return (
        pairs.join(counts.select("fingerprint", "n"), "fingerprint")
        .groupBy(F.col("query").alias("fingerprint"))
        .agg((F.sum("n") - 1).alias("n_near"))
    )
