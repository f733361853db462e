"""Benchmark decontamination by winnowing.

A benchmark item is the set of its windows of ``span`` words (an item with fewer
words is one window). Of each window of m words the smallest hash of its k-grams is
its fingerprint. Documents keep the smallest k-gram hash of every run of m - k + 1
k-grams, so each place where a window occurs keeps that window's fingerprint. Places
whose fingerprint some window has are extended to all windows around them, and those
are joined with the benchmark's windows by their text, which makes the result exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import join_rows, map_arrow, small_slices, text_key, whole_text
from .hashing import grams, words_of

SPAN = 10
#: Benchmark fingerprints that are sent to the executors as one array; more are joined.
BROADCAST_FINGERPRINTS = 1_000_000


def gram_size(window: int) -> int:
    return min(5, (window + 1) // 2)


def winnowed(hashes: np.ndarray, run: int) -> np.ndarray:
    """Which k-gram hashes are the smallest of some ``run`` consecutive ones (ties all count)."""
    n = len(hashes) - run + 1
    kept = np.zeros(len(hashes), bool)
    if n <= 0:
        return kept
    least = reduce(np.minimum, (hashes[j : j + n] for j in range(run)))
    for j in range(run):
        kept[j : j + n] |= hashes[j : j + n] == least
    return kept


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, window, size, fingerprint) of every window; items without words have none."""

    def work(batches):
        for batch in small_slices(batches):
            rows: list[list] = [[], [], [], []]
            words = words_of(batch.column(1), alnum=True)
            for r, item in enumerate(batch.column(0).to_pylist()):
                own = words.of(r)
                m = min(span, own.stop - own.start)
                if not m:
                    continue
                k = gram_size(m)
                h = grams(words.hashes[own], k)
                least = np.lib.stride_tricks.sliding_window_view(h, m - k + 1).min(axis=1)
                for i, fingerprint in enumerate(least.view(np.int64).tolist(), own.start):
                    rows[0].append(item)
                    rows[1].append(words.joined(i, i + m).decode())
                    rows[2].append(m)
                    rows[3].append(fingerprint)
            yield rows

    source = benchmark.select(
        benchmark["item_id"].cast("string").alias("item_id"), whole_text(benchmark).alias("text")
    )
    return map_arrow(source, work, "item_id string, window string, size int, fingerprint bigint")


def _places(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """A row per document: words and, for kept fingerprints, (fingerprint, size, first window, words around)."""

    def work(batches):
        for batch in small_slices(batches):
            words = words_of(batch.column(1), alnum=True)
            begins, ends = words.upto[:-1], words.upto[1:]
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for m in sizes:
                k = gram_size(m)
                h = grams(words.hashes, k)
                at = np.flatnonzero(winnowed(h, m - k + 1))
                if wanted is not None:
                    near = np.searchsorted(wanted, h[at]).clip(max=len(wanted) - 1)
                    at = at[wanted[near] == h[at]]
                owner = np.searchsorted(ends, at, side="right")
                inside = at + k <= ends[owner] if len(at) else np.zeros(0, bool)
                for i, d in zip(at[inside].tolist(), owner[inside].tolist()):
                    low, high = max(int(begins[d]), i + k - m), min(int(ends[d]), i + m)
                    if high - low >= m:
                        around = words.joined(low, high).decode()
                        found[d].append((int(h[i].astype(np.int64)), m, low - int(begins[d]), around))
            yield [
                batch.column(0),
                batch.column(2),
                np.diff(words.upto),
                [
                    [{"fingerprint": f, "size": m, "first": s, "around": a} for f, m, s, a in own]
                    for own in found
                ],
            ]

    schema = (
        "doc_id bigint, key bigint, n_words bigint, "
        "found array<struct<fingerprint: bigint, size: int, first: int, around: string>>"
    )
    source = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), whole_text(docs).alias("text"), text_key(docs).alias("key")
    )
    return map_arrow(source, work, schema)


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    most_fingerprints: int = BROADCAST_FINGERPRINTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: place, doc_id, key, n_words; occurrences: place, at, size, window; owners: window, item_id).

    ``place`` tells rows apart, also repeated ones; ``key`` stands for the text. Null text has no words.
    """
    windows = settle(benchmark_windows(benchmark, span).distinct())
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most ``span`` numbers
    prints = windows.select("fingerprint").distinct()
    first = prints.limit(most_fingerprints + 1).toPandas()["fingerprint"].to_numpy(np.int64)
    few = len(first) <= most_fingerprints
    wanted = np.sort(first.view(np.uint64)) if few else None
    if few and not len(first):
        sizes = []
    rows = settle(
        _places(docs, sizes, wanted).withColumn("place", F.monotonically_increasing_id())
    )
    each = rows.select("place", F.explode("found").alias("f")).select("place", "f.*")
    if not few:
        each = each.join(prints, "fingerprint", "left_semi")
    words = F.split("around", " ")
    around = each.select(
        "place",
        "size",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - F.col("size")),
                lambda j: F.struct(
                    (F.col("first") + j).alias("at"),
                    F.array_join(F.slice(words, j + 1, F.col("size")), " ").alias("window"),
                ),
            )
        ).alias("w"),
    ).select("place", "size", "w.at", "w.window")
    known = windows.select("window").distinct()
    occurrences = settle(around.distinct().join(known, "window", "left_semi"))
    return rows.select("place", "doc_id", "key", "n_words"), occurrences, windows.select("window", "item_id")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    most_fingerprints: int = BROADCAST_FINGERPRINTS,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings) of every document row.

    Repeated rows give a row each. An item with a null item_id hits words but is not
    listed. An empty benchmark hits nothing; an empty table of documents gives no rows.
    """
    rows, occurrences, owners = hits(docs, benchmark, span, most_fingerprints)
    runs = F.sort_array(F.collect_set(F.struct("at", "size")))
    # adds the part of each window that lies behind all earlier ones
    covered = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, w: F.struct(
            F.greatest(a["end"], w["at"] + w["size"]).alias("end"),
            (
                a["n"] + F.greatest(F.lit(0), w["at"] + w["size"] - F.greatest(a["end"], w["at"]))
            ).alias("n"),
        ),
    )["n"]
    hit = occurrences.groupBy("place").agg(covered.cast("bigint").alias("n_hit"))
    items = (
        occurrences.select("place", "window")
        .distinct()
        .join(owners.where("item_id IS NOT NULL"), "window")
        .select("place", "item_id")
        .distinct()
        .groupBy("place")
        .agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    return (
        rows.join(hit.join(items, "place", "left"), "place", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows without a hit in their own text, all columns kept.

    A null or repeated doc_id changes nothing. Null, empty and repeated texts are rows like
    others; an empty benchmark keeps all rows, an empty table gives none.
    """
    rows, occurrences, _ = hits(docs, benchmark, span)
    hit = rows.join(occurrences.select("place").distinct(), "place", "left_semi")
    return join_rows(docs, settle(hit.select("doc_id", "key").distinct()), "left_anti")
