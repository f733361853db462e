"""Packing token ids into fixed sequences with a controlled mixture of sources.

Every source is a queue of its documents' ids in doc_id order. Deficit round
robin serves the queues: a window of some sequences adds a quantum by its share to
each queue's credit, whole tokens are served, and the rest of the credit, the deficit, is
carried to the next window. That has a closed form: after quanta of t in all a queue
has given ``t * share // all_shares`` tokens. So a document's places follow from its
place in its queue, without going through the windows in order, and the deficits carry
across windows and partitions alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import join_small, map_arrow, ordered, partition_id, small_slices, whole_text
from .tokens import REMEMBERED, encoder

#: With more sources than this the places come from tables instead of the driver; they are the same.
MOST_QUEUES = 1024
#: Rows of a prefix sum in one task.
BLOCK = 1024
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, `offset` bigint, queue int"
)


@dataclass
class Phase:
    """A stretch of the output in which the same queues are served by the same shares."""

    first: int  # tokens before it
    quanta: int  # of all its windows together
    shares: list[int]  # by queue
    taken: list[int]  # what each queue has given before it

    def __post_init__(self):
        self.whole = sum(self.shares)
        self.held: dict[tuple[int, int], list[int]] = {}

    def given(self, queue: int, t: int) -> int:
        return t * self.shares[queue] // self.whole

    def starts(self, low: int, high: int) -> list[int]:
        """Where the queues begin in the window from low to high."""
        if (low, high) not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            spots = [self.first + sum(self.given(q, low) for q in range(len(self.shares)))]
            for q in range(len(self.shares) - 1):
                spots.append(spots[-1] + self.given(q, high) - self.given(q, low))
            self.held[low, high] = spots
        return self.held[low, high]


def schedule(totals: list[int], shares: list[int] | None = None) -> list[Phase]:
    """Phases for queues of these totals; without shares a queue's share is its total.

    With shares, a queue that runs dry leaves and the others go on in their
    proportions, so there are at most as many phases as queues, and as many again for
    queues without a share, which come last.
    """
    left, taken, first, phases = list(totals), [0] * len(totals), 0, []
    while any(left):
        share = [(s if left[i] else 0) for i, s in enumerate(shares or totals)]
        if not any(share):  # only queues without a share are left
            share = list(left)
        # at this many quanta the first queue is empty to the token, and none is overdrawn
        quanta = min(-(-left[i] * sum(share) // s) for i, s in enumerate(share) if s)
        phase = Phase(first, quanta, share, list(taken))
        for i in range(len(totals)):
            n = phase.given(i, quanta)
            taken[i] += n
            left[i] -= n
            first += n
        phases.append(phase)
    return phases


def places(
    phases: list[Phase], queue: int, at: int, n: int, window: int, sequence: int
) -> Iterator[tuple[int, int, int, int]]:
    """(ids of the run before, length, sequence, offset) of the pieces of a run of a queue."""
    done = 0
    for p in phases:
        end = p.taken[queue] + p.given(queue, p.quanta)
        while done < n and at + done < end:
            x = at + done - p.taken[queue]
            w = x * p.whole // p.shares[queue] // window
            while p.given(queue, w * window) > x:
                w -= 1
            while p.given(queue, min((w + 1) * window, p.quanta)) <= x:
                w += 1
            low, high = w * window, min((w + 1) * window, p.quanta)
            spot = p.starts(low, high)[queue] + x - p.given(queue, low)
            length = min(n - done, p.given(queue, high) - x, sequence - spot % sequence)
            yield done, length, spot // sequence, spot % sequence
            done += length
        if done == n:
            return


def stretches(total: int, whole: int, at: int, n: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(ids of the run before, length, window, place in the queue's part of it) of a run of a queue
    in a phase where every queue's share is its total."""
    done = 0
    while done < n:
        x = at + done
        w = x * whole // total // window
        while w * window * total // whole > x:
            w -= 1
        while min((w + 1) * window, whole) * total // whole <= x:
            w += 1
        low, high = w * window * total // whole, min((w + 1) * window, whole) * total // whole
        length = min(n - done, high - x)
        yield done, length, w, x - low
        done += length


def before_in(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows with ``base``, the sum of n over the rows before in the order within ``by``, in blocks of the order."""
    block = df.withColumn("block", F.floor(F.col(order) / BLOCK))
    none = Window.unboundedPreceding
    sums = block.groupBy(*by, "block").agg(F.sum("n").alias("n"))
    # as many rows as blocks: a thousandth of a window's queues, or of the windows
    outer = Window.partitionBy(*(by or [F.lit(0)])).orderBy("block").rowsBetween(none, -1)
    sums = sums.select(*by, "block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("outer"))
    inner = Window.partitionBy(*by, "block").orderBy(order).rowsBetween(none, -1)
    block = block.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return block.join(sums, [*by, "block"]).withColumn("base", F.col("inner") + F.col("outer")).drop("block", "inner", "outer")


def numbered(df: DataFrame, key: str, first: int) -> DataFrame:
    """The rows with ``number``, their rank by the key from first on; one number a partition goes to the driver."""

    def count(batches):
        part, at = partition_id(), 0
        for batch in batches:
            yield [batch.column(0), [part] * batch.num_rows, list(range(at, at + batch.num_rows)), batch.column(1)]
            at += batch.num_rows

    rows = df.select(key, "n").repartitionByRange(key).sortWithinPartitions(key)
    rows = settle(map_arrow(rows, count, f"{key} string, place int, rank bigint, n bigint"))
    bases = {}
    for part, n in sorted(rows.groupBy("place").count().collect()):
        bases[part] = first
        first += n
    spark = df.sparkSession
    small = spark.createDataFrame(list(bases.items()), "place int, first bigint")
    return rows.join(F.broadcast(small), "place").select(key, "n", (F.col("rank") + F.col("first")).alias("number"))


def place_by_table(runs: DataFrame, whole: int, first: int, window: int, sequence: int) -> DataFrame:
    """The pieces of queues whose share is their total, from the token ``first`` on, for any number of queues.

    A queue's total and number stand beside its runs, ``whole`` is the sum of the totals.
    The windows' parts are added up by (window, queue), so empty ones cost nothing, and
    their places are prefix sums.
    """

    def stretch(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, at, n, ids, total, queue in zip(*(c.to_pylist() for c in batch.columns)):
                for start, length, w, place in stretches(total, whole, at, n, window):
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc, start, length, piece, n, w, place, queue)):
                        column.append(value)
            yield rows

    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, w bigint, place bigint, queue int"
    parts = settle(map_arrow(runs.select("doc_id", "at", "n", "ids", "total", "number"), stretch, schema))
    pairs = settle(parts.groupBy("w", "queue").agg(F.sum("length").alias("n")))
    begins = before_in(pairs.groupBy("w").agg(F.sum("n").alias("n")), [], "w").select("w", F.col("base").alias("begin"))
    spots = before_in(pairs, ["w"], "queue").join(begins, "w")
    spots = settle(spots.select("w", "queue", (F.col("base") + F.col("begin") + F.lit(first)).alias("spot")))

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, start, n, ids, whole_n, spot, queue in zip(*(c.to_pylist() for c in batch.columns)):
                done = 0
                while done < n:
                    length = min(n - done, sequence - (spot + done) % sequence)
                    piece, at = ids[4 * done : 4 * (done + length)], spot + done
                    values = (doc, start + done, length, piece, whole_n, at // sequence, at % sequence, queue)
                    for column, value in zip(rows, values):
                        column.append(value)
                    done += length
            yield rows

    placed = join_small(parts, spots, ["w", "queue"]).select(
        "doc_id", "start", "length", "ids", "doc_tokens", (F.col("spot") + F.col("place")).alias("spot"), "queue"
    )
    return map_arrow(placed, cut, PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    sequence: int = 2048,
    window_sequences: int = 16,
    targets: dict[str | None, int] | None = None,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Pieces of all documents: ids (little-endian uint32), sequence and offset in it.

    Only the last sequence can be short of ``sequence`` tokens. ``targets`` gives
    sources integer shares; without it a source's share is its part of all tokens, so
    that all queues end together and every window has the mixture of the whole table.
    ``remembered`` bounds the pieces whose ids a worker keeps, and so its memory.
    Null text is an empty one; a null source is a queue of its own; repeated rows are
    packed each; an empty table gives no pieces. Every source has its own queue, however
    many there are; the driver knows at most MOST_QUEUES of them, or those with a target.
    """
    names = docs.select("source").distinct().limit(MOST_QUEUES + 1).collect()
    few = len(names) <= MOST_QUEUES
    # queues that the driver knows: all, or if there are many those with a target
    known = [r[0] for r in names] if few else [name for name, share in (targets or {}).items() if share]
    known.sort(key=lambda x: (x is not None, x))
    number = {name: i for i, name in enumerate(known)}
    texts = ordered(docs.select("doc_id", whole_text(docs).alias("text"), "source"), "doc_id")

    def tokenize(batches):
        coder, part, given = encoder(tokenizer, remembered), partition_id(), {}
        for batch in small_slices(batches):
            rows: list[list] = [[] for _ in range(7)]
            own, texts_, sources = (c.to_pylist() for c in batch.columns)
            for doc, ids, source in zip(own, coder.documents(texts_, end_id), sources):
                queue = number.get(source, -1)
                key = "" if queue >= 0 or source is None else f"={source}"
                before = given.get((queue, key), 0)
                given[queue, key] = before + len(ids)
                for column, value in zip(rows, (part, doc, queue, key, before, len(ids), ids.tobytes())):
                    column.append(value)
            yield rows

    tokenized = settle(
        map_arrow(
            texts, tokenize, "part int, doc_id bigint, queue int, key string, before bigint, n bigint, ids binary"
        )
    )
    sums = settle(tokenized.groupBy("part", "queue", "key").agg(F.sum("n").alias("n")))
    totals = [0] * len(known)
    for queue, n in sums.where("queue >= 0").groupBy("queue").agg(F.sum("n")).collect():  # the known queues
        totals[queue] = n
    shares = [targets.get(name, 0) for name in known] if targets is not None else None
    phases = schedule(totals, shares)
    earlier = Window.partitionBy("queue", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "queue", "key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    window = sequence * window_sequences

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, queue, at, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                for start, length, seq, offset in places(phases, queue, at, n, window, sequence):
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc, start, length, piece, n, seq, offset, queue)):
                        column.append(value)
            yield rows

    if few:
        starts = starts.withColumns({"total": F.lit(0), "number": F.lit(0)})  # the driver knows them
    else:
        rest = sums.where("queue < 0")
        keys = settle(numbered(rest.groupBy("key").agg(F.sum("n").alias("n")), "key", len(known)))
        starts = starts.join(keys.withColumn("queue", F.lit(-1)).withColumnRenamed("n", "total"), ["queue", "key"], "left")
    runs = join_small(tokenized, starts, ["part", "queue", "key"]).select(
        "doc_id", "queue", (F.col("before") + F.col("base")).alias("at"), "n", "ids", "total", "number"
    )
    of_driver = runs.select("doc_id", "queue", "at", "n", "ids")
    if few:
        return map_arrow(of_driver, cut, PIECES)
    whole = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_table = place_by_table(runs.where("queue < 0"), whole, sum(totals), window, sequence)
    return map_arrow(of_driver.where("queue >= 0"), cut, PIECES).unionByName(by_table) if known else by_table
