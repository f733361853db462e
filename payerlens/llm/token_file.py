"""Token-id files of patched frame-of-reference blocks.

A file is a folder of Parquet parts, so that it can lie in any store Spark
writes to. A row is a segment: whole documents with about ``segment_ids`` ids
(or one longer document). Its ``payload`` is a run of blocks of ``block`` ids,
``block_starts`` their places in it. A block subtracts its minimum, packs the
differences at the width that ``percentile`` percent of them fit, and stores the
others (exceptions) as a list of places and full differences.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, ordered, partition_id, small_slices, whole_text
from .tokens import encoder

SCHEMA = (
    "shard int, segment int, first long, n_ids long, doc_ids array<bigint>, "
    "doc_tokens array<bigint>, block_starts array<int>, payload binary"
)
_HEAD = struct.Struct("<IBHH")  # minimum, width, ids, exceptions


def pack(ids: np.ndarray, block: int = 512, percentile: float = 90.0) -> tuple[bytes, list[int]]:
    """(payload, start of each block) of ids below 2**32."""
    n = len(ids)
    if not n:
        return b"", []
    rows = -(-n // block)
    padded = np.empty(rows * block, np.uint32)
    padded[:n], padded[n:] = ids, ids[-1]
    padded = padded.reshape(rows, block)
    least = padded.min(axis=1)
    rest = padded - least[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    place = min(block - 1, max(0, int(np.ceil(block * percentile / 100)) - 1))
    width = np.partition(bits, place, axis=1)[:, place]
    over = bits > width[:, None]
    if n % block:
        over[-1, n % block :] = False
    kept = np.where(over, np.uint32(0), rest)
    packed: list[bytes] = [b""] * rows
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w:
            shifts = np.arange(w, dtype=np.uint32)
            plane = ((kept[at][:, :, None] >> shifts) & 1).astype(np.uint8)
            body = np.packbits(plane.reshape(len(at), -1), axis=1, bitorder="little")
            for i, row in zip(at.tolist(), body):
                packed[i] = row.tobytes()
    out, starts, at = [], [], 0
    for i in range(rows):
        size = min(block, n - i * block)
        places = np.flatnonzero(over[i]).astype(np.uint16)
        w = int(width[i])
        piece = b"".join(
            (
                _HEAD.pack(int(least[i]), w, size, len(places)),
                packed[i][: -(-size * w // 8)],
                places.tobytes(),
                rest[i][places].tobytes(),
            )
        )
        starts.append(at)
        out.append(piece)
        at += len(piece)
    return b"".join(out), starts


def unpack(payload: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at the given starts."""
    heads = [_HEAD.unpack_from(payload, s) for s in starts]
    if not heads:
        return np.zeros(0, np.uint32)
    sizes = np.array([h[2] for h in heads])
    out = np.zeros((len(heads), int(sizes.max())), np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, n, _) in enumerate(heads):
        groups.setdefault((w, n), []).append(i)
    for (w, n), rows in groups.items():
        if w:
            length = -(-n * w // 8)
            bodies = [starts[i] + _HEAD.size for i in rows]
            raw = b"".join(payload[a : a + length] for a in bodies)
            bits = np.unpackbits(
                np.frombuffer(raw, np.uint8).reshape(len(rows), length), axis=1, count=n * w, bitorder="little"
            ).reshape(-1, w)
            weights = (np.uint64(1) << np.arange(w, dtype=np.uint64)).astype(np.float64)
            out[rows, :n] = (bits.astype(np.float64) @ weights).astype(np.uint32).reshape(len(rows), n)
    for i, (least, w, n, k) in enumerate(heads):
        if k:
            at = starts[i] + _HEAD.size + -(-n * w // 8)
            places = np.frombuffer(payload, np.uint16, k, at)
            out[i, places] = np.frombuffer(payload, np.uint32, k, at + 2 * k)
        out[i, :n] += np.uint32(least)
    return np.concatenate([out[i, :n] for i, n in enumerate(sizes.tolist())])


def encode_segments(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    segment_ids: int = 65_536,
    block: int = 512,
    percentile: float = 90.0,
) -> DataFrame:
    """Segments of all documents in ascending doc_id order; a partition is a shard.

    Null text is an empty one (only its end id); rows with a null doc_id come
    first; repeated rows are encoded each; an empty table gives no segments.
    """
    texts = ordered(docs.select("doc_id", whole_text(docs).alias("text")), "doc_id")

    def work(batches):
        coder, shard, segment, first = encoder(tokenizer), partition_id(), 0, 0
        doc_ids, parts, held = [], [], 0

        def close():
            ids = np.concatenate(parts)
            payload, starts = pack(ids, block, percentile)
            sizes = [len(p) for p in parts]
            return [[shard], [segment], [first], [len(ids)], [doc_ids], [sizes], [starts], [payload]]

        for batch in small_slices(batches):
            own = batch.column(0).to_pylist()
            for doc_id, ids in zip(own, coder.documents(batch.column(1).to_pylist(), end_id)):
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids)
                if held >= segment_ids:
                    yield close()
                    segment, first = segment + 1, first + held
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield close()

    return map_arrow(texts, work, SCHEMA)


def write(segments: DataFrame, path: str) -> None:
    segments.write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written file; ids are little-endian uint32 bytes.

    Only the totals of the shards (one row a partition of the writer) come to the driver.
    """
    from pyspark.sql.types import _parse_datatype_string

    segments = spark.read.schema(_parse_datatype_string(SCHEMA)).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    base, before = {}, 0
    for shard, n in sorted((r[0], r[1]) for r in totals):
        base[shard], before = before, before + n

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                ids = unpack(row["payload"], row["block_starts"])
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                yield [
                    row["doc_ids"],
                    begins + (base[row["shard"]] + row["first"]),
                    sizes,
                    [ids[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())],
                ]

    return map_arrow(
        segments.select("shard", "first", "doc_ids", "doc_tokens", "block_starts", "payload"),
        work,
        "doc_id bigint, start bigint, n_tokens bigint, ids binary",
    )
