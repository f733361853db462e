"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task works on at once; arrays over it take up to a hundred times as much.
SLICE_BYTES = 500_000
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def partition_id() -> int:
    return TaskContext.get().partitionId()


def small_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about SLICE_BYTES of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES)))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Returns the worker's unused memory to the system, as the worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """mapInArrow for a generator that yields dicts of column lists in the order of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                    for c, f in zip(columns, arrow, strict=True)
                ],
                schema=arrow,
            )
        give_back()

    return df.mapInArrow(run, schema)


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows range-partitioned and sorted by the keys; ties are spread by their place in the input.

    The place keeps a repeated key (repeated rows, nulls) from filling one partition.
    """
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    order = [F.col(k) for k in keys] + [F.col("__place")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__place")


def text_key(docs: DataFrame) -> Column:
    """64 bits of a row's text; null counts as empty."""
    return F.xxhash64(whole_text(docs))


def join_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with ``rows`` (doc_id, key) by doc_id, null ones too, and the text.

    So a row is decided by its own text under a null or a repeated doc_id as well, and
    neither a frequent id nor a frequent text alone makes a hot key.
    """
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = docs["doc_id"].cast("bigint").eqNullSafe(rows["doc_id"]) & (text_key(docs) == rows["key"])
    return docs.join(F.broadcast(rows) if few else rows, same, how)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that broadcasts the small side only when a count shows at most BROADCAST_ROWS rows."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, keys, how)
