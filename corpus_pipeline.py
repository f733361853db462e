"""Training corpus from raw documents: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents,
extra ones too, and decide each row by its own text: a null doc_id or one that rows share
changes nothing. Null and empty texts are kept by stages 2 to 4 and packed as their end
id; an empty table gives an empty one. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from payerlens.llm import jaccard, packing, pii, quality, winnow
from payerlens.llm.common import table
from payerlens.operators.stages import settle


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all, where no good document is labelled."""
    return quality.good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, that of the smallest id, null ones last; repeated rows are one."""
    return jaccard.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; repeated rows go or stay together."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048."""
    # workers of the stages before still hold memory, so this one remembers less
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, end_id=1, remembered=100_000)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: The stages are models and token ids, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
