"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payerlens.operators.stages import new_stage

from . import alignment, decision_list, html, jaccard, packing, pii, quality, repair, secrets, sharding, simhash, token_file, winnow
from .common import join_small, table

SHARDS = 8


def op1_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_ columns and base_sha256 tell of the base spans, spans of all."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near, where doc_id is divisible by 100: other rows within 3 bits of this fingerprint."""
    rows = simhash.with_next(table(spark, sf_dir, "documents"))
    found = join_small(rows, simhash.near_counts(rows), ["fingerprint"], "left")
    asked = F.col("doc_id") % 100 == 0
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        *[F.lpad(F.lower(F.hex(c)), 16, "0").alias(c) for c in ("fingerprint", "edited_fingerprint")],
        "near_edited",
        "near_next",
        F.when(asked, F.col("n_near")).alias("n_near"),
    )


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_stage(spark)
    token_file.write(
        token_file.encode_segments(
            table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2
        ),
        path,
    )
    return token_file.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the path."""
    return secrets.find(table(spark, sf_dir, "documents"), F.col("source"))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


def op10_rtree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op11_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule is the number of the learned rule that a text meets."""
    found, _ = decision_list.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", "rule")


def op12_fragment_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.linked(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_repair_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.report(conversations, *repair.repair(repair.damaged(conversations)))
    return found.withColumnRenamed("sha256", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bilstm_crf,
        op2_simhash,
        op3_token_blocks,
        op4_pu_quality,
        op5_winnowing,
        op6_forest_secrets,
        op7_hash_tree_shards,
        op8_mixture_packing,
        op9_block_tree,
        op10_rtree_jaccard,
        op11_decision_list,
        op12_fragment_monoid,
        op13_repair_parsing,
    )
}

#: Windows of the items, then every window of every document, by text.
OP5_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
    array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM items WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS w
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM lowered, sizes WHERE len(words) >= size)
), found AS (
  SELECT doc_id, i, d.size, item_id FROM doc_windows d JOIN item_windows USING (w)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: All pairs that share a shingle, then everything that links reach.
OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 5, 0) + 2)) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b USING (s)
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM reached LEFT JOIN sizes ON sizes.doc_id = x GROUP BY x
"""

#: The damage by a CRC table, then one pass over each conversation's rows by the four states of the language.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), faulty AS (
  SELECT keyed.*, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, c: xor(crc >> 8, t[(xor(crc, c) & 255) + 1]), 4294967295), 4294967295) % 20 AS fault
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), marked AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), moves(p, r, q) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(p, q, cost, letters) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'),
    (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')
), edits AS (
  SELECT conv_id, i, p, p AS q, 4 AS cost, 'D' AS letter FROM marked, (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL
  SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN r = initial THEN 0 ELSE 3 END,
    CASE WHEN r = initial THEN 'K' ELSE 'R' END
  FROM marked, moves WHERE (fault IS NULL OR fault = 'truncated') AND (r = initial OR r <> 's')
), steps AS (
  SELECT conv_id, e.i, e.p, n.q, min({'cost': e.cost + n.cost, 'audit': e.letter || n.letters}) AS best
  FROM edits e JOIN inserts n ON e.q = n.p GROUP BY conv_id, e.i, e.p, n.q
), reached AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, q, cost, letters AS audit FROM counts, inserts WHERE p = 0
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit FROM (
    SELECT r.conv_id, s.i, s.q, min({'cost': r.cost + s.best.cost, 'audit': r.audit || s.best.audit}) AS best
    FROM reached r JOIN steps s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.i = r.i + 1 AND s.p = r.q
    GROUP BY r.conv_id, s.i, s.q)
), plans AS (
  SELECT r.conv_id, min({'cost': r.cost, 'audit': r.audit}) AS best FROM reached r
    JOIN counts c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.i
  WHERE r.q IN (0, 3) GROUP BY r.conv_id
), letters AS (
  SELECT conv_id, k, best.audit[k] AS letter,
    len(replace(best.audit[1:k], 'I', '')) AS i, len(replace(best.audit[1:k], 'D', '')) AS seat
  FROM (SELECT *, unnest(range(1, len(best.audit) + 1)) AS k FROM plans)
), turns AS (
  SELECT l.conv_id, l.seat, l.letter, m.role, CASE WHEN l.letter = 'I' THEN '' ELSE m.text END AS text,
    max(CASE WHEN l.seat = 1 AND l.letter = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS lead
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i
  WHERE l.letter <> 'D'
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (seat - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY seat) AS repaired FROM turns GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM d.conv_id
"""

ORACLES: dict[str, str] = {
    "op5_winnowing": OP5_SQL,
    "op10_rtree_jaccard": OP10_SQL,
    "op13_repair_parsing": OP13_SQL,
}
