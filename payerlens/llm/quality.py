"""Quality classifier by positive-unlabelled learning.

A small network is fitted to trusted good documents and unlabelled ones: it minimises
the non-negative unbiased risk  p R+(good) + max(0, R-(unlabelled) - p R-(good))  with
the sigmoid loss and an estimated share p of good documents. Known bad documents
serve only to estimate p. It sees the shape of whole texts: shares of pairs of
character classes, word lengths, repeated words and lines. Language, source and ids are
no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_slices, whole_text
from .hashing import words_of

#: Most documents of each kind that the fit reads, drawn by a hash of their ids.
SAMPLE = 12_000
HELD_OUT = (3, 1)

_KINDS = 16


def _kinds() -> np.ndarray:
    """Class of each UTF-8 byte."""
    table = np.full(256, 13, np.uint16)
    table[ord("A") : ord("Z") + 1] = 0
    table[ord("a") : ord("z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for kind, characters in enumerate((" \t", "\n\r", ".", ",;:", "!", "?", "|", "#$%&*", "'\"", "()[]{}<>"), 3):
        for c in characters:
            table[ord(c)] = kind
    table[128:192] = 14
    table[192:] = 15
    return table


_TABLE = _kinds()
FEATURES = _KINDS * _KINDS + 12


def features(texts: pa.Array) -> np.ndarray:
    """Numbers between 0 and about 2 that describe the shape of each whole text, a row a text."""
    texts = texts.fill_null("")
    words = words_of(texts, lower=False)
    size_of = (words.ends - words.begins).astype(np.float32)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for r, text in enumerate(texts.to_pylist()):
        own = words.of(r)
        n = own.stop - own.start
        if not n:
            continue
        raw = text.encode()
        kinds = _TABLE[np.frombuffer(raw, np.uint8)]
        pairs = np.bincount(kinds[:-1] * np.uint16(_KINDS) + kinds[1:], minlength=_KINDS * _KINDS)
        out[r, : _KINDS * _KINDS] = np.sqrt(pairs / max(1, len(kinds) - 1))
        hashed, size = words.hashes[own], size_of[own]
        ordered = np.sort(hashed)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        distinct, most = len(edges) - 1, int(np.diff(edges).max())
        lines = [x for x in raw.split(b"\n") if x.strip()]
        again = float((hashed[1:] == hashed[:-1]).mean()) if n > 1 else 0.0
        out[r, _KINDS * _KINDS :] = (
            1.0,
            np.log10(1 + n) / 5,
            min(2.0, size.mean() / 10),
            min(2.0, size.std() / 10),
            distinct / n,
            np.sqrt(distinct / n),
            most / n,
            again,
            np.sqrt(again),
            1 - len(set(lines)) / len(lines),
            min(2.0, n / len(lines) / 50),
            float(size.max() > 40),
        )
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for the test; a null id is not."""
    number, rest = HELD_OUT
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % number == rest, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.shift, -30, 30)))


def fit(
    good: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 1500,
    batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7,
) -> Model:
    """Non-negative PU learning by Adam; where the bad part of the risk falls below 0 its gradient is turned."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([good, unlabelled])
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 0.02
    good, unlabelled = (good - mean) / scale, (unlabelled - mean) / scale
    d = good.shape[1]
    params = [
        rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden),
        rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        x = np.concatenate(
            [good[rng.integers(0, len(good), batch)], unlabelled[rng.integers(0, len(unlabelled), batch)]]
        )
        h = np.tanh(x @ params[0] + params[1])
        s = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        slope = s * (1 - s) / batch
        # loss of calling a row good is 1 - s, of calling it bad s
        bad_risk = s[batch:].mean() - prior * s[:batch].mean()
        g = np.zeros(2 * batch)
        if bad_risk >= 0:
            g[:batch] = -prior * slope[:batch] - prior * slope[:batch]
            g[batch:] = slope[batch:]
        else:
            g[:batch] = prior * slope[:batch]
            g[batch:] = -slope[batch:]
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [x.T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, grad, m, v in zip(params, grads, first, second):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def _features_of(docs: DataFrame) -> np.ndarray:
    def work(batches):
        for batch in small_slices(batches):
            yield [[row.tobytes() for row in features(batch.column(0))]]

    rows = map_arrow(docs.select(whole_text(docs).alias("text")), work, "x binary").toPandas()
    if not len(rows):
        return np.zeros((0, FEATURES), np.float32)
    return np.frombuffer(b"".join(rows["x"].map(bytes)), np.float32).reshape(-1, FEATURES).astype(np.float64)


def _drawn(df: DataFrame, total: int, salt: str, most: int) -> DataFrame:
    """About ``most`` of the rows, by a hash of doc_id; all where there are fewer."""
    if total <= most:
        return df
    share = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(salt)), 12) / F.lit(2.0**52)
    return df.where(share < F.lit(most / total)).limit(2 * most)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the labelled rows that are not held out; None without trusted good documents.

    Reads at most 2 * ``sample`` good and as many unlabelled documents.
    """
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    sizes = dict(known.where("quality IN (0, 1)").groupBy("quality").count().collect())
    if not sizes.get(1):
        return None
    prior = min(0.98, max(0.02, sizes[1] / sum(sizes.values())))
    rows = docs.select("doc_id", "text")
    ids = F.broadcast(_drawn(known.where("quality = 1").select("doc_id"), sizes[1], "good", sample))
    good = _features_of(rows.join(ids, "doc_id", "left_semi"))
    others = _drawn(rows.where(~held_out(F.col("doc_id"))), docs.count(), "any", sample)
    return fit(good, _features_of(others), prior) if len(good) else None


def good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose score is at least 0.5, all columns kept; without a model all rows.

    Null text counts as empty. Repeated rows are scored each; an empty table gives no rows.
    """
    text = docs.columns.index("text")

    def run(batches):
        for batch in small_slices(batches):
            yield batch.filter(pa.array(model.score(features(batch.column(text))) >= 0.5))

    return docs.mapInArrow(run, docs.schema) if model else docs


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with score and predicted, which take the place of columns of these names.

    Null text counts as empty. Without a model every score is 0.5. Repeated rows are
    scored each; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = docs.select([c for c in docs.columns if c.lower() not in ("score", "predicted")])
    schema = StructType(kept.schema.fields + [StructField("score", DoubleType())])
    text = kept.columns.index("text")
    names = kept.columns

    def run(batches):
        for batch in small_slices(batches):
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = model.score(features(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    out = kept.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
