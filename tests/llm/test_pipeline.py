import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from payerlens.llm import pii, quality, queries
from payerlens.operators.stages import settle

from .conftest import sentence
from .test_documents import is_first_of_each, plain_clean

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


def planted(rows, passages):
    """Rows that the stages must decide: copies, hits and personal data under clean, null and repeated ids."""
    rng = random.Random(12)
    base = [text for _, text in rows if text and len(text.split()) > 40][:6]
    changed = " ".join(base[0].split()[:-1] + ["changed"])
    hit = f"{base[1]} {passages[0]} {sentence(rng, 20)}"
    out = [(None, base[0]), (90_001, changed), (90_001, base[2] + " " + sentence(rng, 80)), (None, hit), (90_002, hit)]
    out += [(90_003, f"{base[3]} {sentence(rng, 60)}"), (90_003, f"{sentence(rng, 60)} {passages[0]} {base[4]}")]
    out += [(90_004, ""), (90_005, None), (None, None), (90_006, " \n"), (90_007, sentence(rng, 20_000))]
    mails = f"{base[5]} write to jane.doe@example.com or +49 (30) 1234-5678 from 10.0.0.1 {sentence(rng, 50)}"
    return out + [(90_008, mails), (90_008, mails), (None, mails + " again")]


def test_run_is_plain_python(spark, tmp_path, monkeypatch):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = given + planted(given, [t for _, t in items if t and len(t.split()) > 12])
    docs = [(d, t, "en", f"s{k % 3}", len(t or ""), k, "x", 0.5, k % 2) for k, (d, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, first string, score double, place int"
    spark.createDataFrame(docs, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = settle(stage(spark, docs, sf_dir))
            seen[name] = docs, out
            assert name == "packing" or out.columns == docs.columns
            return out

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    tables = {name: [[(r.doc_id, r.text) for r in df.collect()] for df in pair] for name, pair in list(seen.items())[:4]}

    before, after = tables["quality"]
    assert Counter(before) == Counter(rows)
    model = quality.train(seen["quality"][0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = [float(model.score(quality.features(pa.array([t or ""])))[0]) for _, t in before]
    assert min(abs(s - 0.5) for s in scores) > 1e-4
    assert Counter(after) == Counter(r for r, s in zip(before, scores) if s >= 0.5)

    before, after = tables["near_copies"]
    assert is_first_of_each(after, before) and len(after) < len(before)

    before, after = tables["benchmark"]
    assert Counter(after) == Counter(plain_clean(before, items)) and len(after) < len(before)

    before, after = tables["personal_data"]
    network, want = pii.train(), []
    for doc, text in before:
        own = pii.base_spans(text or "")
        spans = own + pii.added_spans([text or ""], [own], network)[0]
        want.append((doc, None if text is None else pii.redacted(text, spans)))
    assert Counter(after) == Counter(want) and Counter(after) != Counter(before)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen["personal_data"][1].collect())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for doc, text in after:
        want[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    got, filled = defaultdict(list), Counter()
    for r in pieces.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        got[r.doc_id].append((r.start, ids))
        filled[r.sequence_id] += len(ids)
    assert set(got) == set(want)
    for doc, texts in want.items():
        if len(texts) == 1:
            assert [i for _, ids in sorted(got[doc]) for i in ids] == texts[0]
        assert Counter(i for _, ids in got[doc] for i in ids) == Counter(i for ids in texts for i in ids)
    assert all(filled[s] == 2048 for s in filled if s != max(filled))


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
