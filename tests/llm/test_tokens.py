import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from payerlens.llm import packing, token_file
from payerlens.llm.tokens import Encoder, encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "\x01", "'s", "'", "a", "Bc", "é", "ñ", "1", "23", "!!", "###", ".", "<|endoftext|>", "<|startoftext|>"]
PARTS += ["\x00", "\x1c", "\xa0", "　", "​", "é", "Σ", "ς", "İ", "漢字", "🙂", "\r\n", "’", "ing", "_"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(name):
    rng, tokenizer = random.Random(2), library(name)
    coder = Encoder(public_tokenizers.path(name), limit=300)
    for _ in range(20):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(40)]
        ids, sizes = coder.encode(texts)
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", FILES)
def test_pieces_by_size_are_pieces_by_mark(name):
    rng, coder = random.Random(3), Encoder(public_tokenizers.path(name))
    assert coder.spans is not None
    odd = ["", " ", " begin", "a\n", "a \n", "\x01", "naïve", "e\u0301", "Σας", "漢字", "it's", "a.\nB", "\xa0x"]
    for _ in range(50):
        own = ["".join(rng.choices("abZé1.'\n", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 30))]
        own += rng.choices(odd, k=rng.randint(0, 6))
        rng.shuffle(own)
        if own:
            (sizes, ids), (want_sizes, want) = coder.fresh(own), coder._marked(own)
            assert sizes.tolist() == want_sizes.tolist() and ids.tolist() == want.tolist()


@pytest.mark.parametrize("name", FILES)
def test_special_strings_are_what_the_library_makes_of_them(name):
    literals = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = [f.format(x, x) for x in literals for f in ("{}", "a {} b", "a{}b", "a {}b  {}", "{} ", "<|{}")] + ["plain text"]
    ids, sizes = Encoder(public_tokenizers.path(name)).encode(texts)
    want = [library(name).encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5), st.sampled_from(FILES))
def test_ids_of_any_text(texts, name):
    ids, _ = encoder(public_tokenizers.path(name)).encode(texts)
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 70), st.sampled_from([50.0, 90.0, 100.0]))
def test_blocks_round_trip(ids, block, percentile):
    payload, starts = token_file.pack(np.array(ids, np.uint32), block, percentile)
    assert token_file.unpack(payload, starts).tolist() == ids
    if len(starts) > 1:  # a block can be read alone
        assert token_file.unpack(payload, starts[1:2]).tolist() == ids[block : 2 * block]


def expected(rows, name, end):
    coder = library(name)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, coder.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in order]


def test_token_file(spark, odd_docs, odd_rows, tmp_path):
    path = str(tmp_path / "tokens")
    segments = token_file.encode_segments(odd_docs, public_tokenizers.path(FILES[0]), 2, segment_ids=500)
    token_file.write(segments, path)
    got = token_file.read(spark, path).collect()
    want = expected(odd_rows[0], FILES[0], 2)
    assert sorted((r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted(
        (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for _, ids in want
    )
    at = 0
    for row in sorted(got, key=lambda r: r.start):  # gapless, in ascending doc_id order
        assert row.start == at
        at += row.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [i for i, _ in want]


def test_empty_table_of_tokens(spark, no_docs, tmp_path):
    path = str(tmp_path / "none")
    token_file.write(token_file.encode_segments(no_docs, public_tokenizers.path(FILES[0]), 2), path)
    assert token_file.read(spark, path).count() == 0
    assert packing.pack(no_docs, public_tokenizers.path(FILES[1]), 1).count() == 0


@pytest.mark.parametrize("targets", [None, {"s0": 3, "s1": 1, None: 1}])
def test_packing(odd_docs, odd_rows, targets):
    size = 256
    got = packing.pack(odd_docs, public_tokenizers.path(FILES[1]), 1, size, 4, targets).collect()
    want = expected(odd_rows[0], FILES[1], 1)
    total = sum(len(ids) for _, ids in want)
    assert sum(r.length for r in got) == total
    known = {}
    for doc, ids in want:
        known.setdefault(doc, []).append(np.array(ids, "<u4").tobytes())
    for r in got:
        assert any(ids[4 * r.start : 4 * (r.start + r.length)] == r.ids for ids in known[r.doc_id])
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for number, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == min(size, total - size * number)
    starts = {}
    for r in got:
        starts[r.doc_id] = starts.get(r.doc_id, 0) + r.length
    assert starts == {doc: sum(len(x) // 4 for x in ids) for doc, ids in known.items()}


@pytest.mark.parametrize("targets", [None, {"s0": 3, "s1": 1, "s9": 2}, {None: 2, "s2": 0}])
def test_many_sources_are_packed_like_few(odd_docs, targets, monkeypatch):
    def packed():
        got = packing.pack(odd_docs, public_tokenizers.path(FILES[1]), 1, 64, 4, targets).drop("queue").collect()
        return sorted((r.sequence_id, r["offset"], r.length, r.start, bytes(r.ids), r.doc_tokens) for r in got)

    few = packed()
    monkeypatch.setattr(packing, "MOST_QUEUES", 2)
    monkeypatch.setattr(packing, "BLOCK", 2)
    assert packed() == few


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.integers(0, 60), min_size=1, max_size=6),
    st.one_of(st.none(), st.lists(st.integers(0, 5), min_size=6, max_size=6)),
    st.integers(1, 9),
    st.integers(1, 3),
)
def test_schedule_places_every_token_once(totals, shares, sequence, windows):
    phases = packing.schedule(totals, shares[: len(totals)] if shares else None)
    spots = set()
    for queue, n in enumerate(totals):
        at = 0
        while at < n:  # runs of three tokens
            run, done = min(3, n - at), 0
            for before, length, seq, offset in packing.places(phases, queue, at, run, windows * sequence, sequence):
                assert before == done and offset + length <= sequence
                spots.update(seq * sequence + offset + i for i in range(length))
                done += length
            assert done == run
            at += run
    assert spots == set(range(sum(totals)))


def test_windows_keep_the_mixture():
    totals, window = [6000, 3000, 1000], 100
    phases = packing.schedule(totals)
    held = {}
    for queue, n in enumerate(totals):
        for before, length, seq, offset in packing.places(phases, queue, 0, n, window, 50):
            w = (seq * 50 + offset) // window
            held[w, queue] = held.get((w, queue), 0) + length
    assert all(abs(held[w, q] - (60, 30, 10)[q]) <= 1 for w in range(100) for q in range(3))
