import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from payerlens.llm import alignment

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="session")
def plain():
    """Groups of a text by the libraries' calls on the whole text and a walk over the bytes."""
    byte_level, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    byte_level.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def groups(text):
        if not text:
            return []
        left = byte_level.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in t)) for i, t in zip(left.ids, left.tokens)]
        b = []
        for i in pieces.encode(text):
            piece = pieces.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            return []
        out, at_a, at_b, group_a, group_b = [], 0, 0, [], []
        a, b = a[::-1], b[::-1]
        while a or b:
            if at_a <= at_b:
                i, x = a.pop()
                group_a.append(i)
                at_a += len(x)
            else:
                i, x = b.pop()
                group_b.append(i)
                at_b += len(x)
            if at_a == at_b:
                out.append((group_a, group_b))
                group_a, group_b = [], []
        return out

    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(texts, plain):
    found = [plain(t) for t in texts]
    pairs = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    counts = collections.Counter(p for own in pairs for p in own)
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
            sum(k for p, k in own.items() if counts[p] == best[p[0]]),
            sum(k * counts[p] for p, k in own.items()),
            hashlib.sha256(written(g).encode()).hexdigest() if g else "",
        )
        for g, own in zip(found, pairs)
    ]


ODD = ["<|endoftext|> as text <s> </s> <unk> <0x41>", "a▁b", "  two  blanks  ", "\n\ttabs\r\n", "漢字🙂é", "aaaa" * 50, "\x01 \x00 \x01", " ", "a "]


def run(docs, chunk, block_tokens=alignment.BLOCK_TOKENS):
    found = alignment.linked(docs, A, B, chunk=chunk, remembered=500, block_tokens=block_tokens).collect()
    return [(r.doc_id, *(r[c] for c in SUMS), r.groups_sha256) for r in found]


@pytest.mark.parametrize("chunk", [40, 4096, alignment.CHUNK])
def test_against_the_libraries(spark, odd_docs, odd_rows, plain, chunk):
    rows = odd_rows[0] + [(100 + i, t) for i, t in enumerate(ODD)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    want = expected([t for _, t in rows], plain)
    got = run(docs, chunk)
    assert sorted(map(repr, got)) == sorted(repr((i, *w)) for (i, _), w in zip(rows, want))


def test_groups(spark, odd_docs, odd_rows, plain):
    got = alignment.aligned(odd_docs, A, B, chunk=300, remembered=500).collect()
    assert sorted((str(r.doc_id), r.groups) for r in got) == sorted((str(i), written(plain(t))) for i, t in odd_rows[0])
    for r in got:
        sizes = alignment.unpacked_sizes(r.sizes)
        a, b = (np.frombuffer(x, "<u2") for x in (r.ids_a, r.ids_b))
        assert alignment.spelled(a, b, *sizes).decode() == r.groups


def test_small_blocks(spark, odd_docs):
    docs = odd_docs.where("length(text) < 2000")
    assert sorted(map(repr, run(docs, 4096, block_tokens=30))) == sorted(map(repr, run(docs, 4096)))


def test_wide_groups(monkeypatch):
    rng = np.random.default_rng(1)
    sizes_a, sizes_b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    a, b = rng.integers(0, 5, sizes_a.sum()), rng.integers(0, 5, sizes_b.sum())
    usual = alignment.links(a, b, sizes_a, sizes_b)
    monkeypatch.setattr(alignment, "WIDE", 6)
    wide = alignment.links(a, b, sizes_a, sizes_b)
    assert wide[0].tolist() == usual[0].tolist() and wide[1].tolist() == usual[1].tolist()
    assert usual[1].sum() == (sizes_a * sizes_b).sum()


def test_empty_table(no_docs):
    assert run(no_docs, alignment.CHUNK) == []


SIZES = st.lists(st.integers(1, 4), max_size=12)


def made(size_a, size_b, total):
    """A text's tokens of both sides, by sizes that are filled up to the same end."""
    sides = []
    for sizes in (size_a, size_b):
        ends = [e for e in np.cumsum(sizes).tolist() if e < total] + [total]
        sides.append((np.arange(len(ends)) + 7, np.array(ends)))
    return sides


@settings(max_examples=150, deadline=None)
@given(SIZES, SIZES, st.integers(1, 40), st.lists(st.integers(0, 40), max_size=5), st.randoms(use_true_random=False))
def test_fragments_compose(size_a, size_b, total, cuts, rng):
    (a, ends_a), (b, ends_b) = made(size_a, size_b, total)
    whole = alignment.fragment(a, ends_a, b, ends_b)
    edges = [0, *sorted(min(c, total) for c in cuts), total]
    parts = []
    for low, high in zip(edges[:-1], edges[1:]):
        x, y = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
        parts.append(alignment.fragment(a[x], ends_a[x], b[y], ends_b[y]))
    while len(parts) > 1:  # any order of composition
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    for name in ("a", "b", "sizes_a", "sizes_b"):
        assert getattr(parts[0], name).tolist() == getattr(whole, name).tolist()
    assert sum(whole.sizes_a) == len(a) and whole.sizes_a[-1] == 0


def test_short_numbers():
    numbers = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert alignment._long(alignment._short(numbers)).tolist() == numbers.tolist()
    assert alignment._long(alignment._short(numbers[:0])).tolist() == []


def test_packed_sizes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40):
        a, b = rng.choice([0, 1, 2, 15, 16, 300, 70_000], n), rng.choice([0, 1, 2, 15, 16, 300], n)
        back = alignment.unpacked_sizes(alignment.packed_sizes(a, b))
        assert back[0].tolist() == a.tolist() and back[1].tolist() == b.tolist()


def test_spelled_ids():
    rng = random.Random(3)
    groups = [([rng.randrange(50_257) for _ in range(rng.randint(1, 4))], [rng.choice([0, 9, 10, 99, 100, 31_999])]) for _ in range(50)]
    a, b = (np.array([i for g in groups for i in g[k]]) for k in (0, 1))
    sizes = [np.array([len(g[k]) for g in groups]) for k in (0, 1)]
    assert alignment.spelled(a, b, *sizes).decode() == written(groups)
