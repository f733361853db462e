import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from payerlens.llm import components, hashing, jaccard, pii, quality, secrets, sharding, simhash, winnow

from .conftest import sentence


def test_words():
    texts = ["Ab  c,d\n", "", "é1x", None, "\t", "last"]
    words = hashing.words_of(pa.array(texts))
    assert [words.joined(*words.of(i).indices(99)[:2]) for i in range(6)] == [
        b"ab c,d", b"", "é1x".encode(), b"", b"", b"last"
    ]
    same = hashing.words_of(pa.array(["x ab y", "ab"]))
    assert same.hashes[1] == same.hashes[3] != same.hashes[0]
    split = hashing.words_of(pa.array(["A,b-É_9"]), alnum=True)
    assert split.joined(0, 4) == "a b É 9".encode()


# ---- personal data


def test_base_spans():
    text = "a@b.c_d@e.f 1.2.3.4 256.1.1.1, 4111 1111-1111 1111 +1 (555) 123-4567 x@y@z.com"
    found = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert found == [
        ("email", "a@b.c"), ("email", "_d@e.f"), ("email", "y@z.com"), ("ip", "1.2.3.4"),
        ("card", "4111 1111-1111 1111"), ("phone", "+1 (555) 123-4567"),
    ]


def test_long_leading_zeros():
    for zeros in ("0" * 30, "0" * 4000, "0" * 9000):
        text = f"{zeros}1.2.{zeros}.{zeros}255 256.1.1.1 {zeros}256.1.1.1"
        assert pii.base_spans(text)[0] == ("ip", 0, len(text.split(" ")[0]))
        assert sum(k == "ip" for k, *_ in pii.base_spans(text)) == 1


def plain_base(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(6)
    parts = list("0123456789") + ["@", ".", "a", "b1", "-", " ", "+", "(", ")", "_", "4111111111111111", "10.0.0.1", "x@y.zz", "+1 555", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text)


def test_network(odd_docs, odd_rows, no_docs):
    model = pii.train()
    rng = np.random.default_rng(321)
    hit = wrong = missed = 0
    for _ in range(200):
        text, spans = pii.labelled_text(rng, 300)
        base = pii.base_spans(text)
        added = pii.added_spans([text], [base], model)[0]
        got = set(base + added)
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert wrong < 0.03 * hit and missed < 0.05 * hit
    text = "+1 (663) 555-6869 4465758382889437 and (743) 555-3824, jane [at] mail [dot] org"
    added = pii.added_spans([text], [pii.base_spans(text)], model)[0]
    assert {text[a:b] for _, a, b in added} >= {"4465758382889437", "(743) 555-3824"} - {
        text[a:b] for _, a, b in pii.base_spans(text)
    }
    clean = sentence(random.Random(1), 400) + " 2024-05-12 123456 v1.2.3 12:30"
    assert pii.added_spans([clean], [[]], model) == [[]]
    # far places of a long text are found like near ones
    long = "word " * 20_000 + "(743) 555-3824 end"
    assert pii.added_spans([long], [[]], model)[0] == [("phone", 100_000, 100_014)]
    rows = pii.find(odd_docs, model).collect()
    assert len(rows) == len(odd_rows[0])
    assert pii.find(no_docs, model).count() == 0
    assert pii.redact(odd_docs, model).columns == odd_docs.columns
    assert pii.redacted("a x@y.zz b", [("email", 2, 8)]) == "a <EMAIL> b"


def test_long_addresses_at_every_offset():
    model = pii.train()
    for address in (
        "maria.gonzalezs (at) engineering (dot) example (dot) org",
        "maria.gonzalez (at) engineering (dot) northern (dot) laboratory (dot) institute (dot) university (dot) example (dot) com",
    ):
        assert len(address) in (56, 120)
        texts = [f"{'word ' * 40}"[: 96 + k] + f" {address} and then more plain words" for k in range(48)]
        want = [[("email", t.index(address), t.index(address) + len(address))] for t in texts]
        assert pii.added_spans(texts, [[]] * 48, model) == want
        # the windows of many texts at once, in batches that part a run
        assert pii.added_spans(texts, [[]] * 48, model, together=5) == want


def test_each_labelled_form_alone():
    """The place of a form opens windows by itself, in a long plain text."""
    model = pii.train()
    forms = [f"jane.doe{at}host{dot}{end}" for at in (" at ", " (at) ", " [at] ", "(at)", "[at]") for dot in (" dot ", " (dot) ", " [dot] ", ".") for end in ("com", f"example{dot}org")]
    forms += ["jane.doe at\nmail dot org", "jane.doe at mail\ndot org", "jane.doe\nat mail dot org", "jane.doe (at)\nmail.de", "jane.doe at\nexample.com"]
    kinds = ["email"] * len(forms)
    for kind, number in (("phone", "555-123-4567"), ("phone", "(555) 123-4567"), ("phone", "(555)123-4567"), ("card", "4111-1111-1111-1111"), ("ip", "10.2.3.44")):
        forms.append(number)
        kinds.append(kind)
    for kind, form in zip(kinds, forms):
        text = f"{sentence(random.Random(3), 300)} write to {form} today {sentence(random.Random(5), 300)}"
        a = text.index(form)
        base = pii.base_spans(text)
        assert base + pii.added_spans([text], [base], model)[0] == [(kind, a, a + len(form))], form
    assert pii.added_spans(["they met at noon and at the end. Then at home"], [[]], model) == [[]]


def test_runs_are_decoded_as_a_whole():
    rng = np.random.default_rng(8)
    k = len(pii.TAGS)
    moves = rng.normal(0, 1, (k, k))
    for edges in ([0, 1], [0, 40], [0, 7, 8, 300, 301, 640]):
        e = rng.normal(0, 2, (edges[-1], k))
        e[rng.random(len(e)) < 0.6, 0] += 12
        want = []
        for a, b in zip(edges[:-1], edges[1:]):
            score, back = e[a], []
            for t in range(a + 1, b):
                whole = score[:, None] + moves
                back.append(whole.argmax(axis=0))
                score = whole.max(axis=0) + e[t]
            tags = [int(score.argmax())]
            for row in reversed(back):
                tags.append(int(row[tags[-1]]))
            want += tags[::-1]
        assert pii.viterbi(e, moves, np.array(edges)).tolist() == want
    assert pii.viterbi(np.zeros((0, k)), moves, np.array([0])).tolist() == []


# ---- simhash


def test_simhash(spark, odd_docs, odd_rows, no_docs):
    got = simhash.with_next(odd_docs).collect()
    assert len(got) == len(odd_rows[0])
    order = sorted(odd_rows[0], key=lambda r: (r[0] is not None, r[0] or 0))
    whole = [t or "" for _, t in order]
    want = []
    for i, text in enumerate(whole):
        n = len(text) // 4
        changed = text[: len(text) - n] + whole[(i + 1) % len(whole)][:n]
        want.append((order[i][0], len(text), hashlib.sha256(changed.encode()).hexdigest()))
    known = {i for i, _ in order[:-1] if i is not None and i != 3}  # order of repeated ids is free
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id in known} == {w for w in want if w[0] in known}
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[0] == prints[3] and prints[8] == prints[9]
    raised = re.sub("[a-z]", lambda m: m[0].upper(), dict(order)[0])
    cased = spark.createDataFrame([(0, dict(order)[0]), (1, raised)], "doc_id bigint, text string")
    assert len({r.fingerprint for r in simhash.with_next(cased).collect()}) == 1
    assert simhash.with_next(no_docs).count() == 0
    one = spark.createDataFrame([(1, "alone here")], "doc_id bigint, text string")
    assert [r.near_next for r in simhash.with_next(one).collect()] == [1.0]


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), n)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    got = {(r.query, r.fingerprint) for r in simhash.near_pairs(df, df, 3).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if ((a ^ b) & mask).bit_count() <= 3}


# ---- quality


def test_quality(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        text = sentence(rng, 60) if good else " ".join([rng.choice(("BUY!!", "NOW%%%", "win$$$"))] * 40)
        rows.append((i, text))
        if rng.random() < 0.6:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(None, None, None), labels[0]], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, marks)
    truth = {i: q for i, q, _ in labels}
    tested = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert np.mean([got[i].predicted == truth[i] for i in tested]) > 0.97
    assert quality.good(odd_docs, model).columns == odd_docs.columns
    assert quality.scored(odd_docs, model).count() == len(odd_rows[0])
    assert quality.scored(no_docs, model).count() == 0
    assert quality.train(docs, marks.where("false")) is None
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}


# ---- decontamination


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_hits(docs, items):
    out = []
    for doc, text in docs:
        words, hit, named = plain_words(text), set(), set()
        for item, passage in items:
            own = plain_words(passage)
            m = min(10, len(own))
            windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    if item is not None:
                        named.add(str(item))
        out.append((-1 if doc is None else doc, len(words), len(hit), tuple(sorted(named))))
    return sorted(out)


def plain_clean(rows, items):
    """The rows without a hit."""
    return [row for row in rows if not plain_hits([row], items)[0][2]]


def test_contamination(spark, odd_docs, odd_rows, no_docs):
    rows, passage = odd_rows
    items = [(1, passage), (2, passage.replace(" ", "--").upper()), (3, "a b, c d"), (4, "one"), (5, ""), (6, None)]
    items += [(7, " ".join(passage.split()[5:12])), (None, "two words"), (1, passage), (8, sentence(random.Random(8), 40))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_hits(rows, items)
    for most in (1_000_000, 3):  # by array and by join
        got = winnow.contamination(odd_docs, benchmark, most_fingerprints=most).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert winnow.contamination(no_docs, benchmark).count() == 0
    assert {r.n_hit for r in winnow.contamination(odd_docs, benchmark.where("false")).collect()} == {0}
    kept = winnow.clean(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(plain_clean(rows, items))
    # a hit text under the id of a clean one, and under no id
    more = [(7, f"x {passage}"), (None, f"{passage} y"), (None, f"{passage} y"), (None, "clean"), (7, "clean too")]
    docs = spark.createDataFrame(more, "doc_id bigint, text string")
    assert Counter(map(tuple, winnow.clean(docs, benchmark).collect())) == Counter(more[3:])
    assert winnow.clean(docs, benchmark.where("false")).count() == len(more)
    assert winnow.clean(no_docs, benchmark).count() == 0


# ---- secrets


def test_secrets(spark, odd_docs, odd_rows, no_docs):
    x, y = secrets.labelled(800, 99)
    assert ((secrets.scores(x, secrets.forest()) >= 0.5) == y).mean() > 0.97
    key = "0f3e9a7bc14d55e2a9917b3dd0c8e6f1a2b3c4d5"
    docs = spark.createDataFrame(
        [(1, f'é token = "{key}" end'), (2, f"commit {key}"), (3, "plain words only"), (4, None)], "doc_id bigint, text string"
    )
    got = {r.doc_id: r for r in secrets.find(docs).collect()}
    assert got[1].secrets == "11:51" and got[1].n_secrets == 1
    assert got[2].n_candidates == 1 and got[2].n_secrets == 0
    assert got[3].n_candidates == got[4].n_candidates == 0
    assert secrets.find(odd_docs).count() == len(odd_rows[0])
    assert secrets.find(no_docs).count() == 0


def test_secrets_of_settings(spark):
    """Exact spans of lines as in .env files and shells."""
    hexed, alnum = "0f3e9a7bc14d55e2a9917b3dd0c8e6f1a2b3c4d5", "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5"
    lines = [
        ("API_TOKEN=", f"ghp_{alnum}", ""), ("export SECRET_KEY=", hexed, ""), ("password: ", "Tr0ub4dor3x", ""),
        ("DB_PASSWORD=", "k9!vR2@xQ#7m$L&p", ""), ('password = "', "hT7$kq!2Zw", '"'), ("client_secret: '", "QwhzRtYkPlmNbVcXjHgFdSaZ", "'"),
        ("curl -H token=", f"ghp_{alnum}", " -v"), ("", "kQzhWvRtYpLmNbVcXjHgFdSaZq", " is the secret token"),
    ]
    docs = spark.createDataFrame([(i, f"é first\n{a}{b}{c}\nlast") for i, (a, b, c) in enumerate(lines)], "doc_id bigint, text string")
    got = {r.doc_id: r.secrets for r in secrets.find(docs).collect()}
    assert got == {i: f"{8 + len(a)}:{8 + len(a) + len(b)}" for i, (a, b, _) in enumerate(lines)}
    env = "".join(f"{a}{b}{c}\n" for a, b, c in lines[:4])
    assert [env[a:b] for a, b in secrets.candidates(env)] == [b for _, b, _ in lines[:4]]
    harmless = "password: string and token = session.token() but author: Someone Else-where, monkey=abcdefghij"
    rows = secrets.find(spark.createDataFrame([(1, harmless)], "doc_id bigint, text string")).collect()
    assert rows[0].n_secrets == 0
    assert secrets.assigned("key=" * 50_000 + "abcdefgh1") == [(200_000, 200_009)]


# ---- shards


def test_shards(odd_docs, odd_rows, no_docs):
    got = sharding.shard_rows(odd_docs, 8).collect()
    assert len(got) == len(odd_rows[0])
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sums = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in odd_rows[0])
    assert sorted((r["size"], r.text_crc32) for r in got) == sums
    assert sharding.shard_rows(no_docs, 8).count() == 0


def test_tree_moves_only_inside(spark):
    keys = spark.range(20_000)
    one = {"a": (2.0, {"x": (1.0, 0), "y": (1.0, 1)}), "b": (2.0, {"z": (1.0, 2), "w": (1.0, 3)})}
    two = {"a": (2.0, one["a"][1]), "b": (2.0, {"z": (3.0, 2), "w": (1.0, 3)})}
    rows = keys.select(
        sharding.place(keys["id"], one).alias("p"), sharding.place(keys["id"], two).alias("q")
    ).collect()
    assert all(r.p == r.q for r in rows if r.p in (0, 1))
    assert all(r.q == 2 for r in rows if r.p != r.q)
    share = np.bincount([r.q for r in rows]) / len(rows)
    assert np.allclose(share, [0.25, 0.25, 0.375, 0.125], atol=0.02)


# ---- near copies


def plain_groups(rows):
    """(doc, n-grams, number of the group of links) of every row."""
    sets = []
    for doc, text in rows:
        words = [w for w in re.split("[\x20\t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets.append((doc, frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    return [(doc, s, root(i)) for i, (doc, s) in enumerate(sets)]


def plain_classes(rows):
    groups, best = plain_groups(rows), {}
    for doc, _, group in groups:
        if doc is not None:
            best[group] = min(doc, best.get(group, doc))
    return sorted((doc, len(s), best[group]) for doc, s, group in groups if doc is not None)


def is_first_of_each(kept, rows):
    """Whether kept has one row of the smallest doc_id (null last) of every group, and the rows without n-grams."""
    kept = Counter((doc, text or "") for doc, text in kept)
    single = sorted({(doc, text or "") for doc, text in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    groups = defaultdict(list)
    for row, (_, found, group) in zip(single, plain_groups(single)):
        groups[group if found else (group, "alone")].append(row)
    for own in groups.values():
        first = [row for row in own if row[0] == own[0][0]]
        if sum(kept.pop(row, 0) for row in first) != 1:
            return False
    return not kept


def near_rows(seed):
    """Chains and stars of edits around 0.8, docs that share a passage, copies."""
    rng = random.Random(seed)
    rows, passage = [], sentence(rng, 40)
    for _ in range(6):
        text = sentence(rng, rng.randint(5, 60)).split()
        rows.append(" ".join(text))
        for _ in range(12):
            other = list(text)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = sentence(rng, 1)
            rows.append(" ".join(other))
            if rng.random() < 0.4:
                text = other  # a chain
    rows += [f"{sentence(rng, 15)} {passage} {sentence(rng, 15)}" for _ in range(30)]
    rows += ["a b c d", "a b c d e", "a b c", "a b c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    for docs, rows in ((odd_docs, odd_rows[0]), (None, near_rows(1)), (None, near_rows(2))):
        if docs is None:
            docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
            monkeypatch.setattr(jaccard, "FREQUENT", 0.05)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect() if r.doc_id is not None)
        assert got == plain_classes(rows)
    assert jaccard.classes(no_docs).count() == 0


def test_first_of_each(odd_docs, odd_rows):
    kept = jaccard.first_of_each(odd_docs)
    want = {doc for doc, _, component in plain_classes(odd_rows[0]) if doc == component}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert is_first_of_each([(r.doc_id, r.text) for r in kept.collect()], odd_rows[0])


def test_first_of_each_decides_by_row(spark, no_docs):
    rng = random.Random(6)
    rows = [(None if i % 4 == 0 else i % 30, text) for i, text in near_rows(3)]
    alone, near = sentence(rng, 40), sentence(rng, 60)
    rows += [(None, alone), (None, alone), (5, near), (5, near + " end"), (None, near), (6, ""), (6, None), (None, " ")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, key int, first string")
    kept = jaccard.first_of_each(docs.repartition(3))
    assert kept.columns == docs.columns
    assert is_first_of_each([(r.doc_id, r.text) for r in kept.collect()], rows)
    assert jaccard.first_of_each(no_docs).count() == 0


def test_overlap():
    rng = np.random.default_rng(4)
    for groups, top in ((jaccard.GROUPS, 9), (jaccard.FINE, 256), (jaccard.FINE, 70_000), (12, 256)):
        a, b = (rng.integers(0, top, (40, groups)).astype(np.uint8 if top < 257 else np.uint32) for _ in range(2))
        for q in (b, b[0]):
            assert (jaccard.overlap(a, q) == np.minimum(a, q).astype(np.int64).sum(axis=1)).all()
    full = np.full((2, jaccard.FINE), 255, np.uint8)
    assert jaccard.overlap(full, full).tolist() == [255 * jaccard.FINE] * 2


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(5)
    center = rng.poisson(6, (8, jaccard.GROUPS))
    point = (center[rng.integers(0, 8, 300)] + rng.integers(-1, 2, (300, jaccard.GROUPS)).clip(0)).clip(0).astype(np.int32)
    n, node, label = point.sum(axis=1).astype(np.int64), np.arange(300), rng.integers(0, 40, 300)
    want = {
        (i, j)
        for i in range(300)
        for j in range(i)
        if label[i] != label[j] and 180 * np.minimum(point[i], point[j]).sum() >= 80 * (n[i] + n[j])
        and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])
    }
    got = [tuple(sorted(p, reverse=True)) for p in jaccard.survivors(node, label, n, point, np.zeros(300, np.int64), 80)]
    assert set(got) == want and len(got) == len(want)
    # nearest ones are some of them, at most one a node, and every node with a pair has one
    whole = [np.zeros(300, np.int64), node, label, n, point]
    for near in (
        list(jaccard.survivors(*whole[1:], whole[0], 80, True)),
        jaccard.small_survivors(node // 30, *whole[1:], 80, True).T.tolist(),
    ):
        assert {tuple(sorted(p, reverse=True)) for p in near} <= want and len(near) <= 300
    assert {i for p in jaccard.survivors(*whole[1:], whole[0], 80, True) for i in p} == {i for p in want for i in p}
    # as two chunks
    as_bytes = jaccard.survivors(node, label, n, point.astype(np.uint8), np.zeros(300, np.int64), 80)
    assert {tuple(sorted(p, reverse=True)) for p in as_bytes} == want
    half = rng.integers(0, 2, 300).astype(bool)
    across = {tuple(sorted(p, reverse=True)) for p in jaccard.survivors(node, label, n, point, np.where(half, 1, -1), 80)}
    assert across == {(i, j) for i, j in want if half[i] != half[j]}


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 450)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in links for x in (a, b) if a != b}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
