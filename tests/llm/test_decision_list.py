import random
import re

import pytest
from pyspark.sql import functions as F

from payerlens.llm import decision_list as rules_of
from payerlens.llm.decision_list import Condition

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, copied = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            copied += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copied, len(covered)


ODD = ["a a a", "a a a a", "a b c a b c", "a b a b a b", "x y z w x y z", "one\none\n \none", "# * $ | <>&%", "É É É É", "a\vb\fc\rd", "!?!? 12 A"]


@pytest.mark.parametrize("in_row", [3, rules_of.IN_ROW])
def test_counts(spark, odd_docs, odd_rows, in_row):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice("ab cd e f\n".split(" ")) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    got = rules_of.counted(docs, in_row).select("doc_id", *COUNTS).collect()
    want = [(i, *plain_counts(t)) for i, t in odd_rows[0]] + [(100 + i, *plain_counts(t)) for i, t in enumerate(texts)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_statistics(spark):
    text = "ABC de!! 12\nABC de!! 12\nx *|"
    row = rules_of.statistics(rules_of.counted(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    assert {s: row[s] for s in rules_of.STATISTICS} == {
        "words": 8, "word_length": 26, "symbols": 95, "capitals": 285, "marks": 190, "digits": 190, "repeated": 750,
        "copied_lines": 333, "line_words": 2, "variety": 625,
    }


def made(rng, n):
    """Bad rows: many symbols in short texts, or few distinct words; and some noise."""
    rows = []
    for i in range(n):
        row = {s: rng.randrange(0, 1001) for s in rules_of.STATISTICS}
        bad = (row["symbols"] >= 600 and row["words"] < 500) or row["variety"] < 120
        rows.append(row | {"bad": int(bad != (rng.random() < 0.01)), "prune": i % 3 == 0})
    return rows


def meets(row, rule):
    return all((row[c.statistic] < c.least) == c.below for c in rule)


def plain_best(rows):
    """The condition of most gain by trying every threshold on every row."""
    best, found = 0.0, None
    all_bad = sum(r["bad"] for r in rows)
    for s in rules_of.STATISTICS:
        for value in sorted({r[s] for r in rows})[1:]:
            for below in (False, True):
                c = Condition(s, below, value)
                own = [r["bad"] for r in rows if meets(r, (c,))]
                gain = rules_of._gain(sum(own), len(own), all_bad, len(rows))
                if gain > best + 1e-9:
                    best, found = gain, c
    return found


def plain_learn(rows, most_rules, most_conditions, least_worth):
    rules = []
    while len(rules) < most_rules:
        rule = ()
        while len(rule) < most_conditions:
            grow = [r for r in rows if not r["prune"] and meets(r, rule)]
            if not any(r["bad"] for r in grow) or all(r["bad"] for r in grow) or not (c := plain_best(grow)):
                break
            rule += (c,)
        worths = []
        for k in range(1, len(rule) + 1):
            own = [r["bad"] for r in rows if r["prune"] and meets(r, rule[:k])]
            worths.append((sum(own) + 1) / (len(own) + 2))
        if not worths or max(worths) < least_worth:
            return rules
        rules.append(rule[: worths.index(max(worths)) + 1])
        rows = [r for r in rows if not meets(r, rules[-1])]
    return rules


def test_learned_list(spark):
    rows = made(random.Random(1), 400)
    columns = [*rules_of.STATISTICS, "bad", "prune"]
    schema = ", ".join(f"{s} int" for s in columns[:-1]) + ", prune boolean"
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema).cache()
    learned = rules_of.learn(df, 4, 3, 0.7)
    assert learned == plain_learn(rows, 4, 3, 0.7) and len(learned) >= 2
    number = [next((i for i, rule in enumerate(learned, 1) if meets(r, rule)), None) for r in rows]
    got = [r[0] for r in df.select(rules_of.first_rule(learned)).collect()]
    assert got == number
    fresh = made(random.Random(2), 2000)
    right = sum(bool(r["bad"]) == any(meets(r, rule) for rule in learned) for r in fresh)
    assert right >= 0.93 * len(fresh)


def test_no_rules(spark):
    columns = [*rules_of.STATISTICS, "bad", "prune"]
    schema = ", ".join(f"{s} int" for s in columns[:-1]) + ", prune boolean"
    assert rules_of.learn(spark.createDataFrame([], schema)) == []
    rows = made(random.Random(1), 30)
    good = spark.createDataFrame([tuple((r | {"bad": 0})[c] for c in columns) for r in rows], schema)
    assert rules_of.learn(good) == []



def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found, rules = rules_of.rated(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert rules
    held = found.join(labels, "doc_id").where(~rules_of.trained_on(F.col("doc_id")) & ~F.col("base_failed"))
    right, n = held.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count("*")).first()
    assert n > 50 and right >= 0.95 * n


def test_odd_tables(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert rules_of.rated(no_docs, labels)[0].count() == 0
    found, rules = rules_of.rated(odd_docs, labels)
    assert rules == [] and found.where("kept = base_failed").count() == 0 and found.count() == odd_docs.count()
