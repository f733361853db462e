import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score string, place int, node string, part string, queue string, `offset` int"
)


def sentence(rng, n):
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, near and exact copies."""
    rng = random.Random(4)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:60] + sentence(rng, 60).split())
    passage = sentence(rng, 30)
    texts = {
        0: base, 1: near, 2: far, 3: base, 4: "", 5: None, 6: " \n\t ", 7: "one", 8: "two words", 9: "two words",
        10: sentence(rng, 30_000), 11: f"before it {passage} after it", 12: f"{passage.upper()} end",
        13: "a b c d", 14: "a b c d e", 15: "x" * 50_000, 16: "é ß  tab\tnew\nline", 17: "1 2 3 4 5 6 7 8 9 10",
    }
    rows = [(i, t) for i, t in texts.items()] + [(3, base), (20, base.upper()), (None, "nobody knows"), (None, None)]
    rows += [(30 + i, sentence(rng, rng.randint(1, 80))) for i in range(25)]
    return rows, passage


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    rows = [
        (i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, "x", 1, "n", "p", "q", 2)
        for k, (i, t) in enumerate(odd_rows[0])
    ]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
