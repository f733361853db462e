"""Quality rules as a learned decision list, in DataFrame operations only.

Whole numbers per text (symbols per thousand characters, repeated words per thousand and
so on) are the statistics. Sequential covering learns rules against bad texts: each
rule is a conjunction of thresholds, grown condition by condition by information gain
on the grow rows, pruned back on the prune rows, and its rows are set aside before the next
one. Every step is one aggregate over the labelled rows; the driver sees histograms
of at most CAP + 1 values a statistic. The list becomes a chain of Spark conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import whole_text

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Texts of more words than this have their windows counted in rows of their own.
IN_ROW = 200_000
#: Largest value of a statistic.
CAP = 1000
STATISTICS = (
    "words", "word_length", "symbols", "capitals", "marks", "digits", "repeated", "copied_lines", "line_words", "variety",
)


def _characters(text: str, of: str) -> Column:
    return F.length(text) - F.length(F.translate(text, of, ""))


def _covered(places: Column) -> Column:
    """Words in windows of three that begin at these ascending places."""
    after = F.slice(places, 2, F.size(places))
    steps = F.zip_with(after, places, lambda y, x: F.when(y.isNull(), 3).otherwise(F.least(y - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, s: n + s)


def counted(docs: DataFrame, in_row: int = IN_ROW, key: str = "doc_id") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and more counts) of every document.

    Words are runs of characters other than space and U+0009 to U+000D. n_repeat_words are
    the words in windows of three that come up twice or more in the text; windows are
    compared by a 64-bit hash. Null text has no words. Repeated rows and rows with a null
    doc_id are counted each; an empty table gives no rows; other columns are not looked
    at. Texts of more than ``in_row`` words spread their windows over rows, with the same counts.
    """
    text = whole_text(docs)
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    place = F.monotonically_increasing_id().alias("place")
    rows = docs.select(key, place, text.alias("text"), words.alias("split"), lines.alias("lines")).select(
        key,
        "place",
        "split",
        F.size("split").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        _characters("text", SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_capitals"),
        _characters("text", "!?").alias("n_marks"),
        _characters("text", "0123456789").alias("n_digits"),
        F.size(F.array_distinct("split")).alias("n_distinct"),
    )
    hashes = F.when(
        F.size("split") >= 3,
        F.transform(
            F.sequence(F.lit(1), F.size("split") - 2),
            lambda i: F.xxhash64(F.element_at("split", i), F.element_at("split", i + 1), F.element_at("split", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", hashes).drop("split")
    few = F.col("n_words") <= in_row

    sorted_windows = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    short = rows.where(few).withColumn(
        "ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_windows)
    )
    after = F.slice("ordered", 2, F.size("ordered"))
    twice = F.zip_with("ordered", after, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(twice, lambda p: p.isNotNull()))))
    short = short.withColumn("places", F.coalesce(places, F.array().cast("array<int>")))
    short = short.withColumn("n_repeat_words", _covered(F.col("places")).cast("bigint")).drop("windows", "ordered", "places")

    long = rows.where(~few)
    spread = (
        long.select("place", F.posexplode("windows").alias("i", "h"))
        .groupBy("place", "h")
        .agg(F.collect_list("i").alias("at"))
        .where(F.size("at") > 1)
        .select("place", F.explode("at").alias("i"))
        .select("place", F.explode(F.array(F.col("i"), F.col("i") + 1, F.col("i") + 2)).alias("word"))
        .distinct()
        .groupBy("place")
        .agg(F.count("*").alias("n_repeat_words"))
    )
    long = long.drop("windows").join(spread, "place", "left").na.fill(0, ["n_repeat_words"])
    return short.unionByName(long).drop("place")


def statistics(counts: DataFrame) -> DataFrame:
    """The counts with one whole number from 0 to CAP for each of STATISTICS."""

    def share(n: str, of: str) -> Column:
        return F.floor(F.col(n) * CAP / F.greatest(F.col(of), F.lit(1)))

    values = {
        "words": F.col("n_words"),
        "word_length": F.floor(F.col("word_chars") * 10 / F.greatest("n_words", F.lit(1))),
        "symbols": share("n_symbols", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "repeated": share("n_repeat_words", "n_words"),
        "copied_lines": share("n_dup_lines", "n_lines"),
        "line_words": F.floor(F.col("n_words") / F.greatest("n_lines", F.lit(1))),
        "variety": share("n_distinct", "n_words"),
    }
    return counts.withColumns({k: F.least(values[k], F.lit(CAP)).cast("int") for k in STATISTICS})


@dataclass(frozen=True)
class Condition:
    """``statistic >= least``, or below it where ``below``."""

    statistic: str
    below: bool
    least: int

    def column(self) -> Column:
        at = F.col(self.statistic)
        return at < self.least if self.below else at >= self.least

    def __str__(self) -> str:
        return f"{self.statistic} {'<' if self.below else '>='} {self.least}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(Column.__and__, (c.column() for c in rule))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule of the list that a row meets, from 1; null if none does."""
    found = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        found = F.when(holds(rule), number).otherwise(found)
    return found


def _gain(bad: int, n: int, all_bad: int, all_n: int) -> float:
    return bad * (math.log2(bad / n) - math.log2(all_bad / all_n)) if bad else 0.0


def best_condition(histogram: list[tuple[str, int, int, int]]) -> tuple[float, Condition | None]:
    """(gain, condition) of most information gain, from (statistic, value, bad rows, rows).

    Ties go to the first statistic of STATISTICS, lower bounds and the least threshold.
    """
    best, found = 0.0, None
    for name in STATISTICS:
        own = sorted((v, bad, n) for s, v, bad, n in histogram if s == name)
        all_bad, all_n = sum(r[1] for r in own), sum(r[2] for r in own)
        under_bad = under_n = 0
        for i, (value, bad, n) in enumerate(own):
            if i:
                for below, b, m in ((False, all_bad - under_bad, all_n - under_n), (True, under_bad, under_n)):
                    gain = _gain(b, m, all_bad, all_n)
                    if gain > best + 1e-9:
                        best, found = gain, Condition(name, below, value)
            under_bad, under_n = under_bad + bad, under_n + n
    return best, found


def _histogram(rows: DataFrame) -> list[tuple[str, int, int, int]]:
    cells = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("v")) for s in STATISTICS))).alias("c")
    found = rows.select("bad", cells).groupBy("c.s", "c.v").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    return [tuple(r) for r in found.collect()]


def _worth(bad: int, n: int) -> float:
    """A rule's part of bad rows, drawn towards one half while it has few rows."""
    return (bad + 1) / (n + 2)


def learn(labelled: DataFrame, most_rules: int = 12, most_conditions: int = 4, least_worth: float = 0.8) -> list[Rule]:
    """Rules for bad rows from a settled table of STATISTICS, ``bad`` (0 or 1) and ``prune`` (boolean).

    Learning ends when no bad grow row is left, a rule's worth on the prune rows is below
    ``least_worth`` or ``most_rules`` are found. Tables without bad or without good rows give none.
    """
    rules: list[Rule] = []
    rest = labelled
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < most_conditions:
            covered = rest.where(~F.col("prune"))
            histogram = _histogram(covered.where(holds(rule)) if rule else covered)
            bad = sum(r[2] for r in histogram if r[0] == STATISTICS[0])
            n = sum(r[3] for r in histogram if r[0] == STATISTICS[0])
            if not bad or bad == n:
                break
            _, condition = best_condition(histogram)
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        heads = [rule[: i + 1] for i in range(len(rule))]
        sums = [x for h in heads for x in (F.sum(F.when(holds(h), F.col("bad"))), F.count_if(holds(h)))]
        seen = [x or 0 for x in rest.where("prune").agg(*sums).first()]
        worth = [_worth(seen[2 * i], seen[2 * i + 1]) for i in range(len(heads))]
        kept = heads[worth.index(max(worth))]
        if max(worth) < least_worth:
            break
        rules.append(kept)
        rest = rest.where(~holds(kept))
    return rules


def trained_on(doc_id: Column) -> Column:
    """Whether a row's label may be learned from: crc32 of the id as text modulo 3 is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train(found: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from the statistics of the documents that ``labels`` marks (quality 0 is bad).

    A third of the rows, by a hash of the id, prunes. Rows with null ids or labels and those that
    fail the base rules anyway are left out.
    """
    marks = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").distinct()
    rows = found.where(~base_failed()).join(marks.where(trained_on(F.col("doc_id"))), "doc_id")
    bad = (F.col("quality") == 0).cast("int").alias("bad")
    prune = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
    return learn(settle(rows.select(*STATISTICS, bad, prune)))


def judged(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with base_failed, ``rule`` (number of the first rule met, null if none or already failed) and kept."""
    rows = found.withColumn("base_failed", base_failed())
    rows = rows.withColumn("rule", F.when(~F.col("base_failed"), first_rule(rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def rated(docs: DataFrame, labels: DataFrame, in_row: int = IN_ROW) -> tuple[DataFrame, list[Rule]]:
    """(documents' counts, statistics and verdicts, the rules learned from the labels).

    The counts are taken once and settled. See ``counted`` for nulls, repeated rows, empty
    tables and other columns.
    """
    found = settle(statistics(counted(docs, in_row)))
    rules = train(found, labels)
    return judged(found, rules), rules
