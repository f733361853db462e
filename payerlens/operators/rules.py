"""Rule catalogues evaluated in one pass.

Each row gets one bit per failed rule, packed in bigint columns. Only rows with
a failed rule are shuffled, and ``bit_or`` merges them per record key on the
map side, so counting distinct affected records for every rule and dimension
costs one narrow shuffle whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 60


@dataclass(frozen=True)
class Rule:
    dimension: str
    name: str
    action: str
    mask: Column


# Severity of the action a rule asks for.
ACTION_SEVERITY = {
    "quarantine": "critical",
    "quarantine_pend_before_payment": "critical",
    "route_to_data_exception_queue": "high",
    "pend_before_payment": "high",
    "flag_for_review": "warning",
    "flag_for_review_inferred_version": "warning",
}


def severity_of(action: Column) -> Column:
    out = F.lit("info")
    for name, severity in ACTION_SEVERITY.items():
        out = F.when(action == name, severity).otherwise(out)
    return out


def failed(mask: Column) -> Column:
    """Rule masks are two-valued: unknown counts as passed."""
    return F.coalesce(mask, F.lit(False))


def _words(rules: Sequence[Rule]) -> list[Sequence[Rule]]:
    return [rules[i : i + BITS] for i in range(0, len(rules), BITS)]


def _word_names(rules: Sequence[Rule]) -> list[str]:
    return [f"__fail{w}" for w in range(len(_words(rules)))]


def _packed(rules: Sequence[Rule]) -> Column:
    """Struct of one bigint per 60 rules."""
    words = []
    for name, word in zip(_word_names(rules), _words(rules)):
        bits = [F.when(failed(r.mask), F.lit(1 << i)).otherwise(0) for i, r in enumerate(word)]
        words.append(reduce(lambda a, b: a + b, bits).cast("bigint").alias(name))
    return F.struct(*words)


def _bit(rules: Sequence[Rule], position: int) -> Column:
    word = F.col(f"__fail{position // BITS}")
    return F.shiftright(word, position % BITS).bitwiseAND(F.lit(1)).cast("bigint")


def _any_of(rules: Sequence[Rule], chosen) -> Column:
    """1 when any rule accepted by ``chosen`` failed."""
    tests = []
    for w, word in enumerate(_words(rules)):
        bits = sum(1 << i for i, r in enumerate(word) if chosen(r))
        if bits:
            tests.append(F.col(f"__fail{w}").bitwiseAND(F.lit(bits).cast("bigint")) != 0)
    return reduce(lambda a, b: a | b, tests).cast("bigint") if tests else F.lit(0).cast("bigint")


def failing_records(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One row per record key with at least one failed rule."""
    names = _word_names(rules)
    # A generator, as masks in a projection would be evaluated again by the filter pushed below it;
    # without a lambda, which would have every mask interpreted row by row instead of compiled.
    some = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    return (
        df.select(*keys, F.inline(F.array(_packed(rules))).alias(*names))
        .filter(some)
        .groupBy(*keys)
        .agg(*[F.bit_or(n).alias(n) for n in names])
    )


FAILING, ROWS = "__failing", "__rows"


def all_records(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """As failing_records, with a row for the passing rows of each group ``by`` and the rows each stands for.

    So one pass over the rows tells their failures and their number.
    """
    names = _word_names(rules)
    some = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    rest = [F.when(F.col(FAILING), F.col(k)).alias(k) for k in keys if k not in by]
    return (
        df.select(*keys, F.inline(F.array(_packed(rules))).alias(*names))
        .withColumn(FAILING, some)
        .groupBy(*by, FAILING, *rest)
        .agg(F.count(F.lit(1)).alias(ROWS), *[F.bit_or(n).alias(n) for n in names])
    )


def dimensions_of(rules: Sequence[Rule]) -> list[str]:
    return list(dict.fromkeys(r.dimension for r in rules))


def count_findings(
    records: DataFrame, rules: Sequence[Rule], by: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """(by, dimension, rule, action, affected) per rule, and one row per dimension with rule NULL.

    ``total`` names a further column for the rows of each group, of records from all_records.
    """
    sums = [F.coalesce(F.sum(_bit(rules, i)), F.lit(0)).alias(f"r{i}") for i in range(len(rules))]
    dims = dimensions_of(rules)
    sums += [
        F.coalesce(F.sum(_any_of(rules, lambda r, d=d: r.dimension == d)), F.lit(0)).alias(f"d{j}")
        for j, d in enumerate(dims)
    ]
    by = list(by)
    if total:
        sums.append(F.sum(ROWS).alias(total))
    wide = records.groupBy(*by).agg(*sums)
    by += [total] if total else []
    entries = [
        _finding(r.dimension, r.name, r.action, F.col(f"r{i}")) for i, r in enumerate(rules)
    ] + [_finding(d, None, None, F.col(f"d{j}")) for j, d in enumerate(dims)]
    return wide.select(*by, F.explode(F.array(*entries)).alias("f")).select(*by, "f.*")


def _finding(dimension, rule, action, affected):
    return F.struct(
        F.lit(dimension).alias("dimension"),
        F.lit(rule).cast("string").alias("rule"),
        F.lit(action).cast("string").alias("action"),
        affected.cast("bigint").alias("affected"),
    )


def one_finding(counted: DataFrame, dimension: str, rule: str, action: str) -> DataFrame:
    """Rule and dimension rows from a one-row frame with an ``affected`` count."""
    both = [
        _finding(dimension, rule, action, F.col("affected")),
        _finding(dimension, None, None, F.col("affected")),
    ]
    return counted.select(F.explode(F.array(*both)).alias("f")).select("f.*")


def evidence_rows(df: DataFrame, rules: Sequence[Rule], file: str, columns: Sequence[str]) -> DataFrame:
    """One row per failed rule of every row, with the chosen source columns."""
    failures = [
        F.when(
            failed(r.mask),
            F.struct(
                F.lit(file).alias("file"),
                F.lit(r.dimension).alias("dimension"),
                F.lit(r.name).alias("rule"),
                F.lit(r.action).alias("action"),
            ),
        )
        for r in rules
    ]
    listed = F.filter(F.array(*failures), lambda f: f.isNotNull())
    return df.select(F.explode(listed).alias("f"), *columns).select("f.*", *columns)
