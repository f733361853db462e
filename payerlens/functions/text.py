"""Building blocks for explanation texts and delimited lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payerlens.functions.clean import _col, half_even


def fixed(c: Column | str, digits: int) -> Column:
    """Number as text with fixed decimals, rounded half to even; NULL stays NULL."""
    value = half_even(_col(c).cast("double"), digits)
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def fill(template: str, *values: Column) -> Column:
    """Replace each ``{}`` of a template by a text column."""
    parts = template.split("{}")
    pieces: list[Column] = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:], strict=True):
        pieces += [_col(value).cast("string"), F.lit(tail)]
    return F.concat(*pieces)


def joined(items: list[Column], separator: str) -> Column:
    """Join the non-NULL texts; '' when there are none."""
    return F.concat_ws(separator, *items)


def strongest(names_and_values: list[tuple[str, Column]]) -> Column:
    """Array of (value, name) with the largest value first.

    NULL values are left out; ties keep the given order.
    """
    entries = F.array(
        *[
            F.struct(
                value.cast("double").alias("value"),
                F.lit(-i).alias("order"),
                F.lit(name).alias("name"),
            )
            for i, (name, value) in enumerate(names_and_values)
        ]
    )
    return F.sort_array(F.filter(entries, lambda e: e["value"].isNotNull()), asc=False)


def names_at_least(names_and_values: list[tuple[str, Column]], floor: float) -> Column:
    """Names whose value reaches the floor, joined by ', '."""
    return joined([F.when(value >= floor, name) for name, value in names_and_values], ", ")


def first_match(text: Column | str, ordered: list[tuple[str, object]], default: Column) -> Column:
    """Result of the first pattern contained in the text."""
    text, out = F.lower(_col(text)), None
    for pattern, result in ordered:
        hit = text.contains(pattern)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(default) if out is not None else default


def distinct_json(c: Column | str) -> Column:
    """Aggregate: sorted distinct values as a JSON list."""
    return F.to_json(F.array_sort(F.collect_set(_col(c).cast("string"))))
