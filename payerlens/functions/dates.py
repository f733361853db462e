"""Date parsing, period keys and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payerlens.functions.clean import _col, trim_text

# Accepted claim date layouts, each with the shape of its text.
# A parser only sees text of its own shape; failed parses are costly in the JVM.
CLAIM_DATE_LAYOUTS = (
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
)
PERIOD_PATTERN = r"((?:19|20)\d{2})[-/_]?(\d{2})"


def parse_date(c: Column | str, layouts=CLAIM_DATE_LAYOUTS) -> Column:
    """Date of a text in one of the layouts; anything else is NULL.

    Month names may be in any case.
    """
    text, out = trim_text(c), None
    for shape, layout in layouts:
        read = text
        if "MMM" in layout:
            read, layout = F.initcap(F.replace(text, F.lit("-"), F.lit(" "))), layout.replace("-", " ")
        parsed = F.try_to_date(read, layout)
        fits = text.rlike(shape)
        out = F.when(fits, parsed) if out is None else out.when(fits, parsed)
    return out


def parse_raw_date(c: Column | str) -> Column:
    """Date of raw claim files: day, month name, year."""
    return parse_date(c, CLAIM_DATE_LAYOUTS[3:])


def month_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def month_prefix(c: Column | str) -> Column:
    """Month of a timestamp kept as ISO text."""
    return F.substring(_col(c).cast("string"), 1, 7)


def normalize_period(c: Column | str) -> Column:
    """``YYYY-MM`` from texts such as 2024-03, 202403 or 2024/3/1; else NULL."""
    text = trim_text(c)
    year = F.regexp_extract(text, PERIOD_PATTERN, 1)
    month = F.regexp_extract(text, PERIOD_PATTERN, 2)
    return F.when((year != "") & (month != ""), F.concat_ws("-", year, month))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds with microsecond detail, for timestamps of either kind."""
    gap = _col(end) - _col(start)
    part = {u: F.date_part(F.lit(u), gap).cast("double") for u in ("DAY", "HOUR", "MINUTE", "SECOND")}
    return part["DAY"] * 86400 + part["HOUR"] * 3600 + part["MINUTE"] * 60 + part["SECOND"]


def minutes_between(start, end) -> Column:
    return seconds_between(start, end) / 60.0


def hours_between(start, end) -> Column:
    return seconds_between(start, end) / 3600.0


def days_between(start, end) -> Column:
    """Whole elapsed days, rounded down (also for negative spans)."""
    return F.floor(seconds_between(start, end) / 86400.0)


def age_years(birth, at) -> Column:
    return days_between(birth, at) / 365.25
