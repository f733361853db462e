"""Text, identifier and number cleaning, all as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace, texts that stand for "no value", and ids that are never real.
WHITESPACE = " \t\n\v\f\r"
NULL_TOKENS = ("", "NA", "N/A", "NULL", ".")
NULL_TOKENS_ANY_CASE = ("", "nan", "none", "null", "na", "n/a")
BLANK_TOKENS = ("", "nan", "NaN", "None")
INVALID_NPI = ("", "0", "nan", "None")
INVALID_CLAIM_ID = ("", "nan", "None")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_text(c: Column | str) -> Column:
    """Strip every kind of leading and trailing whitespace, not just blanks."""
    return F.btrim(_col(c).cast("string"), F.lit(WHITESPACE))


def null_tokens(c: Column | str, tokens=NULL_TOKENS, any_case: bool = False) -> Column:
    """NULL for the agreed "no value" texts, the trimmed text otherwise."""
    text = trim_text(c)
    probe = F.lower(text) if any_case else text
    return F.when(~probe.isin(*tokens), text)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True or False, never NULL."""
    return F.trim(text_or_empty(c)).isin(*BLANK_TOKENS)


def number(c: Column | str, digits: int | None = None) -> Column:
    """Lenient numeric cast: unreadable text and NaN become NULL."""
    value = F.nullif(_col(c).try_cast("double"), F.lit(float("nan")))
    return value if digits is None else half_even(value, digits)


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def non_negative(c: Column | str) -> Column:
    """NULL for negative values."""
    c = _col(c)
    return F.when(c >= 0, c)


def half_even(c: Column | str, digits: int) -> Column:
    """Round half to even, as the pipelines round stored values."""
    return F.bround(_col(c), digits)


def strip_minus(c: Column | str) -> Column:
    return F.regexp_replace(_col(c).cast("string"), "^-+", "")


def npi(c: Column | str) -> Column:
    """Provider id as text: trimmed, without the ``.0`` a float column leaves."""
    text = trim_text(c)
    return F.when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text)


def npi_digits(c: Column | str) -> Column:
    """As :func:`npi`, but drops ``.0`` only after an all-digit id."""
    return F.regexp_replace(trim_text(c), r"^(\d+)\.0$", "$1")


def is_valid_npi_key(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & ~c.isin(*INVALID_NPI)


def is_valid_claim_key(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & ~c.isin(*INVALID_CLAIM_ID)


def drug_key(c: Column | str) -> Column:
    """Join key for brand names: upper case, trimmed, double blanks halved."""
    return F.replace(F.trim(F.upper(text_or_empty(c))), F.lit("  "), F.lit(" "))


def brand_generic_key(brand: Column | str, generic: Column | str) -> Column:
    return F.concat_ws(
        "||", F.lower(F.trim(text_or_empty(brand))), F.lower(F.trim(text_or_empty(generic)))
    )


def code_key(c: Column | str) -> Column:
    """Codes and generic names compare upper case and trimmed; NULL stays NULL."""
    return F.upper(F.trim(_col(c).cast("string")))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division with NULL for a zero denominator."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def share_or_zero(numerator, denominator, scale: float = 100.0) -> Column:
    """Share of a whole, 0 when the whole is not positive."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(d > 0, F.try_divide(n, d) * scale).otherwise(0.0)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL (greatest/least would skip it)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def yes_flag(c: Column | str) -> Column:
    """1 for 'Y' in any case, 0 for everything else including NULL."""
    return (F.upper(F.trim(F.coalesce(_col(c).cast("string"), F.lit("N")))) == "Y").cast("int")


def key_text(*names: str) -> Column:
    """Readable record key such as ``BENE_ID=..|CLM_ID=..``."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), text_or_empty(n)) for n in names])
