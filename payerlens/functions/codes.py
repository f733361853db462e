"""Format predicates for identifiers and medical codes (format only, no checksum)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payerlens.functions.clean import _col, is_blank, text_or_empty

# Accepted formats and code sets.
NPI = r"^\d{10}$"
ICD10 = r"(?i)^[A-Z][0-9][0-9A-Z](\.?[0-9A-Z]{0,4})?$"
ICD9 = r"(?i)^(\d{3}(\.\d{1,2})?|[EV]\d{2,3}(\.\d{1,2})?)$"
HCPCS = r"^[A-Z0-9]{5}$"
SSA_STATE = r"^\d{2}$"
USPS_STATE = r"^([A-Z]{2}|\d{2})$"
STRUCTURAL_ICD = r"^[A-Z0-9]{3,7}$"
STRUCTURAL_HCPCS = r"^[A-Z0-9]{5}$"
ICD10_CUTOVER = "2015-10-01"
DIAGNOSIS_VERSIONS = ("0", "9", "10", "")
SEX_CODES = ("0", "1", "2")


def matches(c: Column | str, pattern: str) -> Column:
    """Trimmed text fits the format; NULL counts as empty text."""
    return F.trim(text_or_empty(c)).rlike(pattern)


def present_but_not(c: Column | str, pattern: str) -> Column:
    return ~is_blank(c) & ~matches(c, pattern)


def valid_diagnosis(code: Column | str, version: Column | str) -> Column:
    """Blank codes pass; version 0/10 means ICD-10, 9 means ICD-9, others pass."""
    v = F.trim(text_or_empty(version))
    return (
        F.when(F.trim(text_or_empty(code)) == "", True)
        .when(v.isin("0", "10"), matches(code, ICD10))
        .when(v == "9", matches(code, ICD9))
        .otherwise(True)
    )


def icd_version_on(date: Column | str) -> Column:
    """'0' (ICD-10) from the cutover date on, '9' before it, NULL without a date."""
    date = _col(date)
    cutover = F.lit(ICD10_CUTOVER).cast("date")
    return F.when(date >= cutover, "0").when(date < cutover, "9")


def structurally_invalid(c: Column | str, pattern: str = STRUCTURAL_ICD) -> Column:
    """Present (not NULL) but the upper-cased text does not fit."""
    c = _col(c).cast("string")
    return c.isNotNull() & ~F.upper(F.trim(F.coalesce(c, F.lit("")))).rlike(pattern)
