"""Raw text tables to typed ones."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payerlens.functions.clean import (
    null_tokens,
    number,
    strip_minus,
    trim_text,
)
from payerlens.functions.dates import parse_raw_date
from payerlens.operators.contracts import (
    normalize_headers,
    require_columns,
    numeric_text,
    require_exact_columns,
    require_row_count,
)
from payerlens.operators.keyed import first_per_key

# Id and code columns that stay text.
ID_COLUMNS = re.compile(
    r"BENE_ID|CLM_ID|CARR_NUM|PRVDR_NUM|TAX_NUM|.*_PIN_NUM|ICD_DGNS_CD\d*|ICD_PRCDR_CD\d*|HCPCS_CD|.*_VRSN_CD"
)
SIGNED_IDS = ("BENE_ID", "CLM_ID")
PRESCRIBER_DRUG_COLUMNS = (
    "Prscrbr_NPI",
    "Prscrbr_Last_Org_Name",
    "Prscrbr_First_Name",
    "Prscrbr_City",
    "Prscrbr_State_Abrvtn",
    "Prscrbr_State_FIPS",
    "Prscrbr_Type",
    "Prscrbr_Type_Src",
    "Brnd_Name",
    "Gnrc_Name",
    "Tot_Clms",
    "Tot_30day_Fills",
    "Tot_Day_Suply",
    "Tot_Drug_Cst",
    "Tot_Benes",
    "GE65_Sprsn_Flag",
    "GE65_Tot_Clms",
    "GE65_Tot_30day_Fills",
    "GE65_Tot_Drug_Cst",
    "GE65_Tot_Day_Suply",
    "GE65_Bene_Sprsn_Flag",
    "GE65_Tot_Benes",
)
PRESCRIBER_DRUG_TYPES = {
    "Tot_Clms": "bigint",
    "Tot_30day_Fills": "decimal(10,2)",
    "Tot_Day_Suply": "bigint",
    "Tot_Drug_Cst": "decimal(12,2)",
    "Tot_Benes": "bigint",
    "GE65_Tot_Clms": "bigint",
    "GE65_Tot_30day_Fills": "decimal(10,2)",
    "GE65_Tot_Drug_Cst": "decimal(12,2)",
    "GE65_Tot_Day_Suply": "bigint",
    "GE65_Tot_Benes": "bigint",
}
DRUG_LIST_HEADERS = {
    "Drug Name": "drug_name",
    "Generic Name": "generic_name",
    "Opioid Flag": "opioid_flag",
    "LA Opioid Flag": "la_opioid_flag",
    "Antibiotic Flag": "antibiotic_flag",
    "Antipsychotic Flag": "antipsychotic_flag",
    "NDC Conflict Flag": "ndc_conflict_flag",
}
COUNT_WORDS = ("claims", "fills", "beneficiaries", "prescribers")
DRUG_LIST_ROWS = 474


def claims(raw: DataFrame) -> DataFrame:
    """Trim, NULL tokens, dates by ``_DT``, amounts by ``_AMT``, ids as unsigned text."""
    out = {}
    for c in raw.columns:
        text = null_tokens(c)
        if c in SIGNED_IDS:
            text = strip_minus(text)
        if c.endswith("_DT"):
            out[c] = parse_raw_date(text)
        elif c.endswith("_AMT") and not ID_COLUMNS.fullmatch(c):
            out[c] = number(text, 2)
        else:
            out[c] = text
    return raw.select(*[v.alias(c) for c, v in out.items()])


def prescriber_drug(raw: DataFrame) -> DataFrame:
    """The fixed 22 columns, trimmed, with numbers cast strictly; ids stay text."""
    df = require_exact_columns(raw, PRESCRIBER_DRUG_COLUMNS)
    df = df.select(*[F.nullif(trim_text(c), F.lit("")).alias(c) for c in df.columns])
    df = numeric_text(df, list(PRESCRIBER_DRUG_TYPES))
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in PRESCRIBER_DRUG_TYPES.items()})


def drug_list(raw: DataFrame, expected_rows: int | None = DRUG_LIST_ROWS) -> DataFrame:
    """Named columns, trimmed names, upper-case flags; row count checked unless None."""
    df = normalize_headers(raw, DRUG_LIST_HEADERS)
    df = require_columns(df, list(DRUG_LIST_HEADERS.values())).select(*DRUG_LIST_HEADERS.values())
    df = df.dropna("all")
    flags = [c for c in df.columns if c.endswith("_flag")]
    df = df.withColumns(
        {c: F.trim(F.col(c)) for c in ("drug_name", "generic_name")}
        | {c: F.upper(F.trim(F.col(c))) for c in flags}
    )
    return df if expected_rows is None else require_row_count(df, expected_rows)


def grand_totals(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per year: counts as whole numbers, costs and standardized fills as doubles."""
    df = normalize_headers(raw, {}).dropna("all")
    df = df.withColumn("calendar_year", number("calendar_year").cast("int"))
    out = {}
    for c in df.columns:
        if "cost" in c or "standardized" in c:
            out[c] = number(c)
        elif c != "calendar_year" and any(w in c for w in COUNT_WORDS):
            out[c] = number(c, 0).cast("bigint")
    df = df.filter(F.col("calendar_year").isNotNull()).withColumns(out)
    return first_per_key(df, ["calendar_year"], list(order))
