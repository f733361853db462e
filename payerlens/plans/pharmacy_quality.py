"""Pharmacy data quality per provider: findings, dimension scores, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.functions import codes
from payerlens.functions.bands import QUALITY_STATUS, severity_from_pct
from payerlens.functions.clean import clip, half_even, number, share_or_zero, text_or_empty
from payerlens.operators.contracts import existing, require_columns
from payerlens.operators.stages import settle

# Fixed values.
REQUIRED = (
    "Prscrbr_NPI",
    "Prscrbr_Last_Org_Name",
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
)
TYPE_SOURCES = ("Claim-Specialty", "NPPES-Specialty", "NPPES-Taxonomy")
SUPPRESSION_SYMBOLS = ("*", "#", "")
STATE_CODES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH "
    "NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY PR VI GU AS MP"
).split()
DIMENSION_WEIGHTS = {
    "completeness": 0.15,
    "uniqueness": 0.10,
    "validity": 0.15,
    "consistency": 0.15,
    "referential_integrity": 0.10,
    "concordance": 0.10,
    "plausibility": 0.15,
    "correctness": 0.10,
}
SEVERITY_PENALTY = {"critical": 1.0, "high": 0.75, "warning": 0.40, "info": 0.0}
UNIQUE_KEY = ("Prscrbr_NPI", "Brnd_Name", "Gnrc_Name")
NON_NEGATIVE = ("Tot_Clms", "Tot_30day_Fills", "Tot_Day_Suply", "Tot_Drug_Cst")
SUPPRESSION_FLAGS = ("GE65_Sprsn_Flag", "GE65_Bene_Sprsn_Flag")
PARTS = (
    ("GE65_Tot_Clms", "Tot_Clms"),
    ("GE65_Tot_30day_Fills", "Tot_30day_Fills"),
    ("GE65_Tot_Drug_Cst", "Tot_Drug_Cst"),
    ("GE65_Tot_Day_Suply", "Tot_Day_Suply"),
    ("GE65_Tot_Benes", "Tot_Benes"),
)
SUPPLY_TOLERANCE_PCT = 30
CLAIMS_PER_BENEFICIARY = 20


@dataclass(frozen=True)
class Check:
    dimension: str
    field: str
    rule: str
    mask: Column
    severity: str | None = None


def checks(df: DataFrame) -> list[Check]:
    """Row checks for the columns present; severity follows the share unless fixed."""
    out = [Check("completeness", c, "not_null", F.col(c).isNull()) for c in existing(df, REQUIRED)]
    out += [
        Check(
            "validity",
            "Prscrbr_NPI",
            "must_be_10_digits",
            ~codes.matches("Prscrbr_NPI", codes.NPI),
        ),
        Check(
            "validity",
            "Prscrbr_State_Abrvtn",
            "must_be_valid_state_code",
            ~text_or_empty("Prscrbr_State_Abrvtn").isin(*STATE_CODES),
        ),
        Check(
            "validity",
            "Prscrbr_Type_Src",
            "must_be_allowed_value",
            ~text_or_empty("Prscrbr_Type_Src").isin(*TYPE_SOURCES),
        ),
    ]
    out += [Check("validity", c, "must_be_non_negative", number(c) < 0) for c in NON_NEGATIVE]
    out += [
        Check(
            "validity",
            c,
            "must_be_valid_suppression_symbol",
            ~F.trim(text_or_empty(c)).isin(*SUPPRESSION_SYMBOLS),
        )
        for c in existing(df, SUPPRESSION_FLAGS)
    ]
    out += [
        Check(
            "consistency", f"{part} vs {whole}", f"{part}_must_not_exceed_{whole}", number(part) > number(whole)
        )
        for part, whole in PARTS
        if part in df.columns and whole in df.columns
    ]
    if "Tot_Benes" in df.columns:
        more = number("Tot_Benes") > number("Tot_Clms")
        out.append(Check("consistency", "Tot_Benes", "Tot_Benes_must_not_exceed_Tot_Clms", more))
    expected = number("Tot_30day_Fills") * 30
    off = F.abs(number("Tot_Day_Suply") - expected) / F.nullif(expected, F.lit(0.0)) * 100
    out.append(
        Check(
            "consistency",
            "Tot_Day_Suply vs Tot_30day_Fills*30",
            "soft_ratio_check_30pct_tolerance",
            (expected > 0) & (off > SUPPLY_TOLERANCE_PCT),
            "warning",
        )
    )
    if "Tot_Benes" in df.columns:
        per_person = number("Tot_Clms") / F.nullif(number("Tot_Benes"), F.lit(0.0))
        out.append(
            Check(
                "plausibility",
                "Tot_Clms / Tot_Benes",
                "claims_per_beneficiary_over_20_flagged_for_review",
                per_person > CLAIMS_PER_BENEFICIARY,
                "warning",
            )
        )
    return out


MEASURES = {
    "total_claims": "Tot_Clms",
    "total_fills": "Tot_30day_Fills",
    "total_day_supply": "Tot_Day_Suply",
    "total_drug_cost": "Tot_Drug_Cst",
    "total_beneficiaries": "Tot_Benes",
}
ATTRIBUTES = {
    "provider_last_name": "Prscrbr_Last_Org_Name",
    "provider_first_name": "Prscrbr_First_Name",
    "provider_type": "Prscrbr_Type",
    "state": "Prscrbr_State_Abrvtn",
}


def provider_totals(prescriptions: DataFrame) -> DataFrame:
    """Per provider: rows, failed rows per check, repeated keys, totals, attributes.

    Rows are first reduced to one per provider and drug, which settles the
    key check and spreads a dominant provider over many tasks.
    """
    df = require_columns(prescriptions, REQUIRED)
    rules = checks(df)
    rows = df.withColumn("Prscrbr_NPI", F.trim(text_or_empty("Prscrbr_NPI"))).filter(
        F.col("Prscrbr_NPI") != ""
    )
    fails = [F.count(F.when(c.mask, 1)).alias(f"c{i}") for i, c in enumerate(rules)]
    sums = [
        (F.sum(F.coalesce(number(c), F.lit(0.0))) if c in df.columns else F.lit(0.0)).alias(name)
        for name, c in MEASURES.items()
    ]
    firsts = [
        F.min(F.trim(F.col(c).cast("string"))).alias(name)
        for name, c in ATTRIBUTES.items()
        if c in df.columns
    ]
    per_drug = rows.groupBy(*UNIQUE_KEY).agg(F.count(F.lit(1)).alias("n"), *fails, *sums, *firsts)
    generic = F.nullif(F.trim(F.col("Gnrc_Name").cast("string")), F.lit(""))
    return per_drug.groupBy("Prscrbr_NPI").agg(
        F.sum("n").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"),
        F.countDistinct(generic).alias("unique_drugs"),
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))],
        *[F.sum(name).alias(name) for name in MEASURES],
        *[F.min(name).alias(name) for name, c in ATTRIBUTES.items() if c in df.columns],
    )


def findings(totals: DataFrame, rules: list[Check]) -> DataFrame:
    """One row per provider and violated check, with share and severity."""
    unique = Check("uniqueness", "+".join(UNIQUE_KEY), "unique_key", F.lit(False))
    entries = []
    for check, count in [(unique, F.col("repeated"))] + [
        (c, F.col(f"c{i}")) for i, c in enumerate(rules)
    ]:
        entries.append(
            F.struct(
                F.lit(check.dimension).alias("dimension"),
                F.lit(check.field).alias("field_name"),
                F.lit(check.rule).alias("rule_name"),
                count.cast("bigint").alias("affected_rows"),
                F.lit(check.severity).cast("string").alias("fixed_severity"),
            )
        )
    long = totals.select(
        F.col("Prscrbr_NPI").alias("npi"), "total_records", F.explode(F.array(*entries)).alias("f")
    ).select("npi", "total_records", "f.*")
    pct = half_even(F.col("affected_rows") / F.col("total_records") * 100, 2)
    return (
        long.filter("affected_rows > 0")
        .withColumn("affected_pct", pct)
        .withColumn("severity", F.coalesce("fixed_severity", severity_from_pct("affected_pct")))
        .drop("fixed_severity", "total_records")
    )


def dimension_scores(totals: DataFrame, found: DataFrame) -> DataFrame:
    """Eight rows per provider: 10 minus the penalties of the dimension's findings."""
    penalty = F.lit(0.0)
    for level, factor in SEVERITY_PENALTY.items():
        penalty = F.when(F.col("severity") == level, factor).otherwise(penalty)
    lost = penalty * clip("affected_pct", 0.0, 100.0) / 100 * 10
    per_dimension = found.groupBy("npi", "dimension").agg(
        F.sum(lost).alias("lost"), F.count(F.lit(1)).alias("findings_count")
    )
    weights = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight"))
            for d, w in DIMENSION_WEIGHTS.items()
        ]
    )
    grid = totals.select(F.col("Prscrbr_NPI").alias("npi"), F.explode(weights).alias("w")).select(
        "npi", "w.*"
    )
    rows = grid.join(per_dimension, ["npi", "dimension"], "left")
    score = half_even(clip(10.0 - F.coalesce("lost", F.lit(0.0)), 0.0, 10.0), 4)
    return rows.select(
        "npi",
        "dimension",
        "weight",
        score.alias("score"),
        half_even(score * F.col("weight"), 4).alias("weighted_contribution"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
    )


def provider_summary(totals: DataFrame, found: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per provider: totals, ratios, score, status and finding counts."""
    quality = scores.groupBy("npi").agg(
        half_even(F.sum(F.col("score") * F.col("weight")), 4).alias("quality_score")
    )

    def having(level):
        return F.count(F.when(F.col("severity") == level, 1)).alias(f"{level}_count")

    levels = [having(s) for s in SEVERITY_PENALTY]
    counts = found.groupBy("npi").agg(*levels)
    ratios = {
        "cost_per_claim": ("total_drug_cost", "total_claims"),
        "claims_per_beneficiary": ("total_claims", "total_beneficiaries"),
        "fills_per_claim": ("total_fills", "total_claims"),
        "day_supply_per_claim": ("total_day_supply", "total_claims"),
    }
    base = totals.withColumnRenamed("Prscrbr_NPI", "npi")
    names = [c for c in ATTRIBUTES if c in base.columns]
    rows = base.select(
        "npi",
        *[F.coalesce(c, F.lit("")).alias(c) for c in names],
        "total_records",
        *MEASURES,
        "unique_drugs",
        *[half_even(share_or_zero(a, b, 1.0), 4).alias(n) for n, (a, b) in ratios.items()],
    )
    rows = rows.join(quality, "npi").join(counts, "npi", "left")
    rows = rows.fillna(0, [f"{s}_count" for s in SEVERITY_PENALTY])
    return rows.withColumns(
        {
            "quality_status": QUALITY_STATUS("quality_score"),
            "total_violations": F.col("critical_count") + F.col("high_count") + F.col("warning_count"),
        }
    )


def provider_quality(prescriptions: DataFrame) -> dict[str, DataFrame]:
    """Summary, dimension and evidence tables per provider.

    The totals, a row per provider, are settled, as all three read them.
    """
    totals = settle(provider_totals(prescriptions))
    found = findings(totals, checks(prescriptions))
    scores = dimension_scores(totals, found)
    return {
        "provider_dq_summary": provider_summary(totals, found, scores),
        "provider_dq_dimension": scores,
        "provider_dq_evidence": found,
    }


def row_count_finding(df: DataFrame, expected: int) -> DataFrame:
    """A critical correctness finding when the frame does not have the expected rows."""
    counted = df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)
    return counted.select(
        F.lit("correctness").alias("dimension"),
        F.lit("row_count").alias("field_name"),
        F.lit("actual_row_count_must_match_expected_row_count").alias("rule_name"),
        F.abs(F.col("n") - expected).alias("affected_rows"),
        F.lit("critical").alias("severity"),
    )
