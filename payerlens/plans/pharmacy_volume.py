"""Pharmacy volume risk: annual history, provider peers, drug peers, detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payerlens.functions import messages as M
from payerlens.functions.bands import PERCENTILE_RISK, PHARMACY_RISK_LEVEL, ZSCORE_RISK
from payerlens.functions.clean import drug_key, number_or_zero, share_or_zero, yes_flag
from payerlens.functions.text import fill, fixed, strongest
from payerlens.operators import periods
from payerlens.operators.keyed import first_per_key
from payerlens.operators.quantiles import percent_ranks

# Fixed values.
HISTORY_YEARS = 3
GENERAL_WEIGHTS = {
    "total_claims": 0.35,
    "total_standardized_30_day_fills": 0.35,
    "total_beneficiaries": 0.20,
    "total_prescribers": 0.10,
}
CATEGORY_WEIGHTS = {"antibiotic": 0.30, "antipsychotic": 0.20, "opioid": 0.30, "la_opioid": 0.20}
CATEGORY_COLUMNS = {
    "antibiotic": "total_claims_for_antibiotic_drugs",
    "antipsychotic": "total_claims_for_antipsychotic_drugs_age65plus",
    "opioid": "total_claims_for_opioid_drugs",
    "la_opioid": "total_claims_for_la_opioid_drugs",
}
GENERAL_PART, CATEGORY_PART = 0.85, 0.15
PEER_WEIGHTS = {"claims": 0.40, "fills": 0.30, "day_supply": 0.20, "beneficiary": 0.10}
DRUG_WEIGHTS = {"claims": 0.35, "fills": 0.30, "day_supply": 0.20, "beneficiary": 0.15}
FLAG_WEIGHTS = {
    "opioid": 0.25,
    "la_opioid": 0.15,
    "antibiotic": 0.20,
    "antipsychotic": 0.20,
    "ndc_conflict": 0.20,
}
FLAGS = tuple(FLAG_WEIGHTS)
MEASURES = {
    "total_claims": "Tot_Clms",
    "total_fills": "Tot_30day_Fills",
    "total_day_supply": "Tot_Day_Suply",
    "total_drug_cost": "Tot_Drug_Cst",
    "total_beneficiaries": "Tot_Benes",
}
PERCENTILES = {
    "total_claims": "claims_percentile",
    "total_fills": "fills_percentile",
    "total_day_supply": "day_supply_percentile",
    "total_beneficiaries": "beneficiary_percentile",
}
PROVIDER_KEYS = (
    "Prscrbr_NPI",
    "Prscrbr_Last_Org_Name",
    "Prscrbr_First_Name",
    "Prscrbr_City",
    "Prscrbr_State_Abrvtn",
    "Prscrbr_Type",
)
DRUG_KEYS = ("Brnd_Name", "Gnrc_Name")


def weighted(weights: dict[str, float], column) -> Column:
    """Weighted sum of columns; NULL if any part is NULL."""
    terms = [column(name) * weight for name, weight in weights.items()]
    return sum(terms[1:], terms[0])


def annual_risk(totals: DataFrame, years: int = HISTORY_YEARS) -> DataFrame:
    """Each year's totals against the three years before it.

    One row per year reaches the window, so it needs a single task.
    """
    measures = {m: m for m in GENERAL_WEIGHTS} | CATEGORY_COLUMNS
    present = {
        c: number_or_zero(c) if c in totals.columns else F.lit(0.0) for c in measures.values()
    }
    rows = totals.withColumns(present).withColumn("calendar_year", F.col("calendar_year").try_cast("int"))
    rows = rows.filter(F.col("calendar_year").isNotNull())
    order, stats = "calendar_year", {}
    for name, c in measures.items():
        stats[f"{name}_rolling_mean"] = periods.previous_mean(c, [], order, years)
        stats[f"{name}_rolling_std"] = periods.previous_std(c, [], order, years)
    rows = rows.withColumns(stats)
    z = {
        f"{name}_zscore": F.when(
            F.col(f"{name}_rolling_std") > 0,
            (F.col(c) - F.col(f"{name}_rolling_mean")) / F.col(f"{name}_rolling_std"),
        )
        for name, c in measures.items()
    }
    rows = rows.withColumns(z)
    # Below-baseline scores count as zero, which the lowest band covers anyway.
    rows = rows.withColumns({f"{n}_risk": ZSCORE_RISK(f"{n}_zscore") for n in measures})

    def risk(name):
        return F.col(f"{name}_risk")

    general = weighted(GENERAL_WEIGHTS, risk)
    category = weighted(CATEGORY_WEIGHTS, risk)
    rows = rows.withColumns(
        {"volume_risk_score": general, "high_risk_drug_volume_score": category}
    ).withColumn(
        "final_volume_risk_score",
        GENERAL_PART * F.col("volume_risk_score") + CATEGORY_PART * F.col("high_risk_drug_volume_score"),
    )
    known = F.col("volume_risk_score").isNotNull()
    previous = Window.orderBy(order)
    yoy = {
        f"{m}_yoy_change_pct": F.try_divide(F.col(m), F.lag(m).over(previous)) * 100 - 100
        for m in GENERAL_WEIGHTS
    }
    rows = rows.withColumns(
        {
            "volume_risk_level": PHARMACY_RISK_LEVEL("final_volume_risk_score"),
            "baseline_type": F.when(known, "3-year rolling historical baseline").otherwise(
                "Insufficient historical data"
            ),
            "baseline_years_used": F.when(known, years).otherwise(0),
            **yoy,
        }
    )
    return rows.withColumns(_annual_text())


def _annual_text() -> dict[str, Column]:
    text, score = M.OVERALL_TEXT, F.col("final_volume_risk_score")
    top = F.get(strongest([(n, F.col(c)) for n, c in M.OVERALL_DRIVERS]), F.lit(0))
    value = top["value"]
    return {
        "root_cause": F.when(score.isNull(), text["missing_cause"])
        .when(value >= 70, fill(text["high"], top["name"], fixed(value, 0)))
        .when(value >= 40, fill(text["medium"], top["name"], fixed(value, 0)))
        .otherwise(text["none"]),
        "recommendation": _action(score, text),
    }


def _action(score: Column, text: dict[str, str]) -> Column:
    return (
        F.when(score.isNull(), text["missing_action"])
        .when(score >= 75, text["act_75"])
        .when(score >= 50, text["act_50"])
        .otherwise(text["act"])
    )


def _peer_text(text: dict[str, str]) -> dict[str, Column]:
    top = F.get(strongest([(n, F.col(c)) for n, c in M.PEER_DRIVERS]), F.lit(0))
    value, score = top["value"], F.col("volume_risk_score")
    shown = fixed(value, 2)
    return {
        "root_cause": F.when(score.isNull(), text["missing_cause"])
        .when(value >= 95, fill(text["p95"], top["name"], shown))
        .when(value >= 90, fill(text["p90"], top["name"], shown))
        .when(value >= 75, fill(text["p75"], top["name"], shown))
        .otherwise(text["none"]),
        "recommendation": _action(score, text),
    }


def flagged_prescriptions(prescriptions: DataFrame, drug_list: DataFrame) -> DataFrame:
    """Prescriber-drug rows with 0/1 drug flags and flagged claim counts.

    The drug list holds one row per brand after the pick, a few hundred in
    practice; Spark broadcasts it when its size allows and shuffles otherwise.
    """
    flags = [f"{f}_flag" for f in FLAGS]
    names = drug_list.select(drug_key("drug_name").alias("drug_join_name"), "generic_name", *flags)
    names = first_per_key(
        names.filter("drug_join_name <> ''"), ["drug_join_name"], ["generic_name"]
    ).drop("generic_name")
    rows = prescriptions.withColumns({c: number_or_zero(c) for c in MEASURES.values()}).withColumns(
        {
            "Prscrbr_NPI": F.trim(F.col("Prscrbr_NPI").cast("string")),
            "drug_join_name": drug_key("Brnd_Name"),
        }
    )
    rows = rows.join(names, "drug_join_name", "left").withColumns({f: yes_flag(f) for f in flags})
    return rows.withColumns(
        {f"{f}_claims": F.col("Tot_Clms") * F.col(f"{f}_flag") for f in FLAGS}
    )


def _rollup(rows: DataFrame, keys: Sequence[str], extra: list[Column]) -> DataFrame:
    sums = [F.sum(c).alias(name) for name, c in MEASURES.items()]
    return rows.groupBy(*keys).agg(*sums, *extra)


def provider_rollup(rows: DataFrame) -> DataFrame:
    """Totals and flagged-claim shares per provider identity; NULL parts are kept."""
    flagged = [F.sum(f"{f}_claims").alias(f"{f}_claims") for f in FLAGS]
    return _rollup(rows, PROVIDER_KEYS, flagged).withColumns(
        {f"{f}_claim_share_pct": share_or_zero(f"{f}_claims", "total_claims") for f in FLAGS}
    )


def drug_rollup(rows: DataFrame) -> DataFrame:
    flags = [F.max(f"{f}_flag").alias(f"{f}_flag") for f in FLAGS]
    return _rollup(rows, DRUG_KEYS, flags)


def provider_peer_risk(rows: DataFrame) -> DataFrame:
    """Provider volume and flagged-drug use against all providers."""
    shares = {f"{f}_claim_share_pct": f"__{f}_rank" for f in FLAGS}
    ranked = percent_ranks(provider_rollup(rows), PERCENTILES | shares)
    ranked = ranked.withColumns(
        {f"{n}_volume_risk": PERCENTILE_RISK(f"{n}_percentile") for n in PEER_WEIGHTS}
    )
    scored = ranked.withColumns(
        {
            "volume_risk_score": weighted(PEER_WEIGHTS, lambda n: F.col(f"{n}_volume_risk")),
            "high_risk_drug_utilization_score": weighted(
                FLAG_WEIGHTS, lambda f: F.col(f"__{f}_rank")
            ),
        }
    ).drop(*shares.values())
    return scored.withColumns(
        {
            "volume_risk_level": PHARMACY_RISK_LEVEL("volume_risk_score"),
            "baseline_type": F.lit("Current peer baseline"),
            "historical_baseline_available": F.lit(0),
            **_peer_text(M.NPI_TEXT),
        }
    )


def drug_peer_risk(rows: DataFrame) -> DataFrame:
    """Drug volume against all drugs, on raw percentiles."""
    ranked = percent_ranks(drug_rollup(rows), PERCENTILES)
    flag_count = sum((F.col(f"{f}_flag") for f in FLAGS[1:]), F.col(f"{FLAGS[0]}_flag"))
    scored = ranked.withColumns(
        {
            "volume_risk_score": weighted(DRUG_WEIGHTS, lambda n: F.col(f"{n}_percentile")),
            "high_risk_flag_count": flag_count,
        }
    )
    return scored.withColumns(
        {
            "volume_risk_level": PHARMACY_RISK_LEVEL("volume_risk_score"),
            "baseline_type": F.lit("Current drug peer baseline"),
            "historical_baseline_available": F.lit(0),
            **_peer_text(M.DRUG_TEXT),
        }
    )


def provider_drug_detail(rows: DataFrame) -> DataFrame:
    """Every prescriber-drug row with flags and a short explanation."""
    some = F.coalesce(F.col("Tot_Clms") > 0, F.lit(False))
    text = M.DETAIL_TEXT
    return rows.select(
        *PROVIDER_KEYS,
        *DRUG_KEYS,
        *MEASURES.values(),
        *[f"{f}_flag" for f in FLAGS],
        *[f"{f}_claims" for f in FLAGS],
        F.when(some, text["cause"]).otherwise(text["none_cause"]).alias("root_cause"),
        F.when(some, text["action"]).otherwise(text["none_action"]).alias("recommendation"),
    )


def pharmacy_volume(
    totals: DataFrame, prescriptions: DataFrame, drug_list: DataFrame
) -> dict[str, DataFrame]:
    rows = flagged_prescriptions(prescriptions, drug_list)
    return {
        "pharmacy_overall_volume_risk": annual_risk(totals),
        "pharmacy_npi_volume_risk": provider_peer_risk(rows),
        "pharmacy_drug_volume_risk": drug_peer_risk(rows),
        "pharmacy_npi_drug_detail": provider_drug_detail(rows),
    }
