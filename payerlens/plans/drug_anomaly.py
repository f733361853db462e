"""Drug anomalies: provider-drug rows against generic peers, mix drift, yearly totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payerlens.functions.bands import DRUG_SEVERITY, YEARLY_SEVERITY
from payerlens.functions.clean import NULL_TOKENS_ANY_CASE, code_key, non_negative, null_tokens, number, ratio
from payerlens.functions.text import fill, fixed
from payerlens.operators.contracts import existing, require_columns, resolve_columns
from payerlens.operators.drift import population_psi
from payerlens.operators.keyed import first_per_key
from payerlens.operators.quantiles import robust_z
from payerlens.operators.stages import settle

# Fixed values.
Z_LIMIT = 3.5
PSI_LIMIT = 0.25
MIN_GROUP = 5
MIN_ABNORMAL = 2
MIN_YEARS = 5
REQUIRED = (
    "Prscrbr_NPI",
    "Prscrbr_City",
    "Prscrbr_State_Abrvtn",
    "Prscrbr_Type",
    "Brnd_Name",
    "Gnrc_Name",
    "Tot_Clms",
    "Tot_30day_Fills",
    "Tot_Day_Suply",
    "Tot_Drug_Cst",
    "Tot_Benes",
)
FEATURES = {
    "Tot_Clms": "Total claims",
    "Tot_30day_Fills": "30-day fills",
    "Tot_Day_Suply": "Days supplied",
    "Tot_Benes": "Beneficiaries",
    "Tot_Drug_Cst": "Total drug cost",
    "Cost_Per_Claim": "Cost per claim",
    "Claims_Per_Beneficiary": "Claims per beneficiary",
    "DaySupply_Per_Claim": "Days supply per claim",
    "Cost_Per_Beneficiary": "Cost per beneficiary",
}
DRUG_LIST_COLUMNS = (
    "Drug Name",
    "Generic Name",
    "Opioid Flag",
    "LA Opioid Flag",
    "Antibiotic Flag",
    "Antipsychotic Flag",
    "NDC Conflict Flag",
)
POPULATION_BASELINE = "Current overall provider population"
MIXES = {
    "specialty_psi": (
        "Prscrbr_Type",
        "Provider Specialty Distribution",
        "Provider specialty distribution differs from the overall provider baseline: PSI={}; baseline=" + POPULATION_BASELINE,
    ),
    "state_psi": (
        "Prscrbr_State_Abrvtn",
        "Geographic State Distribution",
        "Geographic/state distribution differs from the overall provider baseline: PSI={}; baseline=" + POPULATION_BASELINE,
    ),
}
YEARLY_FEATURES = {
    "total_claims": "Total Claims",
    "total_standardized_30_day_fills": "Total Standardized 30-Day Fills",
    "total_drug_cost": "Total Drug Cost",
    "total_beneficiaries": "Total Beneficiaries",
    "total_prescribers": "Total Prescribers",
    "total_claims_for_brand_drugs": "Total Claims for Brand Drugs",
    "total_drug_cost_for_brand_drugs": "Total Drug Cost for Brand Drugs",
    "total_claims_for_generic_drugs": "Total Claims for Generic Drugs",
    "total_drug_cost_for_generic_drugs": "Total Drug Cost for Generic Drugs",
    "total_claims_for_other_drugs": "Total Claims for Other Drugs",
    "total_drug_cost_for_other_drugs": "Total Drug Cost for Other Drugs",
    "total_claims_for_antibiotic_drugs": "Total Claims for Antibiotic Drugs",
    "total_drug_cost_for_antibiotic_drugs": "Total Drug Cost for Antibiotic Drugs",
    "total_beneficiaries_for_antibiotic_drugs": "Total Beneficiaries for Antibiotic Drugs",
    "total_claims_for_antipsychotic_drugs_age65plus": "Total Claims for Antipsychotic Drugs (Age 65+)",
    "total_drug_cost_for_antipsychotic_drugs_age65plus": "Total Drug Cost for Antipsychotic Drugs  (Age 65+)",
    "total_beneficiaries_for_antipsychotic_drugs_age65plus": "Total Beneficiaries for Antipsychotic Drugs  (Age 65+)",
    "total_claims_for_opioid_drugs": "Total Claims for Opioid Drugs",
    "total_drug_cost_for_opioid_drugs": "Total Drug Cost  for Opioid Drugs",
    "total_beneficiaries_for_opioid_drugs": "Total Beneficiaries for Opioid Drugs",
    "total_claims_for_la_opioid_drugs": "Total Claims for LA Opioid Drugs",
    "total_drug_cost_for_la_opioid_drugs": "Total Drug Cost  for LA Opioid Drugs",
    "total_beneficiaries_for_la_opioid_drugs": "Total Beneficiaries for LA Opioid Drugs",
}
ALL_DRUGS = "ALL_DRUGS_YEARLY"


def measured(prescriptions: DataFrame) -> DataFrame:
    """Rows with a provider and generic name, clean measures and the four ratios."""
    df = require_columns(prescriptions, REQUIRED).dropna(subset=["Prscrbr_NPI", "Gnrc_Name"])
    raw = ("Tot_Clms", "Tot_30day_Fills", "Tot_Day_Suply", "Tot_Drug_Cst", "Tot_Benes")
    df = df.withColumns({c: non_negative(number(c)) for c in raw})
    return df.withColumns(
        {
            "Cost_Per_Claim": ratio("Tot_Drug_Cst", "Tot_Clms"),
            "Claims_Per_Beneficiary": ratio("Tot_Clms", "Tot_Benes"),
            "DaySupply_Per_Claim": ratio("Tot_Day_Suply", "Tot_Clms"),
            "Cost_Per_Beneficiary": ratio("Tot_Drug_Cst", "Tot_Benes"),
        }
    )


def classified(rows: DataFrame, drug_list: DataFrame) -> DataFrame:
    """Rows with the drug-list entry of their generic name, the first entry per name."""
    listed = resolve_columns(drug_list, DRUG_LIST_COLUMNS).select(
        *[null_tokens(c, NULL_TOKENS_ANY_CASE, any_case=True).alias(c) for c in DRUG_LIST_COLUMNS]
    )
    listed = listed.withColumn("__key", code_key("Generic Name")).filter("__key is not null")
    lookup = first_per_key(listed, ["__key"], ["Drug Name"])
    return (
        rows.withColumn("__key", code_key("Gnrc_Name")).join(lookup, "__key", "left").drop("__key")
    )


def scored(rows: DataFrame) -> DataFrame:
    """Robust Z of every feature among rows of the same generic, and the drug's mix drift.

    The rows are settled once for all three; the drifts are a row per drug, whose settled size
    tells the join whether they can be broadcast.
    """
    rows = settle(rows)
    out = robust_z(
        rows, ["Gnrc_Name"], list(FEATURES), MIN_GROUP, count_missing=True, keep_stats=True, settled=True
    )
    for name, (column, _, _) in MIXES.items():
        mix = settle(population_psi(rows, "Gnrc_Name", column).withColumnRenamed("psi", name))
        out = out.join(mix, "Gnrc_Name", "left")
    return out


def _peer_count(f: str):
    known = (F.col(f"{f}_peer_count") >= MIN_GROUP) & (F.col(f"{f}_peer_mad") > 0)
    return F.when(known, F.col(f"{f}_peer_count")).otherwise(0)


def _signal(f: str, label: str):
    """What a feature's reason text needs, as one struct."""
    return F.struct(
        F.lit(label).alias("label"),
        F.col(f).cast("double").alias("actual"),
        F.col(f"{f}_peer_median").cast("double").alias("median"),
        _peer_count(f).cast("bigint").alias("n"),
        F.col(f"{f}_z").alias("z"),
    )


def _reason(s):
    direction = F.when(s["z"] > 0, "HIGH").otherwise("LOW")
    full = fill(
        "{} is unusually {}: provider={}, peer median={}, peer count={}, Robust Z={}",
        s["label"],
        direction,
        fixed(s["actual"], 2),
        fixed(s["median"], 2),
        s["n"],
        fixed(s["z"], 2),
    )
    short = fill(
        "{} is unusually {}: provider={}, Robust Z={}",
        s["label"],
        direction,
        fixed(s["actual"], 2),
        fixed(s["z"], 2),
    )
    return F.when(s["n"] > 0, full).otherwise(short)


def _row_id():
    return F.xxhash64("Prscrbr_NPI", "Brnd_Name", "Gnrc_Name")


def with_signals(rows: DataFrame) -> DataFrame:
    """Scored rows with their peaks and numbers of signals, as plain columns, which are compiled."""
    drifts = {n: F.coalesce(F.col(n) >= PSI_LIMIT, F.lit(False)) for n in MIXES}
    abnormal = [F.coalesce(F.abs(F.col(f"{f}_z")) >= Z_LIMIT, F.lit(False)).cast("int") for f in FEATURES]
    rows = rows.withColumns(
        {
            "abnormal": reduce(lambda a, b: a + b, abnormal),
            "max_z": F.greatest(*[F.abs(F.col(f"{f}_z")) for f in FEATURES]),
            "max_psi": F.greatest(*MIXES),
            **{f"{n}_anomaly": hit.cast("int") for n, hit in drifts.items()},
        }
    )
    drifting = F.col("specialty_psi_anomaly") + F.col("state_psi_anomaly")
    return rows.withColumn("anomaly_count", F.col("abnormal") + drifting)


def explained(rows: DataFrame) -> DataFrame:
    """Rows with signals and their reason: one array of structs, so each text is built in one place."""
    texts = [
        F.when(F.col(f"{n}_anomaly") == 1, fill(text, fixed(n, 4))) for n, (_, _, text) in MIXES.items()
    ]
    signals = F.array(*[_signal(f, label) for f, label in FEATURES.items()])
    hits = F.filter(signals, lambda s: F.coalesce(F.abs(s["z"]) >= Z_LIMIT, F.lit(False)))
    reasons = F.concat(F.transform(hits, _reason), F.array_compact(F.array(*texts)))
    return rows.withColumn("reason", F.array_join(reasons, "; "))


def drug_anomaly_rows(rows: DataFrame) -> DataFrame:
    """Rows with at least one signal, which are settled, as their texts name each score several times."""
    return explained(settle(rows.filter("anomaly_count > 0"))).select(
        _row_id().alias("anomaly_id"),
        F.col("Prscrbr_NPI").cast("string").alias("provider_id"),
        F.col("Gnrc_Name").cast("string").alias("drug"),
        F.col("max_z").alias("robust_z_score"),
        (F.col("abnormal") >= MIN_ABNORMAL).cast("int").alias("robust_z_anomaly"),
        F.col("max_psi").alias("psi_score"),
        F.greatest("specialty_psi_anomaly", "state_psi_anomaly").alias("psi_anomaly"),
        "anomaly_count",
        DRUG_SEVERITY("anomaly_count").alias("severity"),
        F.col("reason").alias("anomaly_reason"),
    )


def drug_metric_rows(rows: DataFrame) -> DataFrame:
    """Nine feature rows per provider-drug row and one per known mix drift."""
    entries = []
    for f in FEATURES:
        z, n = F.col(f"{f}_z"), _peer_count(f)
        told = F.when(
            n > 0,
            fill(
                "Generic drug peer group={}; peer_count={}; method=median/MAD grouped by Gnrc_Name",
                F.col("Gnrc_Name"),
                n,
            ),
        ).otherwise(
            fill(
                "Generic drug peer group={}; peer_count=0; Robust Z unavailable because peer group has fewer than 5 valid observations or MAD=0",
                F.col("Gnrc_Name"),
            )
        )
        hit = F.coalesce(F.abs(z) >= Z_LIMIT, F.lit(False)).cast("int")
        entries.append(_entry(f, "ROBUST_Z", F.col(f), z, Z_LIMIT, hit, "Gnrc_Name", told))
    for name, (column, label, _) in MIXES.items():
        nothing = F.lit(None)
        row = _entry(
            label, "PSI", nothing, F.col(name), PSI_LIMIT, F.col(f"{name}_anomaly"), column,
            F.lit(POPULATION_BASELINE),
        )
        entries.append(F.when(F.col(name).isNotNull(), row))
    listed = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return rows.select(
        F.when(F.col("anomaly_count") > 0, _row_id()).alias("anomaly_id"),
        F.col("Prscrbr_NPI").cast("string").alias("provider_id"),
        F.col("Gnrc_Name").cast("string").alias("drug"),
        F.explode(listed).alias("m"),
    ).select("anomaly_id", "provider_id", "drug", "m.*")


def _entry(name, kind, actual, score, limit, hit, peers, baseline):
    return F.struct(
        F.lit(name).alias("metric_name"),
        F.lit(kind).alias("metric_type"),
        actual.cast("double").alias("actual_value"),
        score.cast("double").alias("score"),
        F.lit(limit).cast("double").alias("threshold"),
        hit.cast("int").alias("is_anomalous"),
        F.lit(peers).alias("peer_group"),
        baseline.alias("baseline_periods"),
    )


def yearly_scores(totals: DataFrame) -> DataFrame:
    """(year, column, label, value, z) of every annual measure over its whole history.

    Display names are matched to the stored column names first.
    """
    year = next(c for c in totals.columns if c.lower().replace(" ", "_") in ("calendar_year", "year"))
    named = totals.withColumnRenamed(year, "calendar_year")
    columns = existing(named, list(YEARLY_FEATURES))
    entries = [
        F.struct(
            F.lit(c).alias("metric"),
            F.lit(YEARLY_FEATURES[c]).alias("label"),
            number(c).alias("value"),
        )
        for c in columns
    ]
    long = named.select(
        F.col("calendar_year").cast("int").alias("year"), F.explode(F.array(*entries)).alias("m")
    ).select("year", "m.*")
    return robust_z(long, ["metric"], ["value"], MIN_YEARS).withColumnRenamed("value_z", "z")


def yearly_anomaly_rows(scores: DataFrame) -> DataFrame:
    z = F.col("z")
    reason = fill(
        "{} is unusually {}: year={}, value={}, Robust Z={}",
        F.col("label"),
        F.when(z > 0, "HIGH").otherwise("LOW"),
        F.col("year"),
        fixed("value", 2),
        fixed(z, 2),
    )
    return scores.filter(F.abs(z) >= Z_LIMIT).select(
        F.xxhash64("metric", "year").alias("anomaly_id"),
        F.lit(None).cast("string").alias("provider_id"),
        F.lit(ALL_DRUGS).alias("drug"),
        F.abs(z).alias("robust_z_score"),
        F.lit(1).alias("robust_z_anomaly"),
        F.lit(None).cast("double").alias("psi_score"),
        F.lit(0).alias("psi_anomaly"),
        F.lit(1).alias("anomaly_count"),
        YEARLY_SEVERITY(F.abs(z)).alias("severity"),
        reason.alias("anomaly_reason"),
    )


def yearly_metric_rows(scores: DataFrame) -> DataFrame:
    """Metric rows of the yearly anomalies; the history holds one row per year."""
    years = scores.agg(F.sort_array(F.collect_set("year")).alias("y"))
    text = years.select(
        F.concat(
            F.lit("part_d_grand_totals historical yearly values; years="),
            F.array_join("y", ","),
        )
    ).scalar()
    return scores.filter(F.abs(F.col("z")) >= Z_LIMIT).select(
        F.xxhash64("metric", "year").alias("anomaly_id"),
        F.lit(None).cast("string").alias("provider_id"),
        F.lit(ALL_DRUGS).alias("drug"),
        F.col("label").alias("metric_name"),
        F.lit("ROBUST_Z").alias("metric_type"),
        F.col("value").alias("actual_value"),
        F.col("z").alias("score"),
        F.lit(Z_LIMIT).alias("threshold"),
        F.lit(1).alias("is_anomalous"),
        F.lit("Calendar Year").alias("peer_group"),
        text.alias("baseline_periods"),
    )


def drug_anomalies(
    prescriptions: DataFrame, drug_list: DataFrame, totals: DataFrame
) -> dict[str, DataFrame]:
    """Both drug anomaly tables and the classified provider-drug rows."""
    base = measured(prescriptions)
    rows = with_signals(scored(base))
    yearly = yearly_scores(totals)
    return {
        "drug_anomalies": drug_anomaly_rows(rows).unionByName(yearly_anomaly_rows(yearly)),
        "drug_individual_metrics": drug_metric_rows(rows).unionByName(yearly_metric_rows(yearly)),
        "classified": classified(base, drug_list),
    }


def most_severe(anomalies: DataFrame, n: int) -> DataFrame:
    """HIGH before MEDIUM before LOW, then most signals, then strongest score."""
    rank = (
        F.when(F.col("severity") == "HIGH", 1)
        .when(F.col("severity") == "MEDIUM", 2)
        .when(F.col("severity") == "LOW", 3)
        .otherwise(4)
    )
    order = [rank, F.desc("anomaly_count"), F.desc_nulls_last("robust_z_score"), "anomaly_id"]
    return anomalies.orderBy(*order).limit(n)
