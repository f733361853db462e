"""Composite provider risk for claims and for pharmacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payerlens.functions import messages as M
from payerlens.functions.bands import CLAIM_RISK_LEVEL, PROVIDER_RISK_LEVEL, PSI_STATUS
from payerlens.functions.clean import brand_generic_key, clip, half_even, npi, number
from payerlens.functions.text import fill, names_at_least, strongest
from payerlens.operators.drift import bin_weights, weighted_psi
from payerlens.operators.keyed import first_per_key, latest_per_key
from payerlens.operators.quantiles import exact_median
from payerlens.operators.stages import settle

# Fixed values.
CLAIM_WEIGHTS = {"dq": 0.25, "volume": 0.20, "robust_z": 0.20, "psi": 0.15, "arrival_delay": 0.20}
PHARMACY_WEIGHTS = {
    "DQ_Risk": 0.285714,
    "Volume_Risk": 0.214286,
    "RobustZ_Risk": 0.214286,
    "PSI_Risk": 0.142857,
    "ArrivalDelay_Risk": 0.142857,
}
ARRIVAL_DELAY = 0.20
ROBUST_Z_FULL = 7.0
PSI_FULL = 0.5
ROBUST_Z_CAP = 3.5
PSI_EDGES = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100.000001)
ROBUST_METRICS = (
    "total_claims",
    "total_fills",
    "total_day_supply",
    "total_beneficiaries",
    "total_drug_cost",
)


def check_weights(weights: dict[str, float], tolerance: float = 1e-5) -> None:
    if abs(sum(weights.values()) - 1.0) > tolerance:
        raise ValueError(f"risk weights must sum to 1, not {sum(weights.values())}")


def _unit(c: Column) -> Column:
    """Clipped to [0, 1], 0 when unknown."""
    return F.coalesce(clip(c, 0.0, 1.0), F.lit(0.0))


def quality_risk(run_table: DataFrame) -> DataFrame:
    """Mean completeness and dimension score per provider and the risk they imply."""
    scores = ("npi_completeness_score", "npi_dimension_score")
    rows = run_table.filter(F.col("npi").isNotNull()).groupBy(npi("npi").alias("NPI")).agg(
        *[F.avg(number(c)).alias(c) for c in scores]
    )
    # Row mean over the scores that exist.
    known = sum((F.col(c).isNotNull().cast("int") for c in scores[1:]), F.col(scores[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in scores[1:]), F.coalesce(scores[0], F.lit(0.0)))
    rows = rows.withColumn("dq_quality_score", total / F.nullif(known, F.lit(0)))
    return rows.withColumn("dq_risk", clip(1.0 - F.col("dq_quality_score") / 100.0, 0.0, 1.0))


def anomaly_peaks(anomalies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Largest absolute Z per provider and month, largest PSI per month."""
    month = F.trim(F.col("batch_month").cast("string"))
    z = F.abs(number("robust_z_score"))
    by_provider = (
        anomalies.select(npi("provider_id").alias("NPI"), month.alias("current_period"), z.alias("z"))
        .filter("NPI is not null and z is not null")
        .groupBy("NPI", "current_period")
        .agg(F.max("z").alias("robust_z_max"))
        .withColumns(
            {
                "robust_z_risk": clip(F.col("robust_z_max") / ROBUST_Z_FULL, 0.0, 1.0),
                "robust_z_status": F.when(F.col("robust_z_max") >= 3.5, "ANOMALOUS").otherwise("NORMAL"),
            }
        )
    )
    by_month = (
        anomalies.select(month.alias("current_period"), number("psi_score").alias("psi_score"))
        .filter("psi_score is not null")
        .groupBy("current_period")
        .agg(F.max("psi_score").alias("psi_score"))
        .withColumn("psi_risk", clip(F.col("psi_score") / PSI_FULL, 0.0, 1.0))
    )
    return by_provider, by_month


def claim_provider_risk(
    volume_risk: DataFrame,
    run_table: DataFrame,
    anomalies: DataFrame,
    arrival_delay: Column | float = ARRIVAL_DELAY,
) -> DataFrame:
    """Weighted SLA risk of each provider's latest month with level and explanation.

    The merged Z and PSI scores of that month count; missing parts count as 0.
    """
    check_weights(CLAIM_WEIGHTS)
    latest = latest_per_key(
        volume_risk.withColumn("NPI", npi("NPI")),
        ["NPI"],
        [F.to_date(F.concat(F.col("current_period"), F.lit("-01")))],
    )
    z, psi = anomaly_peaks(anomalies)
    rows = (
        latest.join(quality_risk(run_table), "NPI", "left")
        .join(z, ["NPI", "current_period"], "left")
        .join(psi, "current_period", "left")
    )
    delay = arrival_delay if isinstance(arrival_delay, Column) else F.lit(arrival_delay)
    parts = {f"{n}_risk": _unit(F.col(f"{n}_risk")) for n in ("dq", "volume", "robust_z", "psi")}
    rows = rows.withColumns(
        parts
        | {
            "arrival_delay_risk": _unit(delay),
            "robust_z_status": F.coalesce("robust_z_status", F.lit("NO_DATA")),
            "psi_status": PSI_STATUS("psi_score"),
        }
    )
    weighted = {f"weighted_{n}_risk": F.col(f"{n}_risk") * w for n, w in CLAIM_WEIGHTS.items()}
    rows = rows.withColumns(weighted)
    total = sum((F.col(c) for c in list(weighted)[1:]), F.col(next(iter(weighted))))
    rows = rows.withColumn("final_sla_risk_score", half_even(clip(total, 0.0, 1.0), 6))
    ranked = strongest([(name, F.col(c)) for name, c in M.CLAIM_RISK_DRIVERS])
    drivers = names_at_least([(n, F.col(c)) for n, c in M.CLAIM_RISK_COMPONENTS], 0.5)
    score, text = F.col("final_sla_risk_score"), M.CLAIM_RISK_TEXT
    return rows.withColumns(
        {
            "final_risk_level": CLAIM_RISK_LEVEL("final_sla_risk_score"),
            "root_cause": fill(
                text["cause"], F.get(ranked, F.lit(0))["name"], F.get(ranked, F.lit(1))["name"]
            ),
            "recommendation": F.when(score.isNull(), text["missing"])
            .when(drivers == "", text["no_driver"])
            .when(score >= 0.75, fill(text["act_75"], drivers))
            .when(score >= 0.5, fill(text["act_50"], drivers))
            .when(score >= 0.25, fill(text["act_25"], drivers))
            .otherwise(text["act"]),
        }
    )


# -- pharmacy -----------------------------------------------------------------


def latest_run(summary: DataFrame, *ties: str) -> DataFrame:
    """Rows of the run that wrote the newest row."""
    order = F.struct("created_at", *ties)
    newest = summary.agg(F.max_by("run_id", order)).scalar()
    return summary.filter(F.col("run_id") == newest)


def global_robust_z(df: DataFrame, columns) -> DataFrame:
    """Robust Z over the whole frame; by standard deviation where the MAD is 0, else 0.

    The frame is settled; its statistics are single rows, which are broadcast.
    """
    columns = list(columns)
    rows = settle(df.withColumn("__g", F.lit(0)))
    spread = rows.groupBy("__g").agg(
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std") for c in columns]
    )
    stats = settle(exact_median(rows, ["__g"], columns, "__med").join(spread, "__g"))
    centred = rows.join(F.broadcast(stats), "__g").withColumns(
        {f"{c}__dev": F.abs(F.col(c).cast("double") - F.col(f"{c}__med")) for c in columns}
    )
    mads = settle(exact_median(centred, ["__g"], [f"{c}__dev" for c in columns], "_mad"))
    scores = {}
    for c in columns:
        mad, std = F.col(f"{c}__dev_mad"), F.col(f"{c}__std")
        off = F.col(c).cast("double") - F.col(f"{c}__med")
        scores[f"{c}_robust_z"] = (
            F.when(mad > 0, 0.6745 * off / mad).when(std > 0, off / std).otherwise(0.0)
        )
    scored = centred.join(F.broadcast(mads), "__g").withColumns(scores)
    return scored.select(*df.columns, *scores)


def positive_z_risk(z: Column) -> Column:
    return clip(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(0.0)) / ROBUST_Z_CAP, 0.0, 1.0)


def psi_risk(psi: Column) -> Column:
    return clip(1.0 - F.exp(-F.greatest(psi, F.lit(0.0))), 0.0, 1.0)


def drug_mix_psi(detail: DataFrame, drug_risk: DataFrame) -> DataFrame:
    """PSI of each provider's claims over drug-risk bins against all drugs."""
    pair = ("Brnd_Name", "Gnrc_Name")
    drugs = drug_risk.select(
        brand_generic_key(*pair).alias("drug_key"),
        number("total_claims").alias("total_claims"),
        number("volume_risk_score").alias("score"),
    )
    baseline = drugs.groupBy(F.lit(0).alias("__g")).agg(
        bin_weights(F.col("score"), F.col("total_claims"), PSI_EDGES).alias("base")
    )
    lookup = first_per_key(drugs, ["drug_key"], ["score"]).select("drug_key", "score")
    rows = detail.select(
        F.col("Prscrbr_NPI").cast("string").alias("npi"),
        brand_generic_key(*pair).alias("drug_key"),
        number("Tot_Clms").alias("claims"),
    ).join(lookup, "drug_key", "left")
    binned = rows.groupBy("npi").agg(
        bin_weights(F.col("score"), F.col("claims"), PSI_EDGES).alias("current")
    )
    # The baseline is a single row.
    both = binned.withColumn("__g", F.lit(0)).join(F.broadcast(baseline), "__g")
    return (
        weighted_psi(both, "base", "current", "PSI")
        .select("npi", "PSI")
        .withColumn("PSI_Risk", psi_risk(F.col("PSI")))
    )


def pharmacy_provider_risk(
    quality: DataFrame,
    volume: DataFrame,
    detail: DataFrame,
    drug_risk: DataFrame,
    arrival_delay: Column | float = ARRIVAL_DELAY,
) -> DataFrame:
    """Weighted risk of each provider from quality, volume, Z and drug mix.

    ``quality`` holds one row per provider of the chosen run.
    """
    check_weights(PHARMACY_WEIGHTS)
    dq = quality.select(
        F.col("npi").cast("string").alias("npi"),
        "quality_score",
        "quality_status",
        (1.0 - F.coalesce(clip(number("quality_score"), 0.0, 10.0), F.lit(0.0)) / 10.0).alias("DQ_Risk"),
    )
    z = global_robust_z(
        volume.withColumn("npi", F.col("Prscrbr_NPI").cast("string")).select(
            "npi",
            "Prscrbr_Last_Org_Name",
            "Prscrbr_First_Name",
            "Prscrbr_City",
            "Prscrbr_State_Abrvtn",
            "Prscrbr_Type",
            "volume_risk_score",
            "volume_risk_level",
            *ROBUST_METRICS,
        ),
        ROBUST_METRICS,
    )
    peak = F.greatest(*[positive_z_risk(F.col(f"{m}_robust_z")) for m in ROBUST_METRICS])
    rows = z.withColumns(
        {
            "RobustZ_Risk": peak,
            "Volume_Risk": F.coalesce(clip(number("volume_risk_score"), 0.0, 100.0), F.lit(0.0)) / 100.0,
        }
    ).drop(*ROBUST_METRICS, *[f"{m}_robust_z" for m in ROBUST_METRICS])
    rows = rows.join(dq, "npi", "left").join(drug_mix_psi(detail, drug_risk), "npi", "left")
    delay = arrival_delay if isinstance(arrival_delay, Column) else F.lit(arrival_delay)
    parts = {c: _unit(F.col(c)) for c in list(PHARMACY_WEIGHTS)[:4]}
    rows = rows.withColumns(parts | {"ArrivalDelay_Risk": _unit(delay), "PSI": F.coalesce("PSI", F.lit(0.0))})
    names = list(PHARMACY_WEIGHTS)
    total = sum(
        (F.col(c) * PHARMACY_WEIGHTS[c] for c in names[1:]), F.col(names[0]) * PHARMACY_WEIGHTS[names[0]]
    )
    rows = rows.withColumn("Final_Risk_Score", clip(total, 0.0, 1.0))
    # The level is banded on the unrounded score, then scores are stored rounded.
    rows = rows.withColumn("Risk_Level", PROVIDER_RISK_LEVEL("Final_Risk_Score"))
    return rows.withColumns({c: half_even(c, 6) for c in [*names, "Final_Risk_Score", "PSI"]})


def latest_rows(history: DataFrame, key: str, period: str) -> DataFrame:
    """All rows of each key's last period, ties included."""
    ranked = history.withColumn(
        "__rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(period)))
    )
    return ranked.filter("__rank = 1").drop("__rank")
