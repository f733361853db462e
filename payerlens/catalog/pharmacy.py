"""Pharmacy volume queries: annual, provider peers, drug peers, detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, view
from payerlens.catalog.sla import rounded
from payerlens.functions.clean import brand_generic_key, code_key, drug_key
from payerlens.operators.quantiles import percent_ranks
from payerlens.plans import pharmacy_volume as PV

METRICS = {
    "total_claims": "total_claims",
    "total_standardized_30_day_fills": "total_standardized_30_day_fills",
    "total_beneficiaries": "total_beneficiaries",
    "total_prescribers": "total_prescribers",
    "antibiotic": "total_claims_for_antibiotic_drugs",
    "antipsychotic": "total_claims_for_antipsychotic_drugs_age65plus",
    "opioid": "total_claims_for_opioid_drugs",
    "la_opioid": "total_claims_for_la_opioid_drugs",
}


def _stat(f, c):
    return f"CASE WHEN count({c}) OVER w = 3 THEN {f}({c}) OVER w END"


_ROLL = ", ".join(
    f"{_stat('avg', c)} AS {n}_mean, {_stat('stddev_samp', c)} AS {n}_std" for n, c in METRICS.items()
)
_Z = ", ".join(f"CASE WHEN {n}_std > 0 THEN ({c} - {n}_mean) / {n}_std END AS {n}_z" for n, c in METRICS.items())
_RISK = ", ".join(
    f"CASE WHEN {n}_z IS NULL THEN NULL WHEN {n}_z < 1 THEN 0.0::DOUBLE WHEN {n}_z < 2 THEN 40.0::DOUBLE WHEN {n}_z < 3 THEN 70.0::DOUBLE ELSE 100.0::DOUBLE END AS {n}_r"
    for n in METRICS
)
view(
    "annual_risk",
    f"""
    SELECT *, 0.85 * volume_risk_score + 0.15 * high_risk_drug_volume_score AS final_volume_risk_score FROM (
      SELECT *, 0.35 * total_claims_r + 0.35 * total_standardized_30_day_fills_r + 0.2 * total_beneficiaries_r + 0.1 * total_prescribers_r AS volume_risk_score,
             0.3 * antibiotic_r + 0.2 * antipsychotic_r + 0.3 * opioid_r + 0.2 * la_opioid_r AS high_risk_drug_volume_score
      FROM (SELECT *, {_RISK} FROM (SELECT *, {_Z} FROM (SELECT *, {_ROLL} FROM grand_totals
            WINDOW w AS (ORDER BY calendar_year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)))))
    """,
)
LEVEL = """CASE WHEN {s} IS NULL THEN 'Insufficient History' WHEN {s} < 25 THEN 'Low' WHEN {s} < 50 THEN 'Medium' WHEN {s} < 75 THEN 'High' ELSE 'Critical' END"""


@query(
    "pl06_annual_volume_risk",
    f"""
    SELECT calendar_year, total_claims, round_even(total_claims_z, 6) AS total_claims_zscore, total_claims_r AS total_claims_risk,
           round_even(total_standardized_30_day_fills_z, 6) AS total_standardized_30_day_fills_zscore,
           round_even(opioid_z, 6) AS opioid_zscore, la_opioid_r AS la_opioid_risk,
           round_even(volume_risk_score, 6) AS volume_risk_score, round_even(high_risk_drug_volume_score, 6) AS high_risk_drug_volume_score,
           round_even(final_volume_risk_score, 6) AS final_volume_risk_score,
           {LEVEL.format(s='final_volume_risk_score')} AS volume_risk_level,
           CASE WHEN volume_risk_score IS NULL THEN 'Insufficient historical data' ELSE '3-year rolling historical baseline' END AS baseline_type,
           CASE WHEN volume_risk_score IS NULL THEN 0 ELSE 3 END AS baseline_years_used,
           CASE WHEN final_volume_risk_score IS NULL THEN 'Insufficient historical data to determine the root cause of volume risk.'
                WHEN greatest(total_claims_r, total_standardized_30_day_fills_r, total_beneficiaries_r, total_prescribers_r) < 40 THEN 'No individual volume component shows a materially elevated risk.'
                ELSE printf(CASE WHEN greatest(total_claims_r, total_standardized_30_day_fills_r, total_beneficiaries_r, total_prescribers_r) >= 70
                       THEN '%s is the primary root cause of the elevated volume risk (component risk score: %.0f).' ELSE '%s is the main contributing factor to the volume risk (component risk score: %.0f).' END,
                     CASE greatest(total_claims_r, total_standardized_30_day_fills_r, total_beneficiaries_r, total_prescribers_r)
                       WHEN total_claims_r THEN 'Claims Volume' WHEN total_standardized_30_day_fills_r THEN 'Standardized 30-Day Fills' WHEN total_beneficiaries_r THEN 'Beneficiary Volume' ELSE 'Prescriber Volume' END,
                     greatest(total_claims_r, total_standardized_30_day_fills_r, total_beneficiaries_r, total_prescribers_r)) END AS root_cause,
           CASE WHEN final_volume_risk_score IS NULL THEN 'Obtain sufficient historical data before performing volume-risk assessment.'
                WHEN final_volume_risk_score >= 75 THEN 'Perform priority utilization review. Validate the elevated claims, fills, beneficiary and prescriber volumes against the 3-year historical baseline and investigate the main contributing component.'
                WHEN final_volume_risk_score >= 50 THEN 'Review the elevated volume component against the 3-year historical baseline and monitor whether the increase persists.'
                ELSE 'Continue routine monitoring against the historical baseline.' END AS recommendation
    FROM annual_risk
    """,
)
def _(spark, sf):
    rows = PV.annual_risk(S.grand_totals(spark, sf)).select(
        "calendar_year", F.col("total_claims").cast("bigint").alias("total_claims"),
        "total_claims_zscore", "total_claims_risk", "total_standardized_30_day_fills_zscore",
        "opioid_zscore", "la_opioid_risk", "volume_risk_score", "high_risk_drug_volume_score",
        "final_volume_risk_score", "volume_risk_level", "baseline_type", "baseline_years_used",
        "root_cause", "recommendation",
    )
    return rounded(
        rows, "total_claims_zscore", "total_standardized_30_day_fills_zscore", "opioid_zscore",
        "volume_risk_score", "high_risk_drug_volume_score", "final_volume_risk_score",
    )


@query(
    "wn07_wn08_rolling_zscore_yoy",
    f"""
    SELECT calendar_year, round_even(total_claims_mean, 6) AS total_claims_rolling_mean, round_even(total_claims_std, 6) AS total_claims_rolling_std,
           round_even(total_claims_z, 6) AS total_claims_zscore,
           round_even(100.0::DOUBLE * total_claims / lag(total_claims) OVER (ORDER BY calendar_year) - 100, 6) AS total_claims_yoy_change_pct
    FROM annual_risk
    """,
)
def _(spark, sf):
    columns = ["rolling_mean", "rolling_std", "zscore", "yoy_change_pct"]
    names = [f"total_claims_{c}" for c in columns]
    return rounded(PV.annual_risk(S.grand_totals(spark, sf)).select("calendar_year", *names), *names)


FLAGS = ("opioid", "la_opioid", "antibiotic", "antipsychotic", "ndc_conflict")
view(
    "flagged",
    "SELECT p.*, "
    + ", ".join(f"CASE WHEN upper(trim(coalesce(d.{f}_flag, 'N'))) = 'Y' THEN 1 ELSE 0 END AS {f}_flag" for f in FLAGS)
    + ", coalesce(CAST(Tot_Clms AS DOUBLE), 0) AS clm, coalesce(CAST(Tot_Benes AS DOUBLE), 0) AS ben"
    + """
    FROM prescriber_drug p LEFT JOIN (
      SELECT * FROM (SELECT *, replace(trim(upper(drug_name)), '  ', ' ') AS k,
             row_number() OVER (PARTITION BY replace(trim(upper(drug_name)), '  ', ' ') ORDER BY generic_name, """
    + ", ".join(f"{f}_flag" for f in FLAGS)
    + """) AS rn FROM drug_list) WHERE rn = 1 AND k <> '') d ON d.k = replace(trim(upper(p.Brnd_Name)), '  ', ' ')
    """,
)
ROLLUP = """sum(clm) AS total_claims, sum(Tot_30day_Fills) AS total_fills, sum(Tot_Day_Suply) AS total_day_supply,
            sum(Tot_Drug_Cst) AS total_drug_cost, sum(ben) AS total_beneficiaries"""
view(
    "npi_rollup",
    f"""
    SELECT *, {', '.join(f'CASE WHEN total_claims > 0 THEN {f}_claims / total_claims * 100 ELSE 0.0::DOUBLE END AS {f}_share' for f in FLAGS)}
    FROM (SELECT Prscrbr_NPI, Prscrbr_Last_Org_Name, Prscrbr_First_Name, Prscrbr_City, Prscrbr_State_Abrvtn, Prscrbr_Type, {ROLLUP},
                 {', '.join(f'sum(clm * {f}_flag) AS {f}_claims' for f in FLAGS)}
          FROM flagged GROUP BY 1, 2, 3, 4, 5, 6)
    """,
)
view(
    "drug_rollup",
    f"SELECT Brnd_Name, Gnrc_Name, {ROLLUP}, {', '.join(f'max({f}_flag) AS {f}_flag' for f in FLAGS)} FROM flagged GROUP BY 1, 2",
)


def pct(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100"


def band(c):
    return f"CASE WHEN {c} < 75 THEN 0.0::DOUBLE WHEN {c} < 90 THEN 40.0::DOUBLE WHEN {c} < 95 THEN 70.0::DOUBLE ELSE 100.0::DOUBLE END"


PCTS = ("claims", "fills", "day_supply", "beneficiary")
SUMS = ("total_claims", "total_fills", "total_day_supply", "total_beneficiaries")
_PCT_COLS = ", ".join(f"{pct(s)} AS {p}_percentile" for s, p in zip(SUMS, PCTS))
view(
    "npi_peer",
    f"""
    SELECT *, 0.4 * {band('claims_percentile')} + 0.3 * {band('fills_percentile')} + 0.2 * {band('day_supply_percentile')} + 0.1 * {band('beneficiary_percentile')} AS volume_risk_score
    FROM (SELECT *, {_PCT_COLS}, 0.25 * {pct('opioid_share')} + 0.15 * {pct('la_opioid_share')} + 0.2 * {pct('antibiotic_share')} + 0.2 * {pct('antipsychotic_share')} + 0.2 * {pct('ndc_conflict_share')} AS high_risk_drug_utilization_score
          FROM npi_rollup)
    """,
)
view(
    "drug_peer",
    f"""
    SELECT *, 0.35 * claims_percentile + 0.3 * fills_percentile + 0.2 * day_supply_percentile + 0.15 * beneficiary_percentile AS volume_risk_score
    FROM (SELECT *, {_PCT_COLS} FROM drug_rollup)
    """,
)
_TOP = "greatest(round_even(claims_percentile, 9), round_even(fills_percentile, 9), round_even(day_supply_percentile, 9), round_even(beneficiary_percentile, 9))"
_TOP_NAME = f"""CASE {_TOP} WHEN round_even(claims_percentile, 9) THEN 'Claims Volume' WHEN round_even(fills_percentile, 9) THEN '30-Day Fill Volume'
                WHEN round_even(day_supply_percentile, 9) THEN 'Day Supply Volume' ELSE 'Beneficiary Volume' END"""


def peer_cause(p95, p90, p75, none):
    return f"""CASE WHEN {_TOP} >= 75 THEN printf(CASE WHEN {_TOP} >= 95 THEN '{p95}' WHEN {_TOP} >= 90 THEN '{p90}' ELSE '{p75}' END,
               {_TOP_NAME}, round_even({_TOP}, 2)) ELSE '{none}' END"""


_NPI_CAUSE = peer_cause(
    "%s is the primary root cause. The NPI is at the %.2fth peer percentile for this measure.",
    "%s is the main contributing factor, with the NPI at the %.2fth peer percentile.",
    "%s is elevated relative to the NPI peer group (%.2fth percentile).",
    "No individual NPI volume component is materially elevated.",
)
_DRUG_CAUSE = peer_cause(
    "%s is the primary root cause of the elevated drug volume risk, with the drug at the %.2fth peer percentile.",
    "%s is the main contributing factor, with the drug at the %.2fth peer percentile.",
    "%s is elevated relative to the drug peer group (%.2fth percentile).",
    "No individual drug volume component is materially elevated.",
)


def prescriptions(spark, sf):
    return PV.flagged_prescriptions(S.prescriber_drug(spark, sf), S.drug_list(spark, sf))


@query(
    "pl07_provider_peer_risk",
    f"""
    SELECT Prscrbr_NPI, Prscrbr_Last_Org_Name, Prscrbr_First_Name, Prscrbr_State_Abrvtn, round_even(total_claims, 4) AS total_claims,
           round_even(total_fills, 4) AS total_fills, round_even(total_drug_cost, 4) AS total_drug_cost, round_even(opioid_share, 6) AS opioid_claim_share_pct,
           round_even(claims_percentile, 6) AS claims_percentile, round_even(fills_percentile, 6) AS fills_percentile,
           round_even(day_supply_percentile, 6) AS day_supply_percentile, round_even(beneficiary_percentile, 6) AS beneficiary_percentile,
           round_even(volume_risk_score, 6) AS volume_risk_score, round_even(high_risk_drug_utilization_score, 6) AS high_risk_drug_utilization_score,
           {LEVEL.format(s='round_even(volume_risk_score, 9)')} AS volume_risk_level, {_NPI_CAUSE} AS root_cause
    FROM npi_peer
    """,
)
def _(spark, sf):
    rows = PV.provider_peer_risk(prescriptions(spark, sf)).select(
        "Prscrbr_NPI", "Prscrbr_Last_Org_Name", "Prscrbr_First_Name", "Prscrbr_State_Abrvtn",
        "total_claims", "total_fills", "total_drug_cost", "opioid_claim_share_pct",
        "claims_percentile", "fills_percentile", "day_supply_percentile", "beneficiary_percentile",
        "volume_risk_score", "high_risk_drug_utilization_score", "volume_risk_level", "root_cause",
    )
    rows = rounded(rows, "total_claims", "total_fills", "total_drug_cost", digits=4)
    return rounded(
        rows, "opioid_claim_share_pct", "claims_percentile", "fills_percentile",
        "day_supply_percentile", "beneficiary_percentile", "volume_risk_score",
        "high_risk_drug_utilization_score",
    )


@query(
    "pl08_drug_peer_risk",
    f"""
    SELECT Brnd_Name, Gnrc_Name, round_even(total_claims, 4) AS total_claims, round_even(total_drug_cost, 4) AS total_drug_cost,
           round_even(claims_percentile, 6) AS claims_percentile, round_even(volume_risk_score, 6) AS volume_risk_score,
           {LEVEL.format(s='round_even(volume_risk_score, 9)')} AS volume_risk_level,
           opioid_flag + la_opioid_flag + antibiotic_flag + antipsychotic_flag + ndc_conflict_flag AS high_risk_flag_count, {_DRUG_CAUSE} AS root_cause,
           CASE WHEN round_even(volume_risk_score, 9) >= 75 THEN 'Perform targeted drug utilization review. Examine prescriber concentration, beneficiary distribution, claims and day supply to determine whether the elevated peer-relative volume is justified.'
                WHEN round_even(volume_risk_score, 9) >= 50 THEN 'Review the drug''s utilization distribution across prescribers and beneficiaries and monitor for sustained elevated volume.'
                ELSE 'Continue routine monitoring against the current drug peer baseline.' END AS recommendation
    FROM drug_peer
    """,
)
def _(spark, sf):
    rows = PV.drug_peer_risk(prescriptions(spark, sf)).select(
        "Brnd_Name", "Gnrc_Name", "total_claims", "total_drug_cost", "claims_percentile",
        "volume_risk_score", "volume_risk_level", "high_risk_flag_count", "root_cause",
        "recommendation",
    )
    rows = rounded(rows, "total_claims", "total_drug_cost", digits=4)
    return rounded(rows, "claims_percentile", "volume_risk_score")


@query(
    "wn09_percent_rank",
    f"SELECT p_partkey, round_even({pct('p_size')}, 6) AS size_rank, round_even({pct('p_retailprice')}, 6) AS price_rank FROM part",
)
def _(spark, sf):
    from payerlens.catalog.registry import table

    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    ranked = percent_ranks(part, {"p_size": "size_rank", "p_retailprice": "price_rank"})
    return rounded(ranked.select("p_partkey", "size_rank", "price_rank"), "size_rank", "price_rank")


@query(
    "ag13_npi_rollup",
    """SELECT Prscrbr_NPI, Prscrbr_First_Name, round_even(total_claims, 4) AS total_claims, round_even(total_fills, 4) AS total_fills,
              round_even(total_beneficiaries, 4) AS total_beneficiaries, round_even(ndc_conflict_claims, 4) AS ndc_conflict_claims FROM npi_rollup""",
)
def _(spark, sf):
    columns = ["total_claims", "total_fills", "total_beneficiaries", "ndc_conflict_claims"]
    rows = PV.provider_rollup(prescriptions(spark, sf))
    return rounded(rows.select("Prscrbr_NPI", "Prscrbr_First_Name", *columns), *columns, digits=4)


@query(
    "ag14_drug_rollup",
    """SELECT Brnd_Name, Gnrc_Name, round_even(total_claims, 4) AS total_claims, round_even(total_day_supply, 4) AS total_day_supply,
              opioid_flag, antipsychotic_flag FROM drug_rollup""",
)
def _(spark, sf):
    rows = PV.drug_rollup(prescriptions(spark, sf)).select(
        "Brnd_Name", "Gnrc_Name", "total_claims", "total_day_supply", "opioid_flag",
        "antipsychotic_flag",
    )
    return rounded(rows, "total_claims", "total_day_supply", digits=4)


@query(
    "pl09_jn03_provider_drug_detail",
    """
    SELECT Prscrbr_NPI, Brnd_Name, Gnrc_Name, clm AS Tot_Clms, opioid_flag, la_opioid_flag, antibiotic_flag, antipsychotic_flag, ndc_conflict_flag,
           clm * opioid_flag AS opioid_claims,
           CASE WHEN clm > 0 THEN 'This NPI-drug combination contributes to the provider''s pharmacy utilization volume.' ELSE 'No measurable claim-volume contribution.' END AS root_cause
    FROM flagged
    """,
)
def _(spark, sf):
    return PV.provider_drug_detail(prescriptions(spark, sf)).select(
        "Prscrbr_NPI", "Brnd_Name", "Gnrc_Name", "Tot_Clms", *[f"{f}_flag" for f in FLAGS],
        "opioid_claims", "root_cause",
    )


@query(
    "fn14_fn16_drug_keys",
    """
    SELECT drug_name, generic_name, replace(trim(upper(drug_name)), '  ', ' ') AS drug_key,
           lower(trim(drug_name)) || '||' || lower(trim(generic_name)) AS pair_key, upper(trim(generic_name)) AS generic_key,
           CASE WHEN upper(trim(la_opioid_flag)) = 'Y' THEN 1 ELSE 0 END AS la_opioid
    FROM drug_list
    """,
)
def _(spark, sf):
    from payerlens.functions.clean import yes_flag

    return S.drug_list(spark, sf).select(
        "drug_name", "generic_name", drug_key("drug_name").alias("drug_key"),
        brand_generic_key("drug_name", "generic_name").alias("pair_key"),
        code_key("generic_name").alias("generic_key"), yes_flag("la_opioid_flag").alias("la_opioid"),
    )
