"""Claims anomalies: provider months against peers, population drift and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payerlens.functions.bands import PSI_LABEL, claims_severity
from payerlens.functions.clean import code_key, number, ratio
from payerlens.functions.codes import STRUCTURAL_HCPCS, structurally_invalid
from payerlens.functions.dates import days_between, month_key
from payerlens.functions.text import fill, fixed
from payerlens.operators.contracts import existing, family, first_existing
from payerlens.operators.drift import rolling_psi
from payerlens.operators.keyed import first_per_key
from payerlens.operators.quantiles import robust_z
from payerlens.operators.stages import settle

# Fixed values.
Z_LIMIT = 3.5
PSI_LIMIT = 0.25
MIN_PEERS = 5
FEATURES = (
    "avg_claim_payment",
    "avg_claim_charge",
    "avg_payment_to_charge",
    "duplicate_rate",
    "avg_los",
    "avg_utilization_days",
    "avg_hha_visits",
    "avg_service_units",
    "payment_to_allowed",
    "claims_per_beneficiary",
)
ANOMALY_NAMES = {
    "avg_claim_payment": "Claim payment anomaly",
    "avg_claim_charge": "Claim charge anomaly",
    "avg_payment_to_charge": "Payment-to-charge ratio anomaly",
    "duplicate_rate": "Duplicate claim anomaly",
    "avg_los": "Length-of-stay / utilization-day anomaly",
    "avg_hha_visits": "HHA visit-count anomaly",
    "avg_service_units": "DME service-unit/quantity anomaly",
    "payment_to_allowed": "DME payment/allowed-charge anomaly",
    "claims_per_beneficiary": "Provider utilization anomaly",
}
UTILIZATION_NAME = {"avg_utilization_days": "Utilization-day anomaly"}
PSI_FIELDS = {
    "Specialty distribution drift": "specialty",
    "Geographic/state distribution drift": "state",
    "Diagnosis distribution drift": "diagnosis",
    "Procedure distribution drift": "procedure",
    "HCPCS/service distribution drift": "hcpcs",
    "Revenue-center distribution drift": "revenue_center",
    "Primary-payer distribution drift": "payer",
    "Claim-status distribution drift": "claim_status",
    "Discharge-status distribution drift": "discharge_status",
}
DIAGNOSIS_DRIFT = "Diagnosis distribution drift"
RULES = {
    "diagnosis_procedure_mismatch": (
        "Diagnosis–procedure mismatch",
        "Rule-based structural mismatch: diagnosis and procedure presence do not agree.",
    ),
    "invalid_icd_hcpcs": (
        "Invalid ICD/HCPCS code",
        "Rule-based structural code validation found ICD/HCPCS values that do not match the expected code format.",
    ),
    "impossible_date_relation": (
        "Impossible admission/discharge/date relationship",
        "Admission/from date occurs after discharge/through date.",
    ),
}
DIAGNOSIS_COLUMNS = r"PRNCPAL_DGNS_CD|ADMTG_DGNS_CD|ICD_DGNS_CD\d+|FST_DGNS_E_CD|ICD_DGNS_E_CD\d+"
PROCEDURE_COLUMNS = r"ICD_PRCDR_CD\d+"
# Columns that may hold each role, the first present one counts.
ROLES = {
    "date": ("CLM_FROM_DT", "SERVICE_DATE", "SRVC_DT", "LINE_1ST_EXPNS_DT"),
    "claim": ("CLM_ID", "CLAIM_ID", "CLAIMID"),
    "provider": ("ORG_NPI_NUM", "PRVDR_NPI", "PRVDR_NUM", "RFR_PHYSN_NPI"),
    "line": ("CLM_LINE_NUM", "LINE_NUM"),
    "state": ("PRVDR_STATE_CD", "DMERC_LINE_PRCNG_STATE_CD"),
    "specialty": ("PRVDR_SPCLTY",),
    "payment": ("CLM_PMT_AMT", "NCH_PRVDR_PMT_AMT", "LINE_NCH_PMT_AMT", "REV_CNTR_PMT_AMT_AMT"),
    "charge": (
        "CLM_TOT_CHRG_AMT",
        "NCH_CARR_CLM_SBMTD_CHRG_AMT",
        "LINE_SBMTD_CHRG_AMT",
        "REV_CNTR_TOT_CHRG_AMT",
    ),
    "allowed": ("NCH_CARR_CLM_ALOWD_AMT", "LINE_ALOWD_CHRG_AMT", "LINE_PRMRY_ALOWD_CHRG_AMT"),
    "units": ("LINE_SRVC_CNT", "REV_CNTR_UNIT_CNT", "DMERC_LINE_MTUS_CNT"),
    "utilization_days": ("CLM_UTLZTN_DAY_CNT",),
    "visits": ("CLM_HHA_TOT_VISIT_CNT",),
    "discharged": ("NCH_BENE_DSCHRG_DT", "CLM_THRU_DT"),
    "admitted": ("CLM_ADMSN_DT", "CLM_FROM_DT"),
    "diagnosis": ("PRNCPAL_DGNS_CD", "ADMTG_DGNS_CD"),
    "hcpcs": ("HCPCS_CD",),
    "revenue_center": ("REV_CNTR",),
    "payer": ("NCH_PRMRY_PYR_CD", "LINE_BENE_PRMRY_PYR_CD"),
    "claim_status": (
        "CLM_DISP_CD",
        "CLM_MDCR_NON_PMT_RSN_CD",
        "LINE_PRCSG_IND_CD",
        "REV_CNTR_STUS_IND_CD",
    ),
    "discharge_status": ("PTNT_DSCHRG_STUS_CD",),
}
PEERS = ["claim_type", "month"]
PROVIDER_MONTH = ["claim_type", "provider", "month"]


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def standard_lines(claims: DataFrame, claim_type: Column | str = "claim_type") -> DataFrame:
    """Claim lines by role, with the four rule flags; lines without a date are left out."""

    def role(name, kind="string"):
        return first_existing(claims, ROLES[name], kind)

    diagnoses, procedures = family(claims, DIAGNOSIS_COLUMNS), family(claims, PROCEDURE_COLUMNS)
    diagnosis = role("diagnosis")
    if not existing(claims, ROLES["diagnosis"]) and diagnoses:
        diagnosis = F.col(diagnoses[0])
    procedure = F.col(procedures[0]) if procedures else F.lit(None).cast("string")
    admitted, discharged = role("admitted", "timestamp"), role("discharged", "timestamp")
    bad_dates = F.coalesce(discharged < admitted, F.lit(False))
    if {"CLM_FROM_DT", "CLM_THRU_DT"} <= set(claims.columns):
        bad_dates = bad_dates | F.coalesce(
            F.col("CLM_THRU_DT").cast("timestamp") < F.col("CLM_FROM_DT").cast("timestamp"),
            F.lit(False),
        )
    has_diagnosis = _any([F.col(c).isNotNull() for c in diagnoses])
    has_procedure = _any([F.col(c).isNotNull() for c in procedures])
    bad_codes = [structurally_invalid(c) for c in procedures]
    if "HCPCS_CD" in claims.columns:
        bad_codes.append(structurally_invalid("HCPCS_CD", STRUCTURAL_HCPCS))
    kind = F.col(claim_type) if isinstance(claim_type, str) else claim_type
    return claims.select(
        kind.alias("claim_type"),
        role("claim").alias("claim"),
        role("line").alias("line"),
        role("provider").alias("provider"),
        month_key(role("date", "timestamp")).alias("month"),
        first_existing(claims, ["BENE_ID"]).alias("bene"),
        *[
            number(role(n)).alias(n)
            for n in ("payment", "charge", "allowed", "units", "utilization_days", "visits")
        ],
        days_between(admitted, discharged).alias("los_days"),
        role("specialty").alias("specialty"),
        role("state").alias("state"),
        code_key(diagnosis).alias("diagnosis"),
        code_key(procedure).alias("procedure"),
        code_key(role("hcpcs")).alias("hcpcs"),
        *[role(n).alias(n) for n in ("revenue_center", "payer", "claim_status", "discharge_status")],
        (has_diagnosis != has_procedure).cast("int").alias("mismatch"),
        _any([structurally_invalid(c) for c in diagnoses]).cast("int").alias("bad_icd"),
        _any(bad_codes).cast("int").alias("bad_hcpcs"),
        bad_dates.cast("int").alias("bad_dates"),
    ).filter(F.col("month").isNotNull())


def combined_lines(frames: dict[str, DataFrame]) -> DataFrame:
    """Lines of several claim files, one per claim type."""
    parts = [standard_lines(df, F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


CLAIM_COLUMNS = (
    "claim_type",
    "claim",
    "line",
    "provider",
    "month",
    "bene",
    "payment",
    "charge",
    "allowed",
    "utilization_days",
    "visits",
    "los_days",
)


def claim_level(lines: DataFrame) -> DataFrame:
    """First line of each claim, in the order of the line number text."""
    return first_per_key(lines.select(*CLAIM_COLUMNS), ["claim_type", "claim"], ["line"])


def claim_line_counts(lines: DataFrame) -> DataFrame:
    """Lines per claim and how many of them share their line number."""
    per_line = lines.groupBy("claim_type", "claim", "line").agg(F.count(F.lit(1)).alias("n"))
    return per_line.groupBy("claim_type", "claim").agg(
        F.sum("n").alias("claim_line_count"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_line_rows"),
    )


def claim_behavior(claims: DataFrame) -> DataFrame:
    """Averages and totals of a provider month over its claims."""
    to_charge = ratio("payment", "charge")
    grouped = claims.groupBy(*PROVIDER_MONTH).agg(
        F.count("claim").alias("claim_count"),
        F.countDistinct("bene").alias("beneficiary_count"),
        F.avg("payment").alias("avg_claim_payment"),
        F.avg("charge").alias("avg_claim_charge"),
        F.avg(to_charge).alias("avg_payment_to_charge"),
        F.avg("los_days").alias("avg_los"),
        F.avg("utilization_days").alias("avg_utilization_days"),
        F.avg(F.when(F.col("claim_type") == "hha", F.col("visits"))).alias("avg_hha_visits"),
        F.coalesce(F.sum("payment"), F.lit(0.0)).alias("total_payment"),
        F.coalesce(F.sum("charge"), F.lit(0.0)).alias("total_charge"),
        F.coalesce(F.sum("allowed"), F.lit(0.0)).alias("total_allowed"),
    )
    return grouped.withColumn(
        "claims_per_beneficiary", ratio("claim_count", "beneficiary_count")
    )


def claim_medians(claims: DataFrame) -> DataFrame:
    """Median payment and charge of a provider month."""
    from payerlens.operators.quantiles import exact_median

    medians = exact_median(claims, PROVIDER_MONTH, ["payment", "charge"])
    return medians.withColumnsRenamed(
        {"payment_median": "median_claim_payment", "charge_median": "median_claim_charge"}
    )


def line_behavior(lines: DataFrame) -> DataFrame:
    """Repeated-line rate, units, payment share, specialty, state and rule counts.

    Grouping by line first settles repeated lines and spreads large providers.
    """
    sums = ("units", "payment", "allowed", "mismatch", "bad_icd", "bad_hcpcs", "bad_dates")
    per_line = lines.groupBy(*PROVIDER_MONTH, "claim", "line").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.count(c).alias(f"{c}_n") for c in ("units", "payment", "allowed")],
        F.min("specialty").alias("specialty"),
        F.min("state").alias("state"),
    )

    def mean(c):
        return F.sum(c) / F.nullif(F.sum(f"{c}_n"), F.lit(0))

    dme = F.col("claim_type") == "dme"
    grouped = per_line.groupBy(*PROVIDER_MONTH).agg(
        (1.0 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_rate"),
        mean("units").alias("units"),
        mean("payment").alias("line_payment"),
        mean("allowed").alias("line_allowed"),
        F.min("specialty").alias("specialty"),
        F.min("state").alias("state"),
        F.sum("mismatch").alias("diagnosis_procedure_mismatch"),
        F.sum(F.col("bad_icd") + F.col("bad_hcpcs")).alias("invalid_icd_hcpcs"),
        F.sum("bad_dates").alias("impossible_date_relation"),
    )
    return grouped.withColumns(
        {
            "avg_service_units": F.when(dme, F.col("units")),
            "payment_to_allowed": F.when(dme, ratio("line_payment", "line_allowed")),
        }
    ).drop("units", "line_payment", "line_allowed")


FIRST, NEW_LINE = "__first", "__new_line"
LINE_MEASURES = (
    "duplicate_rate",
    "avg_service_units",
    "specialty",
    "state",
    "diagnosis_procedure_mismatch",
    "invalid_icd_hcpcs",
    "impossible_date_relation",
)


def marked_lines(lines: DataFrame) -> DataFrame:
    """Lines with two marks: first line of its claim, first row of its line within a provider month.

    The window holds one claim's lines and needs no shuffle where the lines already lie by
    claim. The order is that of claim_level, so equal rows give the same pick; in it, rows of
    one line and provider month follow each other. The claim leads the keys, as it tells most
    rows apart when they are sorted.
    """
    order = [c for c in CLAIM_COLUMNS if c not in ("claim_type", "claim")]
    claim = Window.partitionBy("claim", "claim_type").orderBy(*order)
    first = F.row_number().over(claim) == 1
    same = [F.col(c).eqNullSafe(F.lag(c).over(claim)) for c in ("line", "provider", "month")]
    return lines.withColumns({FIRST: first, NEW_LINE: first | ~reduce(lambda a, b: a & b, same)})


def provider_months(lines: DataFrame) -> DataFrame:
    """Behaviour of every provider month.

    Claims are attributed to the provider and month of their first line, so a
    provider month seen only on later lines has no row here. The lines are read once
    and travel once, to their provider month; claim_level, claim_behavior and
    line_behavior tell the same of claims and lines apart. Sums and counts are taken for each
    specialty and state first, as texts among the measures would have every line sorted
    and passed on row by row through each step of the aggregate.
    """
    first, dme = F.col(FIRST), F.col("claim_type") == "dme"
    keys = ("provider", "month", "claim_type")
    rows = marked_lines(lines).select(
        *keys,
        FIRST,
        NEW_LINE,
        (first & F.col("claim").isNotNull()).alias("claim"),
        F.when(first, F.col("bene")).alias("bene"),
        "payment",
        F.when(first | dme, F.col("allowed")).alias("allowed"),
        *[F.when(first, F.col(c)).alias(c) for c in ("charge", "utilization_days", "visits", "los_days")],
        F.when(dme, F.col("units")).alias("units"),
        "specialty",
        "state",
        *("mismatch", "bad_icd", "bad_hcpcs", "bad_dates"),
    )
    # A person's rows follow each other, which leaves a mark to count instead of the persons.
    person = Window.partitionBy(*keys).orderBy("bene")
    bene = F.col("bene")
    rows = rows.repartition(*keys).withColumn("bene", bene.isNotNull() & ~bene.eqNullSafe(F.lag(bene).over(person)))

    def claims(c):
        return F.when(first, F.col(c))

    averages = {
        "avg_claim_payment": claims("payment"),
        "avg_claim_charge": F.col("charge"),
        "avg_payment_to_charge": F.when(first, ratio("payment", "charge")),
        "avg_los": F.col("los_days"),
        "avg_utilization_days": F.col("utilization_days"),
        "avg_hha_visits": F.when(F.col("claim_type") == "hha", F.col("visits")),
        "avg_service_units": F.col("units"),
        "line_payment": F.when(dme, F.col("payment")),
        "line_allowed": F.when(dme, F.col("allowed")),
    }
    sums = {
        "total_allowed": claims("allowed"),
        "diagnosis_procedure_mismatch": F.col("mismatch"),
        "invalid_icd_hcpcs": F.col("bad_icd") + F.col("bad_hcpcs"),
        "impossible_date_relation": F.col("bad_dates"),
    }
    counts = {"claim_count": "claim", "beneficiary_count": "bene", "new_lines": NEW_LINE, FIRST: FIRST}
    places = rows.groupBy(*keys, "specialty", "state").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c)).alias(name) for name, c in counts.items()],
        *[F.sum(c).alias(name) for name, c in (averages | sums).items()],
        *[F.count(c).alias(f"{name}_n") for name, c in averages.items()],
    )

    def mean(name):
        return (F.sum(name) / F.nullif(F.sum(f"{name}_n"), F.lit(0))).alias(name)

    grouped = places.groupBy(*keys).agg(
        F.sum("claim_count").alias("claim_count"),
        F.sum("beneficiary_count").alias("beneficiary_count"),
        *[mean(name) for name in averages],
        F.coalesce(F.sum("avg_claim_payment"), F.lit(0.0)).alias("total_payment"),
        F.coalesce(F.sum("avg_claim_charge"), F.lit(0.0)).alias("total_charge"),
        F.coalesce(F.sum("total_allowed"), F.lit(0.0)).alias("total_allowed"),
        (1.0 - F.sum("new_lines") / F.sum("rows")).alias("duplicate_rate"),
        F.min("specialty").alias("specialty"),
        F.min("state").alias("state"),
        *[F.sum(name).alias(name) for name in list(sums)[1:]],
        F.sum(FIRST).alias(FIRST),
    )
    # What lines tell belongs to a known provider only, as in a join by claim type and provider.
    known = F.col("claim_type").isNotNull() & F.col("provider").isNotNull()
    return (
        grouped.filter(F.col(FIRST) > 0)
        .withColumns(
            {
                "claims_per_beneficiary": ratio("claim_count", "beneficiary_count"),
                "payment_to_allowed": F.when(known & dme, ratio("line_payment", "line_allowed")),
                **{c: F.when(known, F.col(c)) for c in LINE_MEASURES},
            }
        )
        .drop("line_payment", "line_allowed", FIRST)
    )


def peer_scores(months: DataFrame) -> DataFrame:
    """Robust Z of every feature by claim type and month, and within the specialty."""
    scored = robust_z(months, PEERS, FEATURES, MIN_PEERS)
    within = robust_z(
        scored.withColumn("specialty_behavior", F.col("claims_per_beneficiary")),
        [*PEERS, "specialty"],
        ["specialty_behavior"],
        MIN_PEERS,
        settled=True,  # the settled months with their settled medians
    )
    return within.withColumn(
        "specialty_behavior_z", F.when(F.col("specialty").isNotNull(), F.col("specialty_behavior_z"))
    ).drop("specialty_behavior")


def population_drift(lines: DataFrame, **limits) -> DataFrame:
    """PSI of every field, claim type and month against the six months before."""
    return rolling_psi(lines, "claim_type", "month", PSI_FIELDS, **limits).withColumns(
        {
            "psi_anomaly": (F.col("psi_score") >= PSI_LIMIT).cast("int"),
            "interpretation": PSI_LABEL("psi_score"),
        }
    )


def _field_order() -> Column:
    names = F.array(*[F.lit(f) for f in PSI_FIELDS])
    return F.array_position(names, F.col("field"))


def drift_by_month(drift: DataFrame) -> DataFrame:
    """All drifting fields of a claim type and month in one row (at most nine)."""
    drifting = F.col("psi_score") >= PSI_LIMIT
    text = fill(
        "{}: PSI={}; threshold=0.25; baseline={}",
        F.col("field"),
        fixed("psi_score", 4),
        F.col("baseline_periods"),
    )
    is_diagnosis = F.col("field") == DIAGNOSIS_DRIFT
    return drift.groupBy("claim_type", "month").agg(
        F.sort_array(
            F.collect_list(F.when(drifting, F.struct(_field_order().alias("o"), text.alias("text"))))
        ).alias("drift_items"),
        F.max(F.when(drifting, F.col("psi_score"))).alias("drift_max"),
        F.max(F.when(is_diagnosis, F.col("psi_score"))).alias("diagnosis_psi"),
        F.max(F.when(is_diagnosis, F.col("baseline_periods"))).alias("diagnosis_baseline"),
    )


def _abnormal(z: str) -> Column:
    return F.coalesce(F.abs(F.col(z)) >= Z_LIMIT, F.lit(False))


def _reported(utilization: bool) -> dict[str, str]:
    return ANOMALY_NAMES | (UTILIZATION_NAME if utilization else {})


def signals(scored: DataFrame, drift: DataFrame, utilization: bool = False) -> DataFrame:
    """Provider months with their abnormal signals as text lists and counts."""
    rows = scored.join(drift_by_month(drift), PEERS, "left")
    kind, month = F.col("claim_type"), F.col("month")
    robust = [
        F.when(
            _abnormal(f"{f}_z"),
            fill(
                name + ": actual={}; Robust_Z={}; threshold=±3.5; peer_group={}+{}",
                fixed(f, 4),
                fixed(f"{f}_z", 4),
                kind,
                month,
            ),
        )
        for f, name in _reported(utilization).items()
    ]
    robust.append(
        F.when(
            _abnormal("specialty_behavior_z"),
            fill(
                "Provider specialty behavior anomaly: claims_per_beneficiary={}; specialty Robust_Z={}; threshold=±3.5; specialty={}",
                fixed("claims_per_beneficiary", 4),
                fixed("specialty_behavior_z", 4),
                F.col("specialty"),
            ),
        )
    )
    both = _abnormal("claims_per_beneficiary_z") & F.coalesce(
        F.col("diagnosis_psi") >= PSI_LIMIT, F.lit(False)
    )
    robust.append(
        F.when(
            both,
            fill(
                "Provider–diagnosis behavior anomaly: provider utilization Robust_Z={}",
                fixed("claims_per_beneficiary_z", 4),
            ),
        )
    )
    rules = [
        F.when(F.col(c) > 0, fill(name + ": affected_rows={}; " + why, F.col(c)))
        for c, (name, why) in RULES.items()
    ]

    def kept(items):
        return F.filter(F.array(*items), lambda t: t.isNotNull())

    drifted = F.transform(F.coalesce("drift_items", F.array()), lambda d: d["text"])
    pair = F.when(
        both,
        F.array(
            fill("Provider–diagnosis behavior anomaly: diagnosis PSI={}", fixed("diagnosis_psi", 4))
        ),
    ).otherwise(F.array().cast("array<string>"))
    strongest = F.greatest(
        *[
            F.when(_abnormal(f"{f}_z"), F.abs(F.col(f"{f}_z")))
            for f in [*_reported(utilization), "specialty_behavior"]
        ]
    )
    rows = rows.withColumns(
        {
            "robust_items": kept(robust),
            "rule_items": kept(rules),
            "psi_items": F.concat(drifted, pair),
            "provider_diagnosis": both,
            "max_z": strongest,
            "max_psi": F.greatest("drift_max", F.when(both, F.col("diagnosis_psi"))),
        }
    )
    # As many as the three lists hold, told without them: lists take lambdas, which are not
    # compiled, and only months with a signal need their texts.
    found = [_abnormal(f"{f}_z") & kind.isNotNull() & month.isNotNull() for f in _reported(utilization)]
    found += [_abnormal("specialty_behavior_z") & F.col("specialty").isNotNull(), both, both]
    found += [F.coalesce(F.col(c) > 0, F.lit(False)) for c in RULES]
    count = reduce(lambda a, b: a + b, [c.cast("int") for c in found])
    return rows.withColumn("signal_count", count + F.size(F.coalesce("drift_items", F.array())))


def provider_anomalies(found: DataFrame) -> DataFrame:
    """Provider months with at least one signal."""
    severity = claims_severity("signal_count", "max_z", "max_psi")

    def part(title, items):
        return F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(items, " ; ")))

    closing = fill(
        "Multi-metric combination: {} abnormal signals; severity={}.", F.col("signal_count"), severity
    )
    return found.filter("signal_count > 0").select(
        F.xxhash64("claim_type", "provider", "month").alias("anomaly_id"),
        "claim_type",
        F.col("provider").alias("provider_id"),
        F.col("month").alias("batch_month"),
        F.col("max_z").alias("robust_z_score"),
        (F.size("robust_items") > 0).cast("int").alias("robust_z_anomaly"),
        F.col("max_psi").alias("psi_score"),
        (F.size("psi_items") > 0).cast("int").alias("psi_anomaly"),
        F.col("signal_count").alias("anomaly_count"),
        severity.alias("severity"),
        F.concat_ws(
            " | ",
            part("ROBUST Z: ", "robust_items"),
            part("PSI: ", "psi_items"),
            part("RULE-BASED: ", "rule_items"),
            closing,
        ).alias("anomaly_reason"),
    )


def population_anomalies(drift: DataFrame) -> DataFrame:
    """One row per claim type and month with drifting fields."""
    text = fill(
        "{}: PSI={}; baseline={}", F.col("field"), fixed("psi_score", 4), F.col("baseline_periods")
    )
    grouped = (
        drift.filter("psi_anomaly = 1")
        .groupBy("claim_type", "month")
        .agg(
            F.max("psi_score").alias("psi_score"),
            F.count(F.lit(1)).cast("int").alias("anomaly_count"),
            F.sort_array(
                F.collect_list(F.struct(_field_order().alias("o"), text.alias("text")))
            ).alias("items"),
        )
    )
    return grouped.select(
        F.xxhash64("claim_type", F.lit(None).cast("string"), "month").alias("anomaly_id"),
        "claim_type",
        F.lit(None).cast("string").alias("provider_id"),
        F.col("month").alias("batch_month"),
        F.lit(None).cast("double").alias("robust_z_score"),
        F.lit(0).alias("robust_z_anomaly"),
        "psi_score",
        F.lit(1).alias("psi_anomaly"),
        "anomaly_count",
        claims_severity("anomaly_count", F.lit(None).cast("double"), "psi_score").alias("severity"),
        F.concat(
            F.lit("Population-level distribution drift: "),
            F.array_join(F.transform("items", lambda i: i["text"]), " ; "),
        ).alias("anomaly_reason"),
    )


def _starting(items: str, beginning: str) -> Column:
    return F.filter(items, lambda t: t.startswith(beginning))


def _metric(name, metric, kind, actual, score, limit, hit, peers, baseline, reason):
    return F.struct(
        F.lit(name).alias("anomaly_name"),
        F.lit(metric).alias("metric_name"),
        F.lit(kind).alias("metric_type"),
        actual.cast("double").alias("actual_value"),
        score.cast("double").alias("score"),
        F.lit(limit).cast("double").alias("threshold"),
        hit.cast("int").alias("is_anomalous"),
        peers.alias("peer_group"),
        baseline.alias("baseline_periods"),
        reason.alias("anomaly_reason"),
    )


def provider_metrics(found: DataFrame, utilization: bool = False) -> DataFrame:
    """Every signal of every provider month as its own row."""
    peers = F.concat_ws("+", "claim_type", "month")
    rows = []
    for f, name in _reported(utilization).items():
        z = F.col(f"{f}_z")
        hit = _abnormal(f"{f}_z")
        text = _starting("robust_items", name)
        reason = (
            F.when(hit, F.get(text, F.lit(0)))
            .when(z.isNotNull(), "Normal relative to peer providers")
            .otherwise("Robust Z unavailable: insufficient valid peer observations or MAD=0")
        )
        why = F.lit("Previous peer providers in same claim type/month; minimum peers=5")
        rows.append(_metric(name, f, "ROBUST_Z", F.col(f), z, Z_LIMIT, hit, peers, why, reason))
    z, hit = F.col("specialty_behavior_z"), _abnormal("specialty_behavior_z")
    per_person = F.col("claims_per_beneficiary")
    text = _starting("robust_items", "Provider specialty")
    rows.append(
        _metric(
            "Provider specialty behavior anomaly",
            "specialty_behavior",
            "ROBUST_Z",
            per_person,
            z,
            Z_LIMIT,
            hit,
            F.concat(peers, F.lit("+specialty="), F.coalesce("specialty", F.lit("UNKNOWN"))),
            F.lit("Previous providers in same claim type/month/specialty; minimum peers=5"),
            F.when(hit, F.get(text, F.lit(0)))
            .when(z.isNotNull(), "Normal relative to providers within the same specialty")
            .otherwise("Specialty Robust Z unavailable"),
        )
    )
    for c, (name, why) in RULES.items():
        hit = F.col(c) > 0
        reason = F.when(hit, why).otherwise("No rule violation detected")
        own = F.lit("Current provider-month data")
        rows.append(
            _metric(name, c, "RULE_BASED", F.col(c), F.col(c), 0.0, hit, F.lit("PROVIDER_MONTH"), own, reason)
        )
    rows.append(
        _metric(
            "Provider–diagnosis behavior anomaly",
            "provider_diagnosis_combined",
            "ROBUST_Z + PSI",
            per_person,
            F.col("claims_per_beneficiary_z"),
            Z_LIMIT,
            F.col("provider_diagnosis"),
            peers,
            F.coalesce("diagnosis_baseline", F.lit("No diagnosis PSI baseline")),
            F.when(
                F.col("provider_diagnosis"),
                "Both provider utilization behavior and diagnosis population distribution were anomalous.",
            ).otherwise("Combined condition not met."),
        )
    )
    count = F.col("signal_count")
    rows.append(
        _metric(
            "Multi-metric provider anomaly",
            "multi_metric_signal_count",
            "RULE_BASED_COMBINATION",
            count,
            count,
            2.0,
            count >= 2,
            F.lit("PROVIDER_MONTH"),
            F.lit("Current provider-month anomaly signals"),
            F.when(
                count >= 2,
                fill(
                    "Multi-metric provider anomaly: {} independent signals were abnormal.", count
                ),
            ).otherwise("Fewer than two independent anomaly signals."),
        )
    )
    anomaly = F.when(count > 0, F.xxhash64("claim_type", "provider", "month"))
    return found.select(
        anomaly.alias("anomaly_id"),
        "claim_type",
        F.col("provider").alias("provider_id"),
        F.col("month").alias("batch_month"),
        F.explode(F.array(*rows)).alias("m"),
    ).select("anomaly_id", "claim_type", "provider_id", "batch_month", "m.*")


def population_metrics(drift: DataFrame) -> DataFrame:
    """Every PSI score as a metric row of its claim type and month."""
    reason = fill(
        "{}; baseline_rows={}; current_rows={}; baseline_categories={}",
        F.col("interpretation"),
        F.col("baseline_rows"),
        F.col("current_rows"),
        F.col("baseline_categories"),
    )
    return drift.select(
        F.lit(None).cast("bigint").alias("anomaly_id"),
        "claim_type",
        F.lit(None).cast("string").alias("provider_id"),
        F.col("month").alias("batch_month"),
        F.col("field").alias("anomaly_name"),
        F.col("field").alias("metric_name"),
        F.lit("PSI").alias("metric_type"),
        F.lit(None).cast("double").alias("actual_value"),
        F.col("psi_score").alias("score"),
        F.lit(PSI_LIMIT).alias("threshold"),
        F.col("psi_anomaly").alias("is_anomalous"),
        F.lit("CLAIM_TYPE_POPULATION").alias("peer_group"),
        "baseline_periods",
        reason.alias("anomaly_reason"),
    )


def claims_anomalies(lines: DataFrame, utilization: bool = False, **limits) -> dict[str, DataFrame]:
    """Both anomaly tables from standard claim lines.

    ``utilization`` also reports the utilization-day score, which is always
    computed but not part of the default signal set.
    """
    # A row per claim type, month and field; settled, so that the months need no shuffle to meet it.
    drift = settle(population_drift(lines, **limits))
    found = signals(peer_scores(provider_months(lines)), drift, utilization)
    return {
        "claims_anomalies": provider_anomalies(found).unionByName(population_anomalies(drift)),
        "claims_individual_metrics": provider_metrics(found, utilization).unionByName(
            population_metrics(drift)
        ),
    }
