"""Explanation texts stored with results.

Users filter and group by these texts, so they are kept word for word, in the
order of the conditions that choose them. ``{}`` marks a value filled in.
"""

# Claims provider volume, by risk level.
VOLUME_ROOT_CAUSE = {
    "INSUFFICIENT_HISTORY": "Insufficient historical monthly data is available to calculate a reliable rolling baseline.",
    "CRITICAL": "Current provider claim volume shows a critical deviation from the previous 6-month historical baseline.",
    "HIGH": "Current provider claim volume has a high deviation from the previous 6-month historical baseline.",
    "MEDIUM": "Current provider claim volume shows a moderate deviation from the historical baseline.",
    "MODERATE": "Current provider claim volume shows a small deviation from the historical baseline.",
    "LOW": "Current provider claim volume is within the expected historical range.",
    "UNKNOWN": "The volume-risk level could not be determined from the available data.",
}
VOLUME_RECOMMENDATION = {
    "CRITICAL": "Investigate the provider's current claim volume immediately. Check for abnormal claim activity, duplicate claims, missing or incorrectly loaded data, source-system changes, and sudden operational changes.",
    "HIGH": "Review the provider's recent claim volume and compare it with source-system records. Investigate unusual volume changes, duplicate records, missing records, and changes in provider activity.",
    "MEDIUM": "Monitor the provider's claim volume and review the underlying source data if the deviation continues or increases.",
    "MODERATE": "Continue monitoring the provider's monthly volume. No immediate corrective action is required unless the deviation continues to increase.",
    "LOW": "No corrective action is required. Continue routine monitoring of provider claim volume.",
    "UNKNOWN": "Review the provider volume and baseline fields and verify that the risk calculation completed correctly.",
}
VOLUME_HISTORY_RECOMMENDATION = "Continue collecting provider volume data until at least 6 historical months are available. Current history: {} months."
VOLUME_DEVIATION_CLAUSE = " The deviation is {}%."
VOLUME_LEVEL_CLAUSE = " Current volume is {} claims against a baseline of {}."
VOLUME_NO_ISSUE = (
    "No volume-risk or validation failure was detected.",
    "No corrective action required. Continue routine monitoring.",
)
VOLUME_SUMMARY_TEXT = (
    "Dataset-level volume summary. No individual provider volume-risk failure is represented in this table.",
    "Use provider_volume_risk and provider_volume_rolling_history for provider-level investigation and corrective action.",
)

# Authorization provider volume.
AUTH_VOLUME_ROOT_CAUSE = {
    "INSUFFICIENT_HISTORY": "Insufficient historical monthly authorization data is available for this provider to establish a reliable volume baseline.",
    "LOW_VOLUME": "Provider {} has a low historical authorization baseline of {} records. Percentage deviations at this volume can be misleading and are therefore treated as low-volume signals rather than material risk.",
    "DEVIATING": "Provider {} authorization volume has {} compared with the previous 3-month baseline. Current volume={}, baseline={}, deviation={}%.",
    "NORMAL": "Provider {} authorization volume is within the expected historical range.",
}
AUTH_VOLUME_RECOMMENDATION = {
    "INSUFFICIENT_HISTORY": "Continue collecting authorization history for provider {} until at least 3 previous calendar months are available.",
    "LOW_VOLUME": "Continue monitoring provider {}. Collect additional monthly history before treating percentage changes in this low-volume provider as a significant operational risk.",
    "CRITICAL_UP": "Immediately review the increase in authorization activity for provider {}. Check for unusual service-code activity, urgent requests, duplicate records, batch changes, or source-system changes.",
    "CRITICAL_DOWN": "Investigate the significant decrease in authorization activity for provider {}. Validate missing records, incomplete batches, source delays, or ingestion failures.",
    "HIGH": "Review provider {}'s recent authorization activity against historical behavior and check for source, batch, service-code, and urgency changes.",
    "MODERATE": "Continue monitoring provider {}'s authorization volume and investigate if the deviation continues in subsequent months.",
    "NORMAL": "No corrective action is required for provider {}. Continue routine monitoring.",
}
AUTH_VOLUME_DEFAULT = (
    "No volume-risk issue was identified.",
    "Continue routine provider-level monitoring.",
)

# Claims run SLA and behaviour.
CLAIM_SLA_ROOT_CAUSE = {
    "BREACHED": "Claims processing exceeded the SLA by {} minutes, indicating a material processing delay against the configured {}-minute limit.",
    "MINOR_OVERRUN": "Claims processing was slightly above the SLA by {} minutes, indicating a minor processing delay or transient execution overhead.",
    "MET": "No SLA breach detected.",
    "N/A": "SLA root cause cannot be determined because processing time is unavailable.",
}
CLAIM_SLA_RECOMMENDATION = {
    "BREACHED": "Investigate the affected claims-processing run for queueing delays, processing retries, data-volume spikes, failed or repeated steps, and downstream processing delays. Prioritize remediation before the next batch reaches the SLA.",
    "MINOR_OVERRUN": "Review the run for transient queueing, execution overhead, or minor upstream/downstream delays. Monitor the next runs closely and address the source if the overrun repeats.",
    "MET": "No immediate SLA remediation is required.",
    "N/A": "No SLA recommendation can be made until valid processing-time information is available.",
}
BEHAVIOR_REASONS = {
    "CLAIM": {
        "short": "Insufficient previous calendar months for behavior baseline.",
        "zero": "Current and previous 3 calendar months have zero claim volume.",
        "from_zero": "Current claim volume is positive while the previous 3 calendar-month baseline is zero.",
        "changed": "Claim volume {} by {}% from the previous 3 calendar-month average.",
        "normal": "Claim volume is within the configured 50% behavior threshold.",
    },
    "AUTH": {
        "short": "Insufficient previous calendar months for behavior baseline.",
        "zero": "Current and previous 3 calendar months have zero authorization volume.",
        "from_zero": "Current authorization volume is positive while the previous 3-calendar-month baseline is zero.",
        "changed": "Authorization volume {} by {}% from the previous 3-month average.",
        "normal": "Authorization volume is within the configured 50% behavior threshold.",
    },
    "PHARMACY": {
        "short": "Insufficient previous calendar years for behavior baseline.",
        "zero": "Current and previous 3 calendar years have zero claim volume.",
        "from_zero": "Current claim volume is positive while the previous 3-calendar-year baseline is zero.",
        "changed": "Annual claim volume {} by {}% from the previous 3-year average.",
        "normal": "Annual claim volume is within the configured 50% behavior threshold.",
    },
}
CLAIM_BEHAVIOR = {
    "root_cause": "Claim volume {} materially from the previous 3-calendar-month baseline: current volume {} versus baseline {}, a {}% deviation.",
    "up": "Investigate the claim-volume increase against the previous 3-calendar-month baseline. Review provider concentration, source or batch changes, and recent processing activity to determine whether the increase is expected or anomalous.",
    "down": "Investigate the claim-volume decrease against the previous 3-calendar-month baseline. Validate missing batches, source delays, processing failures, or a genuine utilization decline.",
    "normal_cause": "No behavior anomaly detected.",
    "normal_action": "No immediate behavior remediation required.",
    "na_cause": "Behavior root cause cannot be determined because the behavior condition is not evaluable.",
    "na_action": "No behavior remediation can be recommended until sufficient historical data is available.",
}

# Authorization SLA and behaviour.
AUTH_SLA_ROOT_CAUSE = {
    "BREACHED": "Authorization turnaround exceeded the 72-hour SLA by {} hours.",
    "MINOR_BREACH": "Authorization turnaround was slightly above the 72-hour SLA by {} hours, indicating a minor processing delay or transient overhead.",
}
AUTH_SLA_RECOMMENDATION = {
    "BREACHED": "Investigate authorization processing bottlenecks, queueing delays, approval bottlenecks, manual review delays, and upstream/downstream dependencies.",
    "MINOR_BREACH": "Review transient queueing, execution overhead, or minor approval delays. Monitor subsequent requests and investigate if the overrun repeats.",
}
AUTH_BEHAVIOR = {
    "root_cause": "Authorization volume {} materially from the previous 3-month baseline: current volume={}, baseline={}, deviation={}%.",
    "up": "Investigate the authorization-volume increase against the previous 3-month baseline. Review provider concentration, service-code changes, urgent requests, and source or batch changes.",
    "down": "Investigate the authorization-volume decrease against the previous 3-month baseline. Validate missing batches, source delays, ingestion problems, or a genuine utilization decline.",
}

# Pharmacy SLA and behaviour: (root cause, recommendation) by priority.
PHARMACY_FAILED = (
    "Data quality property or processing step '{}' failed during execution.",
    "Review the failed '{}' validation, identify the records or fields causing the failure, correct the underlying data issue, and rerun the validation.",
)
PHARMACY_BREACHED = (
    "Pharmacy processing time materially exceeded the configured SLA limit of 60 minutes.",
    "Investigate the affected pharmacy processing run for processing bottlenecks, queueing delays, retries, database/query performance, input-volume spikes, and slow pipeline steps. Optimize the affected step and prioritize remediation before the next batch.",
)
PHARMACY_MINOR = (
    "Pharmacy processing time was slightly above the 60-minute SLA limit, within the 5% minor-breach tolerance. This indicates a small processing delay or transient execution overhead rather than a material breach.",
    "Review the run for transient queueing, minor execution overhead, or small upstream/downstream delays. Monitor the next pharmacy runs and investigate further if the minor SLA overrun repeats.",
)
PHARMACY_ANOMALOUS = (
    "Annual pharmacy claim volume deviated significantly from the previous 3-calendar-year baseline. Reason: {}",
    "Investigate the change in claim volume by checking incoming data volume, missing records, duplicated records, source-system changes, and unusual pharmacy activity.",
)
PHARMACY_NONE = (
    "No SLA, data-quality, or behavior failure detected.",
    "No corrective action required.",
)

# Pharmacy volume risk.
OVERALL_DRIVERS = (
    ("Claims Volume", "total_claims_risk"),
    ("Standardized 30-Day Fills", "total_standardized_30_day_fills_risk"),
    ("Beneficiary Volume", "total_beneficiaries_risk"),
    ("Prescriber Volume", "total_prescribers_risk"),
)
OVERALL_TEXT = {
    "missing_cause": "Insufficient historical data to determine the root cause of volume risk.",
    "high": "{} is the primary root cause of the elevated volume risk (component risk score: {}).",
    "medium": "{} is the main contributing factor to the volume risk (component risk score: {}).",
    "none": "No individual volume component shows a materially elevated risk.",
    "missing_action": "Obtain sufficient historical data before performing volume-risk assessment.",
    "act_75": "Perform priority utilization review. Validate the elevated claims, fills, beneficiary and prescriber volumes against the 3-year historical baseline and investigate the main contributing component.",
    "act_50": "Review the elevated volume component against the 3-year historical baseline and monitor whether the increase persists.",
    "act": "Continue routine monitoring against the historical baseline.",
}
PEER_DRIVERS = (
    ("Claims Volume", "claims_percentile"),
    ("30-Day Fill Volume", "fills_percentile"),
    ("Day Supply Volume", "day_supply_percentile"),
    ("Beneficiary Volume", "beneficiary_percentile"),
)
NPI_TEXT = {
    "missing_cause": "NPI volume risk could not be determined.",
    "p95": "{} is the primary root cause. The NPI is at the {}th peer percentile for this measure.",
    "p90": "{} is the main contributing factor, with the NPI at the {}th peer percentile.",
    "p75": "{} is elevated relative to the NPI peer group ({}th percentile).",
    "none": "No individual NPI volume component is materially elevated.",
    "missing_action": "Insufficient peer data. Continue monitoring until a reliable peer comparison is available.",
    "act_75": "Perform priority provider-level utilization review. Validate the NPI's claims, fills, day supply and beneficiary volume against peer providers and drill down into the highest-volume drugs.",
    "act_50": "Review provider utilization against peer benchmarks and investigate the main elevated volume component.",
    "act": "Continue peer-level monitoring.",
}
DRUG_TEXT = {
    "missing_cause": "Drug volume risk could not be determined.",
    "p95": "{} is the primary root cause of the elevated drug volume risk, with the drug at the {}th peer percentile.",
    "p90": "{} is the main contributing factor, with the drug at the {}th peer percentile.",
    "p75": "{} is elevated relative to the drug peer group ({}th percentile).",
    "none": "No individual drug volume component is materially elevated.",
    "missing_action": "Continue monitoring until sufficient peer comparison data is available.",
    "act_75": "Perform targeted drug utilization review. Examine prescriber concentration, beneficiary distribution, claims and day supply to determine whether the elevated peer-relative volume is justified.",
    "act_50": "Review the drug's utilization distribution across prescribers and beneficiaries and monitor for sustained elevated volume.",
    "act": "Continue routine monitoring against the current drug peer baseline.",
}
DETAIL_TEXT = {
    "none_cause": "No measurable claim-volume contribution.",
    "none_action": "No immediate action required.",
    "cause": "This NPI-drug combination contributes to the provider's pharmacy utilization volume.",
    "action": "Review this NPI-drug combination when the associated NPI or drug volume risk is elevated.",
}

# Claim provider risk.
CLAIM_RISK_DRIVERS = (
    ("Data Quality", "weighted_dq_risk"),
    ("Volume", "weighted_volume_risk"),
    ("Robust Z", "weighted_robust_z_risk"),
    ("PSI", "weighted_psi_risk"),
    ("Arrival Delay", "weighted_arrival_delay_risk"),
)
CLAIM_RISK_COMPONENTS = (
    ("data quality", "dq_risk"),
    ("claim volume", "volume_risk"),
    ("provider anomalies", "robust_z_risk"),
    ("population drift", "psi_risk"),
    ("arrival delay", "arrival_delay_risk"),
)
CLAIM_RISK_TEXT = {
    "cause": "Primary risk driver: {}; secondary risk driver: {}.",
    "missing": "Insufficient data for a reliable SLA risk recommendation.",
    "no_driver": "No major risk driver detected. Continue routine monitoring.",
    "act_75": "Immediate investigation required for {}. Prioritize corrective action.",
    "act_50": "Investigate {} and closely monitor the provider.",
    "act_25": "Monitor {} during the next processing cycle.",
    "act": "Continue routine monitoring.",
}

# Claims data quality: first pattern found in the rule name decides.
RULE_TEXT = (
    ("invalid_npi", ("The provider NPI does not follow the expected format or reference validation.", "Validate the NPI format and verify it against the approved provider reference data.")),
    ("npi", ("The provider NPI failed the configured provider-identification validation.", "Validate the NPI format and cross-check it against the provider reference data.")),
    ("bene_id", ("The beneficiary identifier is missing, duplicated, or cannot be linked to the enrollment master.", "Validate BENE_ID for completeness and uniqueness and cross-check it against the enrollment master.")),
    ("duplicate", ("The affected claim or beneficiary key appears more than once in the source data.", "Apply duplicate-key validation during ingestion and quarantine or reconcile duplicate records.")),
    ("diag_code", ("The diagnosis code is missing, malformed, or outside the expected ICD coding standard.", "Validate diagnosis codes against the appropriate ICD reference set and correct invalid values.")),
    ("icd", ("The diagnosis value does not satisfy the configured ICD format, version, or completeness rule.", "Validate the diagnosis code against the applicable ICD version and reference data.")),
    ("hcpcs", ("The HCPCS procedure or service code is missing or does not conform to the expected format.", "Validate HCPCS completeness and format against the approved HCPCS reference set before processing.")),
    ("negative", ("A numeric or monetary field contains an unexpected negative value.", "Validate the allowed numeric range and review or correct records containing unexpected negative values.")),
    ("payment", ("The claim payment value is inconsistent with another claim financial field.", "Reconcile payment, charge, and related financial fields before payment or downstream processing.")),
    ("amount", ("A claim amount failed the configured financial consistency or plausibility check.", "Reconcile the affected financial fields and validate amount ranges before payment processing.")),
    ("utilization", ("The utilization or length-of-stay value falls outside the configured plausible range.", "Validate utilization values against the expected range and review outliers before processing.")),
    ("state_code", ("The state code does not conform to the expected standard or approved value set.", "Validate the state code against the approved state-code reference values.")),
    ("state", ("The state value does not conform to the configured state-code standard.", "Validate the state value against the approved state-code reference set.")),
    ("sex", ("The beneficiary sex value is outside the configured approved code set.", "Validate the sex code against the approved beneficiary code set and correct invalid values.")),
    ("date", ("A date value is missing, malformed, out of range, or inconsistent with a related date.", "Standardize date formats and validate chronological relationships before downstream processing.")),
    ("age", ("The beneficiary age or related demographic value falls outside the configured plausible range.", "Validate age against the beneficiary birth date and correct inconsistent demographic information.")),
    ("missing", ("A required data value is missing from the affected field.", "Make the field mandatory during ingestion, validate it before downstream processing, and route incomplete records for correction.")),
    ("conformance", ("One or more values do not conform to the required data standard.", "Standardize the affected field against the approved format, code set, or reference standard.")),
)
DIMENSION_TEXT = {
    "Completeness": ("A required data field is missing or incomplete.", "Validate mandatory fields during ingestion and route incomplete records for correction."),
    "Correctness": ("A data value does not satisfy the expected format, code set, or business validation rule.", "Validate the affected field against the appropriate format, code set, or reference data."),
    "Referential Integrity": ("A claim or beneficiary reference cannot be correctly linked to its corresponding master data.", "Validate the relationship against the corresponding master/reference table and correct unmatched records."),
    "Plausibility": ("A value falls outside the configured logical or plausible range.", "Review the affected value and apply range validation during ingestion."),
    "Internal Consistency": ("Related fields within the record contain inconsistent values.", "Reconcile the related fields and validate their business relationship before downstream processing."),
    "Conformance": ("A value does not conform to the required data standard.", "Standardize the affected value against the approved format or reference standard."),
}
RULE_DEFAULT = (
    "A configured data-quality rule has failed.",
    "Review and correct the affected records before downstream processing.",
)
AUTH_CLEAN = ("No DQ Issues", "No data quality issue detected", "No action required")
