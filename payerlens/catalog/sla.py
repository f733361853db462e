"""SLA and behaviour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, view
from payerlens.catalog.volume import claims_history, claims_tables
from payerlens.functions.clean import half_even
from payerlens.plans import pharmacy_volume as PV
from payerlens.plans import sla


def rounded(df, *columns, digits=6):
    """Round for the check; adding 0 turns a negative zero into zero."""
    return df.withColumns({c: half_even(c, digits) + F.lit(0.0) for c in columns})


LAST_RUN = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC NULLS LAST, completed_at DESC NULLS LAST, step_name DESC) AS rn
                   FROM run_log WHERE {step}) WHERE rn = 1
"""
RUN_SQL = """
    SELECT run_id, batch_id, step_name, round_even(minutes, 6) AS processing_time_minutes, sla_status, records_processed,
           round_even(100.0::DOUBLE * sum(CASE WHEN sla_status = 'MET' THEN 1 ELSE 0 END) OVER () / count(nullif(sla_status, 'N/A')) OVER (), 6) AS sla_compliance_percentage,
           CAST(sum(CASE WHEN sla_status = 'MET' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS sla_met_count,
           CAST(sum(CASE WHEN sla_status IN ('{minor}', 'BREACHED') THEN 1 ELSE 0 END) OVER () AS BIGINT) AS sla_breached_count,
           count(nullif(sla_status, 'N/A')) OVER () AS sla_evaluable_runs, {text}
    FROM (SELECT *, duration_seconds / 60 AS minutes,
                 CASE WHEN duration_seconds IS NULL THEN 'N/A' WHEN duration_seconds / 60 <= 60 THEN 'MET'
                      WHEN duration_seconds / 60 <= 63 THEN '{minor}' ELSE 'BREACHED' END AS sla_status
          FROM ({last}))
"""
CLAIM_RUN_TEXT = """
    CASE sla_status WHEN 'BREACHED' THEN printf('Claims processing exceeded the SLA by %.2f minutes, indicating a material processing delay against the configured 60.00-minute limit.', round_even(minutes - 60, 2))
      WHEN 'MINOR_OVERRUN' THEN printf('Claims processing was slightly above the SLA by %.2f minutes, indicating a minor processing delay or transient execution overhead.', round_even(minutes - 60, 2))
      WHEN 'MET' THEN 'No SLA breach detected.' ELSE 'SLA root cause cannot be determined because processing time is unavailable.' END AS root_cause,
    CASE sla_status WHEN 'BREACHED' THEN 'Investigate the affected claims-processing run for queueing delays, processing retries, data-volume spikes, failed or repeated steps, and downstream processing delays. Prioritize remediation before the next batch reaches the SLA.'
      WHEN 'MINOR_OVERRUN' THEN 'Review the run for transient queueing, execution overhead, or minor upstream/downstream delays. Monitor the next runs closely and address the source if the overrun repeats.'
      WHEN 'MET' THEN 'No immediate SLA remediation is required.' ELSE 'No SLA recommendation can be made until valid processing-time information is available.' END AS recommendation
"""
PHARMACY_RUN_TEXT = """
    CASE WHEN sla_status IN ('MINOR_BREACH', 'BREACHED') THEN
      CASE WHEN status = 'FAILED' THEN printf('Data quality property or processing step ''%s'' failed during execution.', step_name)
           WHEN sla_status = 'BREACHED' THEN 'Pharmacy processing time materially exceeded the configured SLA limit of 60 minutes.'
           ELSE 'Pharmacy processing time was slightly above the 60-minute SLA limit, within the 5% minor-breach tolerance. This indicates a small processing delay or transient execution overhead rather than a material breach.' END END AS root_cause,
    CASE WHEN sla_status IN ('MINOR_BREACH', 'BREACHED') THEN
      CASE WHEN status = 'FAILED' THEN printf('Review the failed ''%s'' validation, identify the records or fields causing the failure, correct the underlying data issue, and rerun the validation.', step_name)
           WHEN sla_status = 'BREACHED' THEN 'Investigate the affected pharmacy processing run for processing bottlenecks, queueing delays, retries, database/query performance, input-volume spikes, and slow pipeline steps. Optimize the affected step and prioritize remediation before the next batch.'
           ELSE 'Review the run for transient queueing, minor execution overhead, or small upstream/downstream delays. Monitor the next pharmacy runs and investigate further if the minor SLA overrun repeats.' END END AS recommendation
"""
RUN_COLUMNS = (
    "run_id", "batch_id", "step_name", "processing_time_minutes", "sla_status", "records_processed",
    "sla_compliance_percentage", "sla_met_count", "sla_breached_count", "sla_evaluable_runs",
    "root_cause", "recommendation",
)

view("claim_runs", RUN_SQL.format(
    minor="MINOR_OVERRUN", text=CLAIM_RUN_TEXT, last=LAST_RUN.format(step="step_name = 'run_claims_checks'")))


@query("pl10_claim_run_sla", "SELECT * FROM claim_runs")
def _(spark, sf):
    rows = sla.claim_runs(S.run_log(spark, sf)).select(*RUN_COLUMNS)
    return rounded(rows, "processing_time_minutes", "sla_compliance_percentage")


view("pharmacy_runs", RUN_SQL.format(
    minor="MINOR_BREACH", text=PHARMACY_RUN_TEXT, last=LAST_RUN.format(step="step_name = 'data_quality'")))


@query("pl11_pharmacy_run_sla", "SELECT * FROM pharmacy_runs")
def _(spark, sf):
    rows = sla.pharmacy_runs(S.run_log(spark, sf)).select(*RUN_COLUMNS)
    return rounded(rows, "processing_time_minutes", "sla_compliance_percentage")


@query(
    "fl07_wn12_step_fallback",
    f"""
    SELECT run_id, step_name, duration_seconds, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started
    FROM ({LAST_RUN.format(step="step_name LIKE '%claim%' AND duration_seconds IS NOT NULL")})
    """,
)
def _(spark, sf):
    from payerlens.operators.keyed import latest_per_key

    picked = sla.preferred_steps(S.run_log(spark, sf), "no_such_step", "claim")
    last = latest_per_key(picked, ["run_id"], ["started_at", "completed_at"])
    started = F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started")
    return last.select("run_id", "step_name", "duration_seconds", started)


view(
    "claim_periods",
    """
    SELECT period AS current_period, CAST(sum(monthly_volume) AS DOUBLE) AS total_claim_volume,
           count(DISTINCT NPI) AS provider_count, avg(volume_risk) AS average_volume_risk,
           max(volume_risk) AS maximum_volume_risk, count(NPI) AS provider_rows
    FROM rolling_history GROUP BY 1
    """,
)


def history_as_risk(spark, sf):
    return claims_history(spark, sf).withColumnsRenamed(
        {"period": "current_period", "monthly_volume": "current_month_volume"}
    )


@query("ag04_claim_period_volume", """
    SELECT * REPLACE (round_even(average_volume_risk, 6) AS average_volume_risk) FROM claim_periods""")
def _(spark, sf):
    return rounded(sla.claim_period_volume(history_as_risk(spark, sf)), "average_volume_risk")


@query(
    "ag04_latest_period_volume",
    """
    SELECT current_period, CAST(sum(current_month_volume) AS DOUBLE) AS total_claim_volume, count(DISTINCT NPI) AS provider_count,
           round_even(avg(volume_risk), 6) AS average_volume_risk, max(volume_risk) AS maximum_volume_risk, count(NPI) AS provider_rows
    FROM provider_volume_risk GROUP BY 1
    """,
)
def _(spark, sf):
    risk = claims_tables(spark, sf)["provider_volume_risk"]
    return rounded(sla.claim_period_volume(risk), "average_volume_risk")


BEHAVIOR_SQL = """
    SELECT *, CASE WHEN {base} IS NULL THEN 'N/A' WHEN dev IS NULL OR dev > 50 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS behavior_status
    FROM (SELECT *, CASE WHEN {base} = 0 AND {v} = 0 THEN 0.0::DOUBLE WHEN {base} <> 0 THEN abs({v} - {base}) / {base} * 100 END AS dev
          FROM (SELECT *, CASE WHEN count({v}) OVER w = 3 THEN avg({v}) OVER w END AS {base}
                FROM {src} WINDOW w AS (ORDER BY {t} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)))
"""
view(
    "claim_behavior",
    f"""
    SELECT current_period, total_claim_volume, provider_count, average_volume_risk, maximum_volume_risk,
      behavior_baseline_volume, dev AS behavior_deviation_pct, behavior_status,
      CASE behavior_status WHEN 'N/A' THEN 'Insufficient previous calendar months for behavior baseline.'
        WHEN 'NORMAL' THEN 'Claim volume is within the configured 50% behavior threshold.'
        ELSE printf('Claim volume %s by %.2f%% from the previous 3 calendar-month average.', CASE WHEN total_claim_volume > behavior_baseline_volume THEN 'increased' ELSE 'decreased' END, round_even(dev, 2)) END AS behavior_reason,
      CASE behavior_status WHEN 'N/A' THEN 'Behavior root cause cannot be determined because the behavior condition is not evaluable.'
        WHEN 'NORMAL' THEN 'No behavior anomaly detected.'
        ELSE printf('Claim volume %s materially from the previous 3-calendar-month baseline: current volume %.2f versus baseline %.2f, a %.2f%% deviation.', CASE WHEN total_claim_volume > behavior_baseline_volume THEN 'increased' ELSE 'decreased' END, total_claim_volume, round_even(behavior_baseline_volume, 2), round_even(dev, 2)) END AS root_cause,
      CASE WHEN behavior_status = 'N/A' THEN 'No behavior remediation can be recommended until sufficient historical data is available.'
        WHEN behavior_status = 'NORMAL' THEN 'No immediate behavior remediation required.'
        WHEN total_claim_volume > behavior_baseline_volume THEN 'Investigate the claim-volume increase against the previous 3-calendar-month baseline. Review provider concentration, source or batch changes, and recent processing activity to determine whether the increase is expected or anomalous.'
        ELSE 'Investigate the claim-volume decrease against the previous 3-calendar-month baseline. Validate missing batches, source delays, processing failures, or a genuine utilization decline.' END AS recommendation
    FROM ({BEHAVIOR_SQL.format(base='behavior_baseline_volume', v='total_claim_volume', src='claim_periods', t='current_period')})
    """,
)


@query("pl10_claim_behavior", """
    SELECT * REPLACE (round_even(average_volume_risk, 6) AS average_volume_risk, round_even(behavior_baseline_volume, 6) AS behavior_baseline_volume,
                      round_even(behavior_deviation_pct, 6) AS behavior_deviation_pct) FROM claim_behavior""")
def _(spark, sf):
    rows = sla.claim_behavior(history_as_risk(spark, sf)).drop("provider_rows")
    return rounded(
        rows, "average_volume_risk", "behavior_baseline_volume", "behavior_deviation_pct"
    )


@query("wn02_wn06_month_series", """
    SELECT current_period, total_claim_volume, round_even(behavior_baseline_volume, 6) AS baseline FROM claim_behavior""")
def _(spark, sf):
    from payerlens.operators import periods

    series = periods.fill_months(
        sla.claim_period_volume(history_as_risk(spark, sf)).select(
            "current_period", "total_claim_volume"
        ),
        [],
        "current_period",
        ["total_claim_volume"],
    )
    base = periods.previous_mean("total_claim_volume", [], "current_period", 3)
    return rounded(series.withColumn("baseline", base), "baseline")


# -- authorizations -------------------------------------------------------------

view(
    "auth_requests",
    """
    SELECT *, CASE WHEN sla_status IN ('MINOR_BREACH', 'BREACHED') THEN turnaround_hours - 72 ELSE 0.0::DOUBLE END AS excess_hours,
      CASE sla_status WHEN 'BREACHED' THEN 'critical' WHEN 'MINOR_BREACH' THEN 'warning' ELSE 'info' END AS severity,
      CASE sla_status WHEN 'BREACHED' THEN printf('Authorization turnaround exceeded the 72-hour SLA by %.2f hours.', round_even(turnaround_hours - 72, 2))
        WHEN 'MINOR_BREACH' THEN printf('Authorization turnaround was slightly above the 72-hour SLA by %.2f hours, indicating a minor processing delay or transient overhead.', round_even(turnaround_hours - 72, 2)) END AS root_cause,
      CASE sla_status WHEN 'BREACHED' THEN 'Investigate authorization processing bottlenecks, queueing delays, approval bottlenecks, manual review delays, and upstream/downstream dependencies.'
        WHEN 'MINOR_BREACH' THEN 'Review transient queueing, execution overhead, or minor approval delays. Monitor subsequent requests and investigate if the overrun repeats.' END AS recommendation,
      CASE WHEN trim(provider_id) NOT IN ('', 'nan', 'None', '<NA>') THEN trim(provider_id) END AS npi
    FROM (SELECT *, CASE WHEN turnaround_hours IS NULL OR turnaround_hours < 0 THEN 'N/A' WHEN turnaround_hours <= 72 THEN 'MET'
                         WHEN turnaround_hours <= 72 * (1 + 5.0::DOUBLE / 100) THEN 'MINOR_BREACH' ELSE 'BREACHED' END AS sla_status
          FROM (SELECT *, epoch_us(approval_date - request_date)::DOUBLE / 1000000 / 3600 AS turnaround_hours FROM authorizations))
    """,
)
view(
    "auth_npi_metrics",
    """
    SELECT npi, count(authorization_id) AS npi_total_rows,
           CAST(sum(CASE WHEN sla_status IN ('MINOR_BREACH', 'BREACHED') THEN 1 ELSE 0 END) AS BIGINT) AS npi_affected_rows,
           round_even(100.0::DOUBLE * sum(CASE WHEN sla_status IN ('MINOR_BREACH', 'BREACHED') THEN 1 ELSE 0 END) / count(authorization_id), 6) AS npi_affected_pct,
           CASE WHEN npi IS NULL THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS npi_completeness_score
    FROM auth_requests GROUP BY npi
    """,
)


@query(
    "pl12_auth_request_sla",
    """
    SELECT authorization_id, provider_id, round_even(turnaround_hours, 6) AS turnaround_hours, sla_status, round_even(excess_hours, 6) AS excess_hours,
           severity, root_cause, recommendation,
           round_even(100.0::DOUBLE * sum(CASE WHEN sla_status = 'MET' THEN 1 ELSE 0 END) OVER () / count(nullif(sla_status, 'N/A')) OVER (), 6) AS sla_compliance_percentage,
           CAST(sum(CASE WHEN sla_status = 'MET' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS sla_met_count,
           CAST(sum(CASE WHEN sla_status = 'MINOR_BREACH' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS sla_minor_breach_count,
           CAST(sum(CASE WHEN sla_status = 'BREACHED' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS sla_breached_count,
           count(nullif(sla_status, 'N/A')) OVER () AS sla_evaluable_requests
    FROM auth_requests
    """,
)
def _(spark, sf):
    rows = sla.auth_requests(S.authorizations(spark, sf)).drop(
        "bene_id", "service_code", "request_date", "approval_date", "status", "expiry_date",
        "urgency", "batch_id",
    )
    return rounded(rows, "turnaround_hours", "excess_hours", "sla_compliance_percentage")


@query("ag20_auth_provider_metrics", "SELECT *, npi_completeness_score AS npi_dimension_score FROM auth_npi_metrics")
def _(spark, sf):
    rows = sla.auth_provider_metrics(sla.auth_requests(S.authorizations(spark, sf)))
    return rounded(rows, "npi_affected_pct")


@query(
    "jn15_auth_request_with_provider",
    """
    SELECT r.authorization_id, r.npi, r.sla_status, m.npi_total_rows, m.npi_affected_rows, m.npi_affected_pct
    FROM auth_requests r LEFT JOIN auth_npi_metrics m ON r.npi IS NOT DISTINCT FROM m.npi
    """,
)
def _(spark, sf):
    rows = sla.auth_detail(sla.auth_requests(S.authorizations(spark, sf))).select(
        "authorization_id", "npi", "sla_status", "npi_total_rows", "npi_affected_rows",
        "npi_affected_pct",
    )
    return rounded(rows, "npi_affected_pct")


view(
    "auth_months",
    """
    SELECT strftime(request_date, '%Y-%m') AS request_month, count(authorization_id) AS authorization_count,
           count(DISTINCT bene_id) AS unique_beneficiaries, count(DISTINCT provider_id) AS unique_providers,
           count(DISTINCT service_code) AS unique_services,
           CAST(sum(CASE WHEN lower(trim(urgency)) = 'urgent' THEN 1 ELSE 0 END) AS BIGINT) AS urgent_count
    FROM authorizations WHERE request_date IS NOT NULL GROUP BY 1
    """,
)


@query("ag03_auth_month_counts", "SELECT * FROM auth_months")
def _(spark, sf):
    return sla.auth_months(S.authorizations(spark, sf))


@query(
    "pl12_auth_behavior",
    f"""
    SELECT request_month, authorization_count, unique_beneficiaries, unique_providers, unique_services, urgent_count,
      round_even(behavior_baseline_volume, 6) AS behavior_baseline_volume, round_even(dev, 6) AS behavior_deviation_pct, behavior_status,
      CASE behavior_status WHEN 'N/A' THEN 'Insufficient previous calendar months for behavior baseline.'
        WHEN 'NORMAL' THEN 'Authorization volume is within the configured 50% behavior threshold.'
        ELSE printf('Authorization volume %s by %.2f%% from the previous 3-month average.', CASE WHEN authorization_count > behavior_baseline_volume THEN 'increased' ELSE 'decreased' END, round_even(dev, 2)) END AS behavior_reason,
      CASE WHEN behavior_status = 'ANOMALOUS' THEN printf('Authorization volume %s materially from the previous 3-month baseline: current volume=%d, baseline=%.2f, deviation=%.2f%%.', CASE WHEN authorization_count > behavior_baseline_volume THEN 'increased' ELSE 'decreased' END, authorization_count, round_even(behavior_baseline_volume, 2), round_even(dev, 2)) END AS root_cause,
      CASE WHEN behavior_status = 'ANOMALOUS' THEN CASE WHEN authorization_count > behavior_baseline_volume
        THEN 'Investigate the authorization-volume increase against the previous 3-month baseline. Review provider concentration, service-code changes, urgent requests, and source or batch changes.'
        ELSE 'Investigate the authorization-volume decrease against the previous 3-month baseline. Validate missing batches, source delays, ingestion problems, or a genuine utilization decline.' END END AS recommendation
    FROM ({BEHAVIOR_SQL.format(base='behavior_baseline_volume', v='authorization_count', src='auth_months', t='request_month')})
    """,
)
def _(spark, sf):
    rows = sla.auth_behavior(S.authorizations(spark, sf))
    return rounded(rows, "behavior_baseline_volume", "behavior_deviation_pct")


@query(
    "pl12_auth_run_summary",
    """
    SELECT count(*) AS total_records, count(*) FILTER (sla_status = 'MET') AS passed_records,
           count(*) FILTER (sla_status IN ('MINOR_BREACH', 'BREACHED')) AS failed_records,
           count(*) FILTER (sla_status = 'BREACHED') AS critical_count, count(*) FILTER (sla_status = 'MINOR_BREACH') AS warning_count,
           'BREACHED' AS overall_status, 'critical' AS severity,
           printf('Authorization SLA compliance: %.2f%%', round_even(100.0::DOUBLE * count(*) FILTER (sla_status = 'MET') / count(nullif(sla_status, 'N/A')), 2)) AS message,
           (SELECT root_cause FROM auth_requests WHERE sla_status = 'BREACHED' ORDER BY request_date NULLS FIRST, authorization_id NULLS FIRST LIMIT 1) AS root_cause,
           (SELECT recommendation FROM auth_requests WHERE sla_status = 'BREACHED' LIMIT 1) AS recommendation,
           round_even(100.0::DOUBLE * count(provider_id) / count(*), 6) AS npi_completeness_score
    FROM auth_requests
    """,
)
def _(spark, sf):
    rows = sla.auth_run_summary(sla.auth_requests(S.authorizations(spark, sf)))
    return rounded(rows, "npi_completeness_score")


@query(
    "fn38_provider_json_per_batch",
    """
    SELECT batch_id, CAST(to_json(list_sort(list(DISTINCT npi) FILTER (npi IS NOT NULL))) AS VARCHAR) AS providers
    FROM auth_requests GROUP BY batch_id
    """,
)
def _(spark, sf):
    return sla.auth_provider_list(S.authorizations(spark, sf))


# -- pharmacy years -----------------------------------------------------------


@query(
    "pl11_pharmacy_behavior",
    f"""
    SELECT calendar_year, CAST(total_claims AS DOUBLE) AS total_claims, round_even(behavior_baseline_claims, 6) AS behavior_baseline_claims,
           round_even(dev, 6) AS behavior_deviation_pct, behavior_status,
           CASE behavior_status WHEN 'N/A' THEN 'Insufficient previous calendar years for behavior baseline.'
             WHEN 'NORMAL' THEN 'Annual claim volume is within the configured 50% behavior threshold.'
             ELSE printf('Annual claim volume %s by %.2f%% from the previous 3-year average.', CASE WHEN total_claims > behavior_baseline_claims THEN 'increased' ELSE 'decreased' END, round_even(dev, 2)) END AS behavior_reason,
           CASE WHEN behavior_status = 'ANOMALOUS' THEN printf('Annual pharmacy claim volume deviated significantly from the previous 3-calendar-year baseline. Reason: Annual claim volume %s by %.2f%% from the previous 3-year average.', CASE WHEN total_claims > behavior_baseline_claims THEN 'increased' ELSE 'decreased' END, round_even(dev, 2))
             ELSE 'No SLA, data-quality, or behavior failure detected.' END AS root_cause
    FROM ({BEHAVIOR_SQL.format(base='behavior_baseline_claims', v='total_claims', src='grand_totals', t='calendar_year')})
    """,
)
def _(spark, sf):
    rows = sla.pharmacy_behavior(PV.annual_risk(S.grand_totals(spark, sf))).select(
        "calendar_year", "total_claims", "behavior_baseline_claims", "behavior_deviation_pct",
        "behavior_status", "behavior_reason", "root_cause",
    )
    return rounded(rows, "behavior_baseline_claims", "behavior_deviation_pct")
