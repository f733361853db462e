"""Volume queries: claims and authorizations."""

from __future__ import annotations

from pyspark.sql import functions as F

from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, view
from payerlens.functions.clean import half_even
from payerlens.operators import periods
from payerlens.plans import volume as V

view(
    "valid_claims",
    """
    SELECT source, NPI, CLM_ID, DT, strftime(DT, '%Y-%m') AS period FROM (
      SELECT *, row_number() OVER (PARTITION BY source, CLM_ID ORDER BY DT, NPI) AS rn FROM claim_lines
      WHERE NPI IS NOT NULL AND NPI NOT IN ('', '0', 'nan', 'None') AND DT IS NOT NULL)
    WHERE rn = 1
    """,
)
view(
    "monthly_volume",
    "SELECT NPI, period, count(*) AS monthly_volume FROM valid_claims GROUP BY NPI, period",
)
view(
    "filled_volume",
    """
    SELECT g.NPI, strftime(g.m, '%Y-%m') AS period, coalesce(v.monthly_volume, 0) AS monthly_volume
    FROM (SELECT NPI, unnest(generate_series(min(strptime(period || '-01', '%Y-%m-%d')),
                 max(strptime(period || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)) AS m
          FROM monthly_volume GROUP BY NPI) g
    LEFT JOIN monthly_volume v ON v.NPI = g.NPI AND v.period = strftime(g.m, '%Y-%m')
    """,
)
view(
    "rolling_history",
    """
    SELECT NPI, period, monthly_volume, round_even(base, 2) AS baseline_volume,
           CASE WHEN base IS NULL THEN 'INSUFFICIENT_HISTORY' ELSE 'ROLLING_6_MONTH_MEDIAN' END AS baseline_method,
           CASE WHEN history_months = 6 THEN labels END AS baseline_periods,
           round_even(dev, 2) AS deviation_pct, volume_risk, history_months,
           CASE WHEN volume_risk IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN volume_risk = 0.0 THEN 'LOW'
                WHEN volume_risk = 0.2 THEN 'MODERATE' WHEN volume_risk = 0.5 THEN 'MEDIUM'
                WHEN volume_risk = 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
    FROM (SELECT *, CASE WHEN dev IS NULL THEN NULL WHEN dev <= 5 THEN 0.0::DOUBLE WHEN dev <= 10 THEN 0.2::DOUBLE
                 WHEN dev <= 20 THEN 0.5::DOUBLE WHEN dev <= 30 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS volume_risk
          FROM (SELECT *, CASE WHEN base > 0 THEN abs(monthly_volume - base) / base * 100 END AS dev
                FROM (SELECT NPI, period, monthly_volume, count(monthly_volume) OVER w AS history_months,
                             CASE WHEN count(monthly_volume) OVER w = 6 THEN median(monthly_volume::DOUBLE) OVER w END AS base,
                             string_agg(period, ', ') OVER w AS labels
                      FROM filled_volume WINDOW w AS (PARTITION BY NPI ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))))
    """,
)
VOLUME_TEXT = """
    CASE risk_level
      WHEN 'INSUFFICIENT_HISTORY' THEN 'Insufficient historical monthly data is available to calculate a reliable rolling baseline.'
      WHEN 'CRITICAL' THEN 'Current provider claim volume shows a critical deviation from the previous 6-month historical baseline.'
        || printf(' The deviation is %.2f%%.', deviation_pct) || printf(' Current volume is %d claims against a baseline of %.2f.', {v}, baseline_volume)
      WHEN 'HIGH' THEN 'Current provider claim volume has a high deviation from the previous 6-month historical baseline.'
        || printf(' The deviation is %.2f%%.', deviation_pct) || printf(' Current volume is %d claims against a baseline of %.2f.', {v}, baseline_volume)
      WHEN 'MEDIUM' THEN 'Current provider claim volume shows a moderate deviation from the historical baseline.'
        || printf(' The deviation is %.2f%%.', deviation_pct) || printf(' Current volume is %d claims against a baseline of %.2f.', {v}, baseline_volume)
      WHEN 'MODERATE' THEN 'Current provider claim volume shows a small deviation from the historical baseline.'
        || printf(' The deviation is %.2f%%.', deviation_pct)
      ELSE 'Current provider claim volume is within the expected historical range.' END AS root_cause,
    CASE risk_level
      WHEN 'INSUFFICIENT_HISTORY' THEN printf('Continue collecting provider volume data until at least 6 historical months are available. Current history: %d months.', history_months)
      WHEN 'CRITICAL' THEN 'Investigate the provider''s current claim volume immediately. Check for abnormal claim activity, duplicate claims, missing or incorrectly loaded data, source-system changes, and sudden operational changes.'
      WHEN 'HIGH' THEN 'Review the provider''s recent claim volume and compare it with source-system records. Investigate unusual volume changes, duplicate records, missing records, and changes in provider activity.'
      WHEN 'MEDIUM' THEN 'Monitor the provider''s claim volume and review the underlying source data if the deviation continues or increases.'
      WHEN 'MODERATE' THEN 'Continue monitoring the provider''s monthly volume. No immediate corrective action is required unless the deviation continues to increase.'
      ELSE 'No corrective action is required. Continue routine monitoring of provider claim volume.' END AS recommendation
"""
view(
    "provider_volume_risk",
    f"""
    SELECT *, {VOLUME_TEXT.format(v='current_month_volume')} FROM (
      SELECT h.NPI, h.period AS current_period, h.monthly_volume AS current_month_volume, baseline_volume,
             baseline_method, baseline_periods, deviation_pct, volume_risk, risk_level, history_months,
             t.total_claim_volume, s.source_count, s.sources, t.months_available
      FROM rolling_history h
      JOIN (SELECT NPI, max(period) AS last_period, CAST(sum(monthly_volume) AS BIGINT) AS total_claim_volume,
                   count(DISTINCT period) AS months_available FROM rolling_history GROUP BY NPI) t
        ON t.NPI = h.NPI AND t.last_period = h.period
      JOIN (SELECT NPI, count(DISTINCT source) AS source_count,
                   string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM valid_claims GROUP BY NPI) s
        ON s.NPI = h.NPI)
    """,
)


def claims_tables(spark, sf):
    return V.claims_volume(S.claim_lines(spark, sf))


def claims_history(spark, sf):
    return V.rolling_history(V.monthly_volume(V.valid_claims(S.claim_lines(spark, sf))))


@query("pl04_provider_volume_risk", "SELECT * FROM provider_volume_risk")
def _(spark, sf):
    risk = claims_tables(spark, sf)["provider_volume_risk"]
    return risk.withColumn("source_count", F.col("source_count").cast("bigint"))


@query("pl04_rolling_history", f"SELECT *, {VOLUME_TEXT.format(v='monthly_volume')} FROM rolling_history")
def _(spark, sf):
    return claims_tables(spark, sf)["provider_volume_rolling_history"]


@query(
    "pl04_combined_claims",
    "SELECT source, NPI, CLM_ID, strftime(DT, '%Y-%m-%d') AS service_day, period FROM valid_claims",
)
def _(spark, sf):
    valid = V.valid_claims(S.claim_lines(spark, sf))
    return valid.select(
        "source", "NPI", "CLM_ID", F.date_format("DT", "yyyy-MM-dd").alias("service_day"), "period"
    )


@query(
    "ag24_source_summary",
    """
    SELECT l.source, rows_loaded, valid_claims, unique_providers, months FROM
      (SELECT source, count(*) AS rows_loaded FROM claim_lines GROUP BY source) l
      JOIN (SELECT source, count(*) AS valid_claims, count(DISTINCT NPI) AS unique_providers,
                   count(DISTINCT period) AS months FROM valid_claims GROUP BY source) v USING (source)
    """,
)
def _(spark, sf):
    t = claims_tables(spark, sf)["volume_dataset_summary"]
    return t.drop("root_cause", "recommendation")


@query("ag01_provider_month_volume", "SELECT * FROM monthly_volume")
def _(spark, sf):
    return V.monthly_volume(V.valid_claims(S.claim_lines(spark, sf))).drop("month_sources")


@query("wn01_calendar_fill", "SELECT * FROM filled_volume")
def _(spark, sf):
    monthly = V.monthly_volume(V.valid_claims(S.claim_lines(spark, sf))).drop("month_sources")
    return periods.fill_months(monthly, ["NPI"], "period", ["monthly_volume"])


@query(
    "wn03_wn04_previous_median",
    """
    SELECT NPI, period, count(monthly_volume) OVER w AS history,
           CASE WHEN count(monthly_volume) OVER w = 6 THEN median(monthly_volume::DOUBLE) OVER w END AS baseline
    FROM filled_volume WINDOW w AS (PARTITION BY NPI ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
    """,
)
def _(spark, sf):
    monthly = V.monthly_volume(V.valid_claims(S.claim_lines(spark, sf))).drop("month_sources")
    filled = periods.fill_months(monthly, ["NPI"], "period", ["monthly_volume"])
    args = ("monthly_volume", ["NPI"], "period", 6)
    return filled.select(
        "NPI",
        "period",
        periods.previous_count(*args).alias("history"),
        periods.previous_median(*args).alias("baseline"),
    )


@query(
    "ag22_ag23_sources_per_provider",
    """
    SELECT NPI, count(DISTINCT source) AS source_count, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources,
           count(DISTINCT period) AS active_months, count(*) AS claims
    FROM valid_claims GROUP BY NPI
    """,
)
def _(spark, sf):
    monthly = V.monthly_volume(V.valid_claims(S.claim_lines(spark, sf)))
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_list("month_sources"))))
    return monthly.groupBy("NPI").agg(
        F.size(listed).cast("bigint").alias("source_count"),
        F.array_join(listed, ", ").alias("sources"),
        F.count("period").alias("active_months"),
        F.sum("monthly_volume").alias("claims"),
    )


# -- authorizations -------------------------------------------------------------

view(
    "auth_monthly",
    """
    SELECT NPI, period, count(authorization_id) AS monthly_volume FROM (
      SELECT regexp_replace(trim(provider_id), '\\.0$', '') AS NPI, strftime(request_date, '%Y-%m') AS period, authorization_id
      FROM authorizations WHERE request_date IS NOT NULL)
    WHERE NPI IS NOT NULL AND NPI <> '' GROUP BY NPI, period
    """,
)
view(
    "auth_filled",
    """
    SELECT g.NPI, strftime(g.m, '%Y-%m') AS period, coalesce(v.monthly_volume, 0) AS monthly_volume
    FROM (SELECT NPI, unnest(generate_series(min(strptime(period || '-01', '%Y-%m-%d')),
                 max(strptime(period || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)) AS m
          FROM auth_monthly GROUP BY NPI) g
    LEFT JOIN auth_monthly v ON v.NPI = g.NPI AND v.period = strftime(g.m, '%Y-%m')
    """,
)
view(
    "auth_volume_risk",
    """
    SELECT *, CASE WHEN volume_risk IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN baseline_volume = 0 THEN 'LOW'
                   WHEN baseline_volume < 5 THEN 'LOW_VOLUME' WHEN volume_risk < 0.25 THEN 'LOW'
                   WHEN volume_risk < 0.5 THEN 'MODERATE' WHEN volume_risk < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
    FROM (SELECT *, CASE WHEN deviation_pct IS NOT NULL THEN least(deviation_pct / 100, 1.0::DOUBLE) END AS volume_risk
      FROM (SELECT *, CASE WHEN baseline_volume = 0 AND current_month_volume = 0 THEN 0.0::DOUBLE
                           WHEN baseline_volume > 0 THEN abs(current_month_volume - baseline_volume) / baseline_volume * 100 END AS deviation_pct
        FROM (SELECT NPI, period AS current_period, monthly_volume AS current_month_volume,
                     CASE WHEN count(monthly_volume) OVER w = 3 THEN median(monthly_volume::DOUBLE) OVER w END AS baseline_volume,
                     CASE WHEN count(monthly_volume) OVER w = 3 THEN 'ROLLING_3_MONTH_MEDIAN' ELSE 'INSUFFICIENT_HISTORY' END AS baseline_method,
                     CASE WHEN count(monthly_volume) OVER w = 3 THEN string_agg(period, ',') OVER w ELSE '' END AS baseline_periods,
                     count(monthly_volume) OVER w AS history_months
              FROM auth_filled WINDOW w AS (PARTITION BY NPI ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))))
    """,
)
view(
    "auth_volume_explained",
    """
    SELECT *,
      CASE WHEN risk_level = 'INSUFFICIENT_HISTORY' THEN 'Insufficient historical monthly authorization data is available for this provider to establish a reliable volume baseline.'
           WHEN risk_level = 'LOW_VOLUME' THEN printf('Provider %s has a low historical authorization baseline of %.0f records. Percentage deviations at this volume can be misleading and are therefore treated as low-volume signals rather than material risk.', NPI, baseline_volume)
           WHEN risk_level IN ('CRITICAL', 'HIGH', 'MODERATE') THEN printf('Provider %s authorization volume has %s compared with the previous 3-month baseline. Current volume=%d, baseline=%.2f, deviation=%.2f%%.', NPI, CASE WHEN current_month_volume > baseline_volume THEN 'increased' ELSE 'decreased' END, current_month_volume, baseline_volume, deviation_pct)
           ELSE printf('Provider %s authorization volume is within the expected historical range.', NPI) END AS root_cause,
      CASE WHEN risk_level = 'INSUFFICIENT_HISTORY' THEN printf('Continue collecting authorization history for provider %s until at least 3 previous calendar months are available.', NPI)
           WHEN risk_level = 'LOW_VOLUME' THEN printf('Continue monitoring provider %s. Collect additional monthly history before treating percentage changes in this low-volume provider as a significant operational risk.', NPI)
           WHEN risk_level = 'CRITICAL' AND current_month_volume > baseline_volume THEN printf('Immediately review the increase in authorization activity for provider %s. Check for unusual service-code activity, urgent requests, duplicate records, batch changes, or source-system changes.', NPI)
           WHEN risk_level = 'CRITICAL' THEN printf('Investigate the significant decrease in authorization activity for provider %s. Validate missing records, incomplete batches, source delays, or ingestion failures.', NPI)
           WHEN risk_level = 'HIGH' THEN printf('Review provider %s''s recent authorization activity against historical behavior and check for source, batch, service-code, and urgency changes.', NPI)
           WHEN risk_level = 'MODERATE' THEN printf('Continue monitoring provider %s''s authorization volume and investigate if the deviation continues in subsequent months.', NPI)
           ELSE printf('No corrective action is required for provider %s. Continue routine monitoring.', NPI) END AS recommendation
    FROM auth_volume_risk
    """,
)


@query("ag02_auth_month_volume", "SELECT * FROM auth_monthly")
def _(spark, sf):
    return V.auth_monthly_volume(S.authorizations(spark, sf))


@query(
    "wn05_auth_previous_median",
    """
    SELECT NPI, period, CASE WHEN count(monthly_volume) OVER w = 3 THEN median(monthly_volume::DOUBLE) OVER w END AS baseline
    FROM auth_filled WINDOW w AS (PARTITION BY NPI ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
    """,
)
def _(spark, sf):
    monthly = V.auth_monthly_volume(S.authorizations(spark, sf))
    filled = periods.fill_months(monthly, ["NPI"], "period", ["monthly_volume"])
    base = periods.previous_median("monthly_volume", ["NPI"], "period", 3)
    return filled.select("NPI", "period", base.alias("baseline"))


@query(
    "pl05_auth_volume_risk",
    """
    SELECT r.* EXCLUDE (deviation_pct, volume_risk), round_even(deviation_pct, 6) AS deviation_pct, round_even(volume_risk, 6) AS volume_risk,
           (SELECT CAST(sum(monthly_volume) AS BIGINT) FROM auth_monthly) AS total_authorization_volume,
           p.provider_authorization_volume, p.provider_months
    FROM auth_volume_explained r
    JOIN (SELECT NPI, CAST(sum(monthly_volume) AS BIGINT) AS provider_authorization_volume, count(*) AS provider_months FROM auth_monthly GROUP BY NPI) p USING (NPI)
    """,
)
def _(spark, sf):
    t = V.auth_volume(S.authorizations(spark, sf))["authorization_provider_volume_risk"]
    return t.drop("source_count", "sources", "months_available").withColumns(
        {c: half_even(c, 6) for c in ("deviation_pct", "volume_risk")}
    )


@query(
    "jn11_auth_month_explained",
    """
    SELECT m.NPI, m.period, m.monthly_volume, coalesce(r.root_cause, 'No volume-risk issue was identified.') AS root_cause,
           coalesce(r.recommendation, 'Continue routine provider-level monitoring.') AS recommendation
    FROM auth_monthly m LEFT JOIN auth_volume_explained r ON r.NPI = m.NPI AND r.current_period = m.period
    """,
)
def _(spark, sf):
    return V.auth_volume(S.authorizations(spark, sf))["authorization_provider_monthly_volume"]
