"""Cleaning, dates, codes, ingestion checks and weekly batches."""

from __future__ import annotations


from pyspark.sql import functions as F

from payerlens.catalog import standins as S
from payerlens.catalog.quality_claims import blank, date, diag
from payerlens.catalog.registry import query, table, view
from payerlens.catalog.sla import rounded
from payerlens.functions import bands as B
from payerlens.functions import clean as C
from payerlens.functions import codes, dates
from payerlens.operators import contracts
from payerlens.plans import batches as BT
from payerlens.plans import claims_quality as Q
from payerlens.plans import preprocess as P
from payerlens.sources import readers

# Untidy texts derived from the orders, one per kind of defect.
view(
    "untidy",
    """
    SELECT o_orderkey AS k,
           CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN '  NA ' WHEN 2 THEN 'n/a' WHEN 3 THEN '.' WHEN 4 THEN 'NULL' WHEN 5 THEN chr(9) || o_orderstatus || ' ' WHEN 6 THEN 'None' ELSE NULL END AS token,
           CASE o_orderkey % 5 WHEN 0 THEN '--' || o_custkey WHEN 1 THEN o_custkey || '.0' WHEN 2 THEN '  ' || o_custkey WHEN 3 THEN '00' || o_custkey ELSE 'nan' END AS id_text,
           CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'x' || o_custkey WHEN 2 THEN '-' || o_custkey || '.125' WHEN 3 THEN 'NaN' ELSE '' END AS number_text,
           CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN 'period ' || strftime(o_orderdate, '%Y_%m') WHEN 4 THEN '1899-12' ELSE 'soon' END AS period_text,
           o_orderdate AS asked, o_totalprice AS amount, o_custkey AS n FROM orders
    """,
)


def untidy(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    d = F.col("o_orderdate")

    def pick(by, *values):
        out = F.lit(None).cast("string")
        for i, v in reversed(list(enumerate(values))):
            out = F.when(k % by == i, v).otherwise(out)
        return out

    lit = F.lit
    return table(spark, sf, "orders").select(
        k.alias("k"),
        pick(8, lit(""), lit("  NA "), lit("n/a"), lit("."), lit("NULL"), F.concat(lit("\t"), "o_orderstatus", lit(" ")), lit("None")).alias("token"),
        pick(5, F.concat(lit("--"), c), F.concat(c, lit(".0")), F.concat(lit("  "), c), F.concat(lit("00"), c), lit("nan")).alias("id_text"),
        pick(5, c, F.concat(lit("x"), c), F.concat(lit("-"), c, lit(".125")), lit("NaN"), lit("")).alias("number_text"),
        pick(6, F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyyMM"), F.date_format(d, "yyyy/MM/dd"), F.concat(lit("period "), F.date_format(d, "yyyy_MM")), lit("1899-12"), lit("soon")).alias("period_text"),
        d.alias("asked"), F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("n"),
    )


@query("fn01_fn03_text_cleaning", r"""
    SELECT k, regexp_replace(token, '^\s+|\s+$', '', 'g') AS trimmed,
           CASE WHEN regexp_replace(token, '^\s+|\s+$', '', 'g') NOT IN ('', 'NA', 'N/A', 'NULL', '.') THEN regexp_replace(token, '^\s+|\s+$', '', 'g') END AS known,
           CASE WHEN lower(regexp_replace(token, '^\s+|\s+$', '', 'g')) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN regexp_replace(token, '^\s+|\s+$', '', 'g') END AS known_any_case,
           trim(coalesce(token, '')) IN ('', 'nan', 'NaN', 'None') AS blank FROM untidy""")
def _(spark, sf):
    return untidy(spark, sf).select(
        "k", C.trim_text("token").alias("trimmed"), C.null_tokens("token").alias("known"),
        C.null_tokens("token", C.NULL_TOKENS_ANY_CASE, any_case=True).alias("known_any_case"), C.is_blank("token").alias("blank"),
    )


@query("fn04_fn05_dates", f"""
    SELECT CLM_ID, LINE_NUM, strftime({date('CLM_FROM_DT')}, '%Y-%m-%d') AS any_layout, strftime(try_strptime(CLM_THRU_DT, '%d-%b-%Y'), '%Y-%m-%d') AS raw_layout FROM claims_text""")
def _(spark, sf):
    return S.claims_text(spark, sf).select(
        "CLM_ID", "LINE_NUM", F.date_format(dates.parse_date("CLM_FROM_DT"), "yyyy-MM-dd").alias("any_layout"),
        F.date_format(dates.parse_raw_date("CLM_THRU_DT"), "yyyy-MM-dd").alias("raw_layout"),
    )


@query("fn06_fn09_numbers", """
    SELECT k, nullif(try_cast(number_text AS DOUBLE), 'nan'::DOUBLE) AS value, round_even(nullif(try_cast(number_text AS DOUBLE), 'nan'::DOUBLE), 2) AS cents,
           coalesce(nullif(try_cast(number_text AS DOUBLE), 'nan'::DOUBLE), 0) AS or_zero, CASE WHEN nullif(try_cast(number_text AS DOUBLE), 'nan'::DOUBLE) >= 0 THEN nullif(try_cast(number_text AS DOUBLE), 'nan'::DOUBLE) END AS positive FROM untidy""")
def _(spark, sf):
    return untidy(spark, sf).select(
        "k", C.number("number_text").alias("value"), C.number("number_text", 2).alias("cents"),
        C.number_or_zero("number_text").alias("or_zero"), C.non_negative(C.number("number_text")).alias("positive"),
    )


@query("fn10_fn13_identifiers", r"""
    SELECT k, regexp_replace(id_text, '^-+', '') AS unsigned, regexp_replace(trim(id_text), '\.0$', '') AS npi, regexp_replace(trim(id_text), '^(\d+)\.0$', '\1') AS npi_digits,
           regexp_replace(trim(id_text), '\.0$', '') NOT IN ('', '0', 'nan', 'None') AS valid FROM untidy""")
def _(spark, sf):
    return untidy(spark, sf).select(
        "k", C.strip_minus("id_text").alias("unsigned"), C.npi("id_text").alias("npi"),
        C.npi_digits("id_text").alias("npi_digits"), C.is_valid_npi_key(C.npi("id_text")).alias("valid"),
    )


@query("fn17_fn22_periods_and_spans", r"""
    SELECT k, strftime(asked, '%Y-%m') AS month, CASE WHEN regexp_matches(period_text, '((?:19|20)\d{2})[-/_]?(\d{2})') THEN regexp_extract(period_text, '((?:19|20)\d{2})[-/_]?(\d{2})', 1) || '-' || regexp_extract(period_text, '((?:19|20)\d{2})[-/_]?(\d{2})', 2) END AS period,
           date_diff('day', asked, TIMESTAMP '1999-06-01') AS days, date_diff('day', asked, TIMESTAMP '1999-06-01') * 24.0::DOUBLE AS hours, date_diff('day', asked, TIMESTAMP '1999-06-01') * 1440.0::DOUBLE AS minutes,
           round_even(date_diff('day', asked, TIMESTAMP '1999-06-01') / 365.25::DOUBLE, 6) AS years FROM untidy""")
def _(spark, sf):
    to = F.lit("1999-06-01").cast("timestamp_ntz")
    rows = untidy(spark, sf).select(
        "k", dates.month_key("asked").alias("month"), dates.normalize_period("period_text").alias("period"),
        dates.days_between("asked", to).alias("days"), dates.hours_between("asked", to).alias("hours"),
        dates.minutes_between("asked", to).alias("minutes"), dates.age_years("asked", to).alias("years"),
    )
    return rounded(rows, "years")


@query("fn23_fn25_ratios", """
    SELECT k, round_even(amount / nullif(n % 3, 0), 6) AS ratio, round_even(CASE WHEN n % 3 > 0 THEN amount / (n % 3) * 100 ELSE 0 END, 4) AS share, CASE WHEN n % 7 <> 0 THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, CAST(n % 20 - 5 AS DOUBLE))) END AS clipped FROM untidy""")
def _(spark, sf):
    d = F.col("n") % 3
    rows = untidy(spark, sf).select(
        "k", C.ratio("amount", d).alias("ratio"), C.share_or_zero("amount", d).alias("share"),
        C.clip(F.when(F.col("n") % 7 != 0, (F.col("n") % 20 - 5).cast("double")), 0.0, 10.0).alias("clipped"),
    )
    return rounded(rounded(rows, "ratio"), "share", digits=4)


@query("fn26_fn30_code_formats", f"""
    SELECT CLM_ID, LINE_NUM, NOT {blank('PRF_PHYSN_NPI')} AND NOT regexp_matches(trim(PRF_PHYSN_NPI), '^\\d{{10}}$') AS bad_npi, {diag('PRNCPAL_DGNS_CD', 'trim(PRNCPAL_DGNS_VRSN_CD)')} AS valid_code,
           HCPCS_CD IS NOT NULL AND NOT regexp_matches(upper(trim(coalesce(HCPCS_CD, ''))), '^[A-Z0-9]{{5}}$') AS odd_hcpcs FROM claims_text""")
def _(spark, sf):
    return S.claims_text(spark, sf).select(
        "CLM_ID", "LINE_NUM", codes.present_but_not("PRF_PHYSN_NPI", codes.NPI).alias("bad_npi"),
        codes.valid_diagnosis("PRNCPAL_DGNS_CD", "PRNCPAL_DGNS_VRSN_CD").alias("valid_code"),
        codes.structurally_invalid("HCPCS_CD", codes.STRUCTURAL_HCPCS).alias("odd_hcpcs"),
    )


def steps(c, pairs, top, op="<"):
    return "CASE " + " ".join(f"WHEN {c} {op} {e} THEN '{r}'" for e, r in pairs) + f" ELSE '{top}' END"


@query("fn31_bands", f"""
    SELECT k, CASE WHEN x <= 5 THEN 0.0::DOUBLE WHEN x <= 10 THEN 0.2::DOUBLE WHEN x <= 20 THEN 0.5::DOUBLE WHEN x <= 30 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS volume_risk,
           CASE WHEN x < 75 THEN 0.0::DOUBLE WHEN x < 90 THEN 40.0::DOUBLE WHEN x < 95 THEN 70.0::DOUBLE ELSE 100.0::DOUBLE END AS percentile_risk, {steps('x', [(25, 'Low'), (50, 'Medium'), (75, 'High')], 'Critical')} AS pharmacy_level,
           {steps('x', [(50, 'Critical'), (70, 'Poor'), (85, 'Warning'), (95, 'Good')], 'Excellent')} AS auth_category, {steps('x / 100', [(0.24, 'LOW'), (0.49, 'MEDIUM'), (0.74, 'HIGH')], 'CRITICAL', '<=')} AS claim_level,
           {steps('x / 100', [(0.25, 'Low'), (0.5, 'Moderate'), (0.75, 'High')], 'Critical', '<=')} AS provider_level, {steps('x / 100', [(0.1, 'Excellent'), (0.25, 'Very Good'), (0.5, 'Good'), (0.75, 'Fair')], 'Poor')} AS gauge,
           CASE WHEN x > 15 THEN 'critical' WHEN x >= 1 THEN 'high' WHEN x > 0 THEN 'warning' ELSE 'info' END AS severity, {steps('x / 10', [(2.5, 'critical'), (5, 'poor'), (7.5, 'moderate'), (9, 'good')], 'excellent')} AS quality
    FROM (SELECT k, CAST(n % 101 AS DOUBLE) AS x FROM untidy)""")
def _(spark, sf):
    x = (F.col("n") % 101).cast("double")
    return untidy(spark, sf).select(
        "k", B.VOLUME_DEVIATION_RISK(x).alias("volume_risk"), B.PERCENTILE_RISK(x).alias("percentile_risk"),
        B.PHARMACY_RISK_LEVEL(x).alias("pharmacy_level"), B.AUTH_CATEGORY(x).alias("auth_category"),
        B.CLAIM_RISK_LEVEL(x / 100).alias("claim_level"), B.PROVIDER_RISK_LEVEL(x / 100).alias("provider_level"),
        B.GAUGE(x / 100).alias("gauge"), B.severity_from_pct(x).alias("severity"), B.QUALITY_STATUS(x / 10).alias("quality"),
    )


@query("fn35_fn36_fn39_lists_and_keys", """
    SELECT k, concat_ws(', ', CASE WHEN n % 2 = 0 THEN 'even' END, CASE WHEN n % 3 = 0 THEN 'third' END) AS names, 'k=' || k || '|n=' || n AS record_key FROM untidy""")
def _(spark, sf):
    from payerlens.functions.text import joined

    n = F.col("n")
    return untidy(spark, sf).select(
        "k", joined([F.when(n % 2 == 0, "even"), F.when(n % 3 == 0, "third")], ", ").alias("names"), C.key_text("k", "n").alias("record_key")
    )


@query("src05_combined_sources", """
    SELECT CASE l_returnflag WHEN 'A' THEN 'carrier' WHEN 'N' THEN 'dme' ELSE 'hha' END AS source, count(*) AS rows, count(DISTINCT l_suppkey) AS providers FROM lineitem GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    frames = {}
    for flag, name, npi in (("A", "carrier", "PRF_PHYSN_NPI"), ("N", "dme", "PRVDR_NPI"), ("R", "hha", "ORG_NPI_NUM")):
        frames[name] = li.filter(F.col("l_returnflag") == flag).select(
            F.col("l_orderkey").alias("CLM_ID"), F.col("l_shipdate").alias("CLM_FROM_DT"), F.col("l_suppkey").alias(npi)
        )
    frames["snf"] = li.select("l_orderkey")  # lacks every needed column, so it is skipped
    return readers.combine_sources(frames).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("NPI").alias("providers"))


@query("src03_src04_wanted_text", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM customer")
def _(spark, sf):
    return readers.all_text(readers.wanted_columns(table(spark, sf, "customer"), ["c_custkey", "absent", "c_mktsegment"]))


@query("src10_src14_names_and_types", "SELECT c_custkey AS customer_id, c_name AS name_of_customer, CAST(c_acctbal AS BIGINT) AS balance FROM customer")
def _(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Customer ID"), F.col("c_name").alias("Name (of) Customer"), F.bround("c_acctbal", 0).cast("string").alias("Acct-Balance")
    )
    named = contracts.normalize_headers(raw, {"Acct-Balance": "balance"})
    return contracts.cast_declared(named.withColumn("balance", F.regexp_replace("balance", r"\.0$", "")), {"balance": "INTEGER"})


view("typed_claims", f"""
    SELECT CASE WHEN trim(BENE_ID) IN ('', 'NA') THEN NULL ELSE regexp_replace(trim(BENE_ID), '^-+', '') END AS BENE_ID, CLM_ID, LINE_NUM,
           try_strptime(CLM_THRU_DT, '%d-%b-%Y') AS CLM_THRU_DT, try_strptime(CLM_FROM_DT, '%d-%b-%Y') AS CLM_FROM_DT, nullif(try_cast(CLM_PMT_AMT AS DOUBLE), 'nan'::DOUBLE) AS CLM_PMT_AMT FROM claims_text""")


@query("pl01_claims_preprocessing", "SELECT BENE_ID, CLM_ID, LINE_NUM, strftime(CLM_FROM_DT, '%Y-%m-%d') AS from_day, strftime(CLM_THRU_DT, '%Y-%m-%d') AS thru_day, CLM_PMT_AMT FROM typed_claims")
def _(spark, sf):
    typed = P.claims(S.claims_text(spark, sf))
    return typed.select("BENE_ID", "CLM_ID", "LINE_NUM", F.date_format("CLM_FROM_DT", "yyyy-MM-dd").alias("from_day"), F.date_format("CLM_THRU_DT", "yyyy-MM-dd").alias("thru_day"), "CLM_PMT_AMT")


@query("ag35_ingestion_report", """
    SELECT count(*) AS rows, count(*) FILTER (BENE_ID IS NULL) AS null_pk_rows, count(*) FILTER (CLM_PMT_AMT < 0) AS negative_clm_pmt_amt, count(*) FILTER (CLM_THRU_DT < CLM_FROM_DT) AS thru_before_from,
           count(*) FILTER (CLM_FROM_DT IS NULL) AS unparseable_CLM_FROM_DT, count(*) - (SELECT count(*) FROM (SELECT DISTINCT BENE_ID, CLM_ID, LINE_NUM FROM typed_claims)) AS duplicate_pk_rows FROM typed_claims""")
def _(spark, sf):
    typed = P.claims(S.claims_text(spark, sf))
    return Q.ingestion_report(typed, ["BENE_ID", "CLM_ID", "LINE_NUM"], ["CLM_FROM_DT"])


@query("pl03_drug_list_cleaning", """
    SELECT trim(drug_name) AS drug_name, trim(generic_name) AS generic_name, upper(trim(opioid_flag)) AS opioid_flag, upper(trim(la_opioid_flag)) AS la_opioid_flag FROM drug_list""")
def _(spark, sf):
    raw = S.drug_list(spark, sf).withColumnsRenamed({v: k for k, v in P.DRUG_LIST_HEADERS.items()})
    return P.drug_list(raw, None).select("drug_name", "generic_name", "opioid_flag", "la_opioid_flag")


@query("pl03_grand_totals_cleaning", "SELECT calendar_year, total_claims, round_even(total_drug_cost, 4) AS total_drug_cost, total_beneficiaries FROM grand_totals")
def _(spark, sf):
    raw = S.grand_totals(spark, sf)
    twice = raw.unionByName(raw).select(*[F.col(c).cast("string").alias(c.replace("_", " ").title()) for c in raw.columns])
    rows = P.grand_totals(twice).select("calendar_year", "total_claims", "total_drug_cost", "total_beneficiaries")
    return rounded(rows, "total_drug_cost", digits=4)


@query("pl02_prescriber_drug_preprocessing", """
    SELECT Prscrbr_NPI, Brnd_Name, Gnrc_Name, Tot_Clms, CAST(Tot_Day_Suply AS BIGINT) AS Tot_Day_Suply, round_even(CAST(CAST(Tot_Drug_Cst AS DECIMAL(12,2)) AS DOUBLE), 2) AS Tot_Drug_Cst FROM prescriber_drug""")
def _(spark, sf):
    df = S.prescriber_drug(spark, sf)
    raw = df.select(*[
        (F.format_string("%.2f", c) if c in ("Tot_Drug_Cst", "Tot_30day_Fills") else F.col(c).cast("bigint").cast("string") if c == "Tot_Day_Suply" else F.col(c).cast("string")).alias(c)
        if c in df.columns else F.lit("").alias(c) for c in P.PRESCRIBER_DRUG_COLUMNS
    ])
    rows = P.prescriber_drug(raw).select("Prscrbr_NPI", "Brnd_Name", "Gnrc_Name", "Tot_Clms", "Tot_Day_Suply", F.col("Tot_Drug_Cst").cast("double").alias("Tot_Drug_Cst"))
    return rounded(rows, "Tot_Drug_Cst", digits=2)


@query("dq_i_flag_values", """
    SELECT 'la_opioid_flag' AS column, la_opioid_flag AS value, count(*) AS rows FROM (SELECT CASE WHEN la_opioid_flag = 'N' THEN 'no' ELSE la_opioid_flag END AS la_opioid_flag FROM drug_list) WHERE upper(trim(la_opioid_flag)) NOT IN ('Y', 'N') GROUP BY 2""".replace("AS column", 'AS "column"'))
def _(spark, sf):
    odd = S.drug_list(spark, sf).withColumn("la_opioid_flag", F.when(F.col("la_opioid_flag") == "N", "no").otherwise(F.col("la_opioid_flag")))
    return Q.flag_values_outside(odd, ["opioid_flag", "la_opioid_flag"])


view("batch_features", """
    SELECT strftime(NCH_WKLY_PROC_DT, '%Y-%m-%d') AS week, count(CLM_ID)::DOUBLE AS batch_volume, round_even(coalesce(avg(lag), median(avg(lag)) OVER (), 0), 6) AS avg_lag_days, coalesce(max(lag)::DOUBLE, median(max(lag)) OVER (), 0) AS max_lag_days,
           round_even(avg(s), 6) AS avg_submitted_amt, round_even(avg(a) / nullif(avg(s), 0), 6) AS allowed_submitted_ratio, round_even(avg(CASE WHEN HCPCS_CD IS NULL THEN 1 ELSE 0 END), 6) AS missing_hcpcs_ratio
    FROM (SELECT *, CASE WHEN NCH_WKLY_PROC_DT >= CLM_FROM_DT THEN date_diff('day', CLM_FROM_DT, NCH_WKLY_PROC_DT) END AS lag, LINE_SBMTD_CHRG_AMT AS s, LINE_ALOWD_CHRG_AMT AS a FROM dme_lines) GROUP BY NCH_WKLY_PROC_DT""")


@query("ag25_batch_features", "SELECT * FROM batch_features")
def _(spark, sf):
    rows = BT.batch_features(S.dme_lines(spark, sf)).select(F.date_format("NCH_WKLY_PROC_DT", "yyyy-MM-dd").alias("week"), *BT.FEATURES)
    return rounded(rows, "avg_lag_days", "avg_submitted_amt", "allowed_submitted_ratio", "missing_hcpcs_ratio")


@query("pl17_sx12_batch_isolation")
def _(spark, sf):
    """No SQL form: trees are grown from random splits."""
    rows = BT.batch_anomalies(S.dme_lines(spark, sf))
    return rounded(rows.select(F.date_format("NCH_WKLY_PROC_DT", "yyyy-MM-dd").alias("week"), "anomaly_score", "status", "analysis"), "anomaly_score")


#: A fixed forest: (tree, node, feature, threshold, left, right, depth of a leaf).
FOREST = (
    (0, 0, 0, 60.0, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 2.5), (0, 2, 3, 36000.0, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, 8.0), (0, 4, -1, 0.0, -1, -1, 6.5),
    (1, 0, 5, 0.05, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 7.0), (1, 2, 1, 40.0, 3, 4, 0.0), (1, 3, -1, 0.0, -1, -1, 9.0), (1, 4, -1, 0.0, -1, -1, 3.0),
    (2, 0, 4, 0.96, 1, 2, 0.0), (2, 1, 2, 80.0, 3, 4, 0.0), (2, 2, -1, 0.0, -1, -1, 4.0), (2, 3, -1, 0.0, -1, -1, 5.0), (2, 4, -1, 0.0, -1, -1, 10.0),
)
_LONG = " UNION ALL ".join(f"SELECT week, {i} AS feature, {f} AS value FROM batch_features" for i, f in enumerate(BT.FEATURES))


@query("pl17_sx12_fixed_forest_scores", f"""
    SELECT week, anomaly_score, CASE WHEN anomaly_score >= 0.6 THEN 'CRITICAL ANOMALY' ELSE 'HEALTHY' END AS status FROM (
      WITH RECURSIVE nodes(tree, node, feature, threshold, below, above, depth) AS (VALUES {', '.join(map(str, FOREST))}), f AS ({_LONG}),
      walk(week, tree, node) AS (SELECT week, tree, 0 FROM batch_features, (SELECT DISTINCT tree FROM nodes)
        UNION ALL SELECT w.week, w.tree, CASE WHEN f.value < n.threshold THEN n.below ELSE n.above END FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN f ON f.week = w.week AND f.feature = n.feature)
      SELECT w.week, round_even(pow(2.0::DOUBLE, -avg(n.depth::DOUBLE) / (2 * (ln(255.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * 255.0::DOUBLE / 256)), 6) AS anomaly_score
      FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY w.week)""")
def _(spark, sf):
    """The scoring of a forest as a table of nodes, with fixed trees in place of grown ones."""
    from payerlens.operators import forest

    rows = BT.batch_features(S.dme_lines(spark, sf)).select(F.date_format("NCH_WKLY_PROC_DT", "yyyy-MM-dd").alias("week"), *BT.FEATURES)
    rows = rounded(rows, "avg_lag_days", "avg_submitted_amt", "allowed_submitted_ratio", "missing_hcpcs_ratio")
    trees = [
        (t, 256, *([n[i] for n in FOREST if n[0] == t] for i in range(2, 7))) for t in range(3)
    ]
    schema = "tree int, size int, feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"
    scored = rounded(forest.score(rows, spark.createDataFrame(trees, schema), BT.FEATURES), "anomaly_score")
    status = F.when(F.col("anomaly_score") >= BT.OUTLIER_SCORE, BT.ANOMALY).otherwise(BT.HEALTHY)
    return scored.select("week", "anomaly_score", status.alias("status"))


@query("src01_src02_src06_delimited_files", """
    SELECT c_mktsegment AS file, count(*) FILTER (c_custkey % 50 <> 0) AS rows, count(*) FILTER (c_custkey % 50 = 0) AS bad,
           count(DISTINCT c_name) FILTER (c_custkey % 50 <> 0) AS names, CAST(sum(c_custkey) FILTER (c_custkey % 50 <> 0) AS BIGINT) AS keys FROM customer GROUP BY 1""")
def _(spark, sf):
    """Files written from the customers, one folder a segment; every 50th record has a field too many."""
    from payerlens.operators.stages import new_stage

    folder, names = new_stage(spark), ["custkey", "name", "phone"]
    c = table(spark, sf, "customer")
    line = F.concat_ws("|", "c_custkey", "c_name", F.lit(""), F.when(F.col("c_custkey") % 50 == 0, "extra"))
    c.select(line.alias("value"), F.col("c_mktsegment").alias("segment")).write.partitionBy("segment").text(folder)
    segments = [r[0] for r in c.select("c_mktsegment").distinct().collect()]
    rows, bad = readers.read_delimited(spark, {s: f"{folder}/segment={s}" for s in segments}, names, header=False)
    good = rows.groupBy("file").agg(
        F.count("*").alias("rows"), F.countDistinct("name").alias("names"), F.sum(F.col("custkey").cast("bigint")).alias("keys")
    )
    return good.join(bad.groupBy("file").agg(F.count("*").alias("bad")), "file", "left").na.fill(0, ["bad"])


@query("src07_src09_src15_fn07_accepted", """
    SELECT o_orderpriority AS priority, count(*) AS orders, round_even(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def _(spark, sf):
    """Checks inside the plan on an input that holds them: columns, tables, numbers, unchanged row count."""
    orders = table(spark, sf, "orders")
    orders.createOrReplaceTempView("accepted_orders")
    contracts.require_tables(spark, ["accepted_orders"])
    raw = orders.select(F.col("o_orderpriority").alias("priority"), F.format_string("%.2f", "o_totalprice").alias("total"))
    checked = contracts.require_numeric(contracts.require_exact_columns(raw, ["priority", "total"]), ["total"])
    checked = contracts.require_unchanged_count(contracts.require_columns(checked, ["total"]), orders)
    sums = checked.groupBy("priority").agg(F.count("*").alias("orders"), F.sum("total").alias("total"))
    return rounded(sums, "total", digits=2)
