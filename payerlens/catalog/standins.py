"""The domain's input tables as projections of the given tables.

Nothing is generated: every row comes from the given tables, and derived
values (blank ids, odd date layouts, missing approvals) follow fixed rules on
their keys so that every rule has both passing and failing rows. Each frame
has a view of the same name for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payerlens.catalog.registry import table, view


def numbered(prefix: str, c, width: int):
    """As ``format_string(f"{prefix}%0{width}d", c)``.

    Numbers that fit the width are written behind a leading 1, as formatting is what costs
    most in reading a line; NULL, negative and longer ones are still formatted.
    """
    text = (c.cast("long") + 10**width).cast("string")
    if prefix != "1":
        text = F.concat(F.lit(prefix), F.substring(text, 2, width))
    return F.when((c >= 0) & (c < 10**width), text).otherwise(F.format_string(f"{prefix}%0{width}d", c))


def coded(prefix: str, c, n: int, width: int = 1):
    """As ``numbered`` for a remainder by n: looked up in the list of all of them."""
    texts = F.array(*[F.lit(prefix + "%0*d" % (width, i)) for i in range(1 - n, n)])
    return F.coalesce(F.get(texts, (c + (n - 1)).cast("int")), F.lit(prefix + "null".rjust(width)))


def provider_number(c: str):
    return numbered("1", F.col(c).cast("long"), 9)


# -- claim lines ------------------------------------------------------------

view(
    "claim_lines",
    """
    SELECT l_returnflag AS source, CAST(l_orderkey AS VARCHAR) AS CLM_ID,
           l_shipdate AS DT, printf('1%09d', l_suppkey) AS NPI
    FROM lineitem
    """,
)


def claim_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(source, CLM_ID, DT, NPI): return flag, order, ship date and supplier."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source"),
        F.col("l_orderkey").cast("string").alias("CLM_ID"),
        F.col("l_shipdate").alias("DT"),
        provider_number("l_suppkey").alias("NPI"),
    )


view(
    "claims",
    """
    SELECT CASE l_returnflag WHEN 'A' THEN 'dme' WHEN 'N' THEN 'hha' ELSE 'inpatient' END AS claim_type,
           CAST(o_custkey AS VARCHAR) AS BENE_ID, CAST(l_orderkey AS VARCHAR) AS CLM_ID,
           CAST(l_linenumber AS VARCHAR) AS LINE_NUM,
           printf('1%09d', l_suppkey) AS PRVDR_NPI,
           CASE WHEN l_orderkey % 7 = 0 THEN o_orderdate ELSE l_shipdate END + to_years(CAST((2002 - year(l_shipdate)) // 2 AS INTEGER)) AS CLM_FROM_DT,
           l_shipdate - to_days(CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END) + to_years(CAST((2002 - year(l_shipdate)) // 2 AS INTEGER)) AS CLM_THRU_DT,
           l_extendedprice * (1 - l_discount) AS CLM_PMT_AMT,
           l_extendedprice AS CLM_TOT_CHRG_AMT,
           l_extendedprice * (1 - l_tax) AS LINE_ALOWD_CHRG_AMT,
           l_quantity AS LINE_SRVC_CNT,
           CAST(l_linenumber AS DOUBLE) AS CLM_UTLZTN_DAY_CNT,
           l_quantity / 2 AS CLM_HHA_TOT_VISIT_CNT,
           printf('S%02d', l_suppkey % 5) AS PRVDR_SPCLTY,
           printf('%02d', l_suppkey % 11) AS PRVDR_STATE_CD,
           CASE WHEN l_partkey % 50 = 0 THEN 'X' ELSE printf('A%02d', l_partkey % CASE WHEN year(l_shipdate) >= 2000 AND month(l_shipdate) >= 9 THEN 3 ELSE 12 END) END AS PRNCPAL_DGNS_CD,
           CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE printf('P%03d', l_partkey % 9) END AS ICD_PRCDR_CD1,
           CASE WHEN l_partkey % 41 = 0 THEN 'H12' ELSE printf('H%04d', l_partkey % 20) END AS HCPCS_CD,
           printf('%04d', 100 + l_linenumber) AS REV_CNTR,
           o_orderpriority AS NCH_PRMRY_PYR_CD, l_linestatus AS CLM_DISP_CD,
           o_orderstatus AS PTNT_DSCHRG_STUS_CD
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Typed claim lines of three claim types (return flag) with codes and amounts.

    Two years are laid into one, so that months hold enough rows for the drift limits; the last
    ones use few diagnoses only.
    """
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    # Joined by the claim id's text, so that the joined lines already lie by claim.
    j = li.join(o, li.l_orderkey.cast("string") == o.o_orderkey.cast("string"))
    few = (F.year("l_shipdate") >= 2000) & (F.month("l_shipdate") >= 9)
    diagnosis = F.when(few, F.col("l_partkey") % 3).otherwise(F.col("l_partkey") % 12)
    years = F.floor((F.lit(2002) - F.year("l_shipdate")) / 2).cast("int")
    kind = dict(li.dtypes)["l_shipdate"]

    def moved(day):
        return F.make_ym_interval(years, F.lit(0)) + day if kind.startswith("timestamp") else F.add_months(day, years * 12)

    odd = F.when(F.col("l_partkey") % 97 == 0, F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval(F.lit(0)))
    return j.select(
        F.when(F.col("l_returnflag") == "A", "dme")
        .when(F.col("l_returnflag") == "N", "hha")
        .otherwise("inpatient")
        .alias("claim_type"),
        F.col("o_custkey").cast("string").alias("BENE_ID"),
        F.col("l_orderkey").cast("string").alias("CLM_ID"),
        F.col("l_linenumber").cast("string").alias("LINE_NUM"),
        provider_number("l_suppkey").alias("PRVDR_NPI"),
        moved(F.when(F.col("l_orderkey") % 7 == 0, F.col("o_orderdate")).otherwise(F.col("l_shipdate"))).alias("CLM_FROM_DT"),
        moved(F.col("l_shipdate") - odd).alias("CLM_THRU_DT"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("CLM_PMT_AMT"),
        F.col("l_extendedprice").alias("CLM_TOT_CHRG_AMT"),
        (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("LINE_ALOWD_CHRG_AMT"),
        F.col("l_quantity").alias("LINE_SRVC_CNT"),
        F.col("l_linenumber").cast("double").alias("CLM_UTLZTN_DAY_CNT"),
        (F.col("l_quantity") / 2).alias("CLM_HHA_TOT_VISIT_CNT"),
        coded("S", F.col("l_suppkey") % 5, 5, 2).alias("PRVDR_SPCLTY"),
        coded("", F.col("l_suppkey") % 11, 11, 2).alias("PRVDR_STATE_CD"),
        F.when(F.col("l_partkey") % 50 == 0, "X")
        .otherwise(coded("A", diagnosis, 12, 2))
        .alias("PRNCPAL_DGNS_CD"),
        F.when(F.col("l_partkey") % 3 != 0, coded("P", F.col("l_partkey") % 9, 9, 3)).alias(
            "ICD_PRCDR_CD1"
        ),
        F.when(F.col("l_partkey") % 41 == 0, "H12")
        .otherwise(coded("H", F.col("l_partkey") % 20, 20, 4))
        .alias("HCPCS_CD"),
        numbered("", F.col("l_linenumber") + 100, 4).alias("REV_CNTR"),
        F.col("o_orderpriority").alias("NCH_PRMRY_PYR_CD"),
        F.col("l_linestatus").alias("CLM_DISP_CD"),
        F.col("o_orderstatus").alias("PTNT_DSCHRG_STUS_CD"),
    )


# -- raw text claims with defects -------------------------------------------

view(
    "claims_text",
    """
    SELECT CASE WHEN l_orderkey % 97 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS BENE_ID,
           CAST(l_orderkey AS VARCHAR) AS CLM_ID,
           CAST(l_linenumber AS VARCHAR) AS LINE_NUM,
           CASE WHEN l_suppkey % 23 = 0 THEN printf('1%08d', l_suppkey)
                WHEN l_orderkey % 89 = 0 THEN ''
                ELSE printf('1%09d', l_suppkey) END AS PRF_PHYSN_NPI,
           CASE l_linenumber WHEN 1 THEN strftime(o_orderdate, '%Y%m%d')
                WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
                WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y')
                WHEN 4 THEN strftime(o_orderdate, '%d-%b-%Y')
                WHEN 5 THEN CASE WHEN l_orderkey % 10 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS CLM_FROM_DT,
           strftime(l_shipdate, '%d-%b-%Y') AS CLM_THRU_DT,
           CASE WHEN l_orderkey % 101 = 0 THEN 'NaN' ELSE CAST(CAST(ROUND(l_orderkey % 5000, 0) AS INTEGER) - 40 AS VARCHAR) END AS CLM_PMT_AMT,
           CAST(CAST(l_orderkey % 4999 AS INTEGER) AS VARCHAR) AS CLM_TOT_CHRG_AMT,
           CAST(CAST(l_quantity AS INTEGER) - 2 AS VARCHAR) AS LINE_SRVC_CNT,
           CAST(CAST(l_quantity AS INTEGER) * 10 AS VARCHAR) AS LINE_NCH_PMT_AMT,
           CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN 'Q'
                WHEN l_partkey % 5 = 0 THEN printf('%03d', l_partkey % 1000)
                ELSE printf('A%02d.%d', l_partkey % 100, l_partkey % 10) END AS PRNCPAL_DGNS_CD,
           CASE WHEN l_partkey % 29 = 0 THEN '8' WHEN l_partkey % 5 = 0 THEN '9' ELSE '0' END AS PRNCPAL_DGNS_VRSN_CD,
           CASE WHEN l_partkey % 7 = 0 THEN '' ELSE printf('B%02d', l_partkey % 100) END AS ICD_DGNS_CD1,
           CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN 'ab' ELSE printf('J%04d', l_partkey % 10000) END AS HCPCS_CD,
           CASE WHEN l_suppkey % 19 = 0 THEN 'X' WHEN l_suppkey % 2 = 0 THEN 'ny' ELSE printf('%02d', l_suppkey % 50) END AS PRVDR_STATE_CD,
           CAST(l_linenumber * 80 - 100 AS VARCHAR) AS CLM_UTLZTN_DAY_CNT
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)


def claims_text(spark: SparkSession, sf: str) -> DataFrame:
    """All-text claim lines with blank ids, odd layouts and bad codes."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    part, supp, order, line = (
        F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    )
    return j.select(
        F.when(order % 97 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("BENE_ID"),
        order.cast("string").alias("CLM_ID"),
        line.cast("string").alias("LINE_NUM"),
        F.when(supp % 23 == 0, numbered("1", supp, 8))
        .when(order % 89 == 0, "")
        .otherwise(numbered("1", supp, 9))
        .alias("PRF_PHYSN_NPI"),
        F.when(line == 1, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(line == 3, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(line == 4, F.date_format("o_orderdate", "dd-MMM-yyyy"))
        .when((line == 5) & (order % 10 == 0), "not a date")
        .otherwise(iso)
        .alias("CLM_FROM_DT"),
        F.date_format("l_shipdate", "dd-MMM-yyyy").alias("CLM_THRU_DT"),
        F.when(order % 101 == 0, "NaN")
        .otherwise((order % 5000 - 40).cast("string"))
        .alias("CLM_PMT_AMT"),
        (order % 4999).cast("string").alias("CLM_TOT_CHRG_AMT"),
        (F.col("l_quantity").cast("int") - 2).cast("string").alias("LINE_SRVC_CNT"),
        (F.col("l_quantity").cast("int") * 10).cast("string").alias("LINE_NCH_PMT_AMT"),
        F.when(part % 13 == 0, "")
        .when(part % 17 == 0, "Q")
        .when(part % 5 == 0, numbered("", part % 1000, 3))
        .otherwise(F.format_string("A%02d.%d", part % 100, part % 10))
        .alias("PRNCPAL_DGNS_CD"),
        F.when(part % 29 == 0, "8").when(part % 5 == 0, "9").otherwise("0").alias(
            "PRNCPAL_DGNS_VRSN_CD"
        ),
        F.when(part % 7 == 0, "").otherwise(coded("B", part % 100, 100, 2)).alias(
            "ICD_DGNS_CD1"
        ),
        F.when(part % 31 == 0, F.lit(None).cast("string"))
        .when(part % 37 == 0, "ab")
        .otherwise(numbered("J", part % 10000, 4))
        .alias("HCPCS_CD"),
        F.when(supp % 19 == 0, "X")
        .when(supp % 2 == 0, "ny")
        .otherwise(coded("", supp % 50, 50, 2))
        .alias("PRVDR_STATE_CD"),
        (line * 80 - 100).cast("string").alias("CLM_UTLZTN_DAY_CNT"),
    )


# -- beneficiary master -------------------------------------------------------

view(
    "beneficiary",
    """
    SELECT CASE WHEN c_custkey % 20 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS BENE_ID,
           CASE WHEN c_custkey % 33 = 0 THEN 'N' ELSE printf('%02d', c_nationkey) END AS STATE_CODE,
           CASE WHEN c_custkey % 40 = 1 THEN '' WHEN c_custkey % 40 = 2 THEN 'unknown'
                ELSE printf('%04d-%02d-%02d', 1870 + (c_custkey * 7) % 170, 1 + c_custkey % 12, 1 + c_custkey % 28) END AS BENE_BIRTH_DT,
           CASE WHEN c_custkey % 6 = 0 THEN printf('%04d-%02d-%02d', 1990 + c_custkey % 12, 1 + c_custkey % 12, 1 + c_custkey % 28) ELSE '' END AS BENE_DEATH_DT,
           CAST(c_custkey % 4 AS VARCHAR) AS SEX_IDENT_CD,
           CASE WHEN c_custkey % 50 = 3 THEN '' ELSE CAST(1994 + c_custkey % 8 AS VARCHAR) END AS BENE_ENROLLMT_REF_YR,
           CAST(c_custkey % 125 - 3 AS VARCHAR) AS AGE_AT_END_REF_YR
    FROM customer
    """,
)


def beneficiary(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as beneficiaries; every 20th repeats the next one's id."""
    k = F.col("c_custkey")
    day = F.format_string("%02d", 1 + k % 28)
    month = F.format_string("%02d", 1 + k % 12)
    return table(spark, sf, "customer").select(
        F.when(k % 20 == 0, (k + 1).cast("string")).otherwise(k.cast("string")).alias("BENE_ID"),
        F.when(k % 33 == 0, "N")
        .otherwise(F.format_string("%02d", F.col("c_nationkey")))
        .alias("STATE_CODE"),
        F.when(k % 40 == 1, "")
        .when(k % 40 == 2, "unknown")
        .otherwise(F.concat_ws("-", F.format_string("%04d", 1870 + (k * 7) % 170), month, day))
        .alias("BENE_BIRTH_DT"),
        F.when(k % 6 == 0, F.concat_ws("-", F.format_string("%04d", 1990 + k % 12), month, day))
        .otherwise("")
        .alias("BENE_DEATH_DT"),
        (k % 4).cast("string").alias("SEX_IDENT_CD"),
        F.when(k % 50 == 3, "").otherwise((1994 + k % 8).cast("string")).alias(
            "BENE_ENROLLMT_REF_YR"
        ),
        (k % 125 - 3).cast("string").alias("AGE_AT_END_REF_YR"),
    )


# -- authorizations -----------------------------------------------------------

view(
    "authorizations",
    """
    SELECT CASE WHEN o_orderkey % 211 = 0 THEN '' WHEN o_orderkey % 113 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS authorization_id,
           CASE WHEN o_orderkey % 307 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS bene_id,
           CASE WHEN o_orderkey % 151 = 0 THEN NULL WHEN o_orderkey % 71 = 0 THEN '12345' WHEN o_orderkey % 13 = 0 THEN printf('1%09d.0', o_custkey % 60) ELSE printf('1%09d', o_custkey % 60) END AS provider_id,
           CASE WHEN o_orderkey % 131 = 0 THEN '' ELSE printf('SVC%d', o_orderkey % 12) END AS service_code,
           CASE WHEN o_orderkey % 173 = 0 THEN NULL ELSE o_orderdate END AS request_date,
           CASE WHEN o_orderkey % 10 = 0 OR o_orderstatus = 'O' THEN NULL
                WHEN o_orderkey % 83 = 0 THEN o_orderdate - INTERVAL 5 HOUR
                ELSE o_orderdate + INTERVAL 1 MINUTE * CAST((o_orderkey % 100) * 60 + o_orderkey % 60 AS BIGINT) END AS approval_date,
           CASE WHEN o_orderkey % 9 = 0 THEN 'Expired' WHEN o_orderkey % 103 = 0 THEN 'Unknown' WHEN o_orderstatus = 'F' THEN 'Approved' WHEN o_orderstatus = 'O' THEN 'Pending' WHEN o_orderkey % 4 = 0 THEN 'Pending' WHEN o_orderkey % 4 = 1 THEN 'Denied' ELSE 'Cancelled' END AS status,
           CASE WHEN o_orderkey % 18 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 90 AS BIGINT) END AS expiry_date,
           CASE WHEN o_orderkey % 59 = 0 THEN 'asap' WHEN o_orderpriority = '1-URGENT' THEN 'Urgent' WHEN o_orderpriority = '2-HIGH' THEN 'Emergency' ELSE 'Routine' END AS urgency,
           strftime(o_orderdate, '%Y%m') AS batch_id
    FROM orders
    """,
)


def authorizations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as prior authorizations with derived turnaround and defects."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    custom = F.col("o_custkey") % 60
    minutes = (k % 100) * 60 + k % 60

    zero = F.lit(0)

    def later(days=zero, hours=zero, minutes=zero):
        return day + F.make_dt_interval(
            days.cast("int"), hours.cast("int"), minutes.cast("int"), F.lit(0).cast("decimal(18,6)")
        )

    return table(spark, sf, "orders").select(
        F.when(k % 211 == 0, "")
        .when(k % 113 == 0, (k + 1).cast("string"))
        .otherwise(k.cast("string"))
        .alias("authorization_id"),
        F.when(k % 307 != 0, F.col("o_custkey").cast("string")).alias("bene_id"),
        F.when(k % 151 == 0, F.lit(None).cast("string"))
        .when(k % 71 == 0, "12345")
        .when(k % 13 == 0, F.format_string("1%09d.0", custom))
        .otherwise(coded("1", custom, 60, 9))
        .alias("provider_id"),
        F.when(k % 131 == 0, "").otherwise(coded("SVC", k % 12, 12)).alias("service_code"),
        F.when(k % 173 != 0, day).alias("request_date"),
        F.when((k % 10 == 0) | (F.col("o_orderstatus") == "O"), F.lit(None))
        .when(k % 83 == 0, later(hours=F.lit(-5)))
        .otherwise(later(minutes=minutes))
        .alias("approval_date"),
        F.when(k % 9 == 0, "Expired")
        .when(k % 103 == 0, "Unknown")
        .when(F.col("o_orderstatus") == "F", "Approved")
        .when(F.col("o_orderstatus") == "O", "Pending")
        .when(k % 4 == 0, "Pending")
        .when(k % 4 == 1, "Denied")
        .otherwise("Cancelled")
        .alias("status"),
        F.when(k % 18 != 0, later(days=k % 90)).alias("expiry_date"),
        F.when(k % 59 == 0, "asap")
        .when(F.col("o_orderpriority") == "1-URGENT", "Urgent")
        .when(F.col("o_orderpriority") == "2-HIGH", "Emergency")
        .otherwise("Routine")
        .alias("urgency"),
        F.date_format(day, "yyyyMM").alias("batch_id"),
    )


# -- prescriber drugs, drug list, annual totals -------------------------------

STATES = ("AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "XX")

view(
    "prescriber_drug",
    """
    SELECT printf('1%09d', l_suppkey) AS Prscrbr_NPI, max(s_name) AS Prscrbr_Last_Org_Name,
           CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE printf('First%d', l_suppkey % 7) END AS Prscrbr_First_Name,
           printf('City%d', l_suppkey % 13) AS Prscrbr_City,
           (['AL','AK','AZ','AR','CA','CO','CT','DE','FL','GA','XX'])[1 + l_suppkey % 11] AS Prscrbr_State_Abrvtn,
           CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE printf('%02d', l_suppkey % 11) END AS Prscrbr_State_FIPS,
           printf('Specialty%d', CASE WHEN p_type = 'ECONOMY' THEN l_suppkey % 2 ELSE l_suppkey % 6 END) AS Prscrbr_Type,
           CASE WHEN l_suppkey % 4 = 0 THEN 'NPPES-Taxonomy' WHEN l_suppkey % 29 = 1 THEN 'Guess' ELSE 'Claim-Specialty' END AS Prscrbr_Type_Src,
           p_brand AS Brnd_Name, p_type AS Gnrc_Name,
           count(*) AS Tot_Clms, sum(l_quantity) / 32 AS Tot_30day_Fills, sum(l_quantity) AS Tot_Day_Suply,
           sum(l_extendedprice) AS Tot_Drug_Cst,
           CASE WHEN l_suppkey % 31 = 5 THEN NULL ELSE count(DISTINCT l_orderkey) END AS Tot_Benes,
           CASE WHEN l_suppkey % 9 = 0 THEN '*' WHEN l_suppkey % 37 = 3 THEN '?' ELSE '' END AS GE65_Sprsn_Flag,
           CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) + CASE WHEN l_suppkey % 43 = 4 THEN 9 ELSE 0 END END AS GE65_Tot_Clms
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY l_suppkey, p_brand, p_type
    """,
)


def prescriber_drug(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by supplier, brand and type as prescriber-drug rows.

    Lines travel to their supplier, brand and type once, and meet the supplier when they are
    added up; its name would have them sorted, as a text among the measures.
    """
    li, p, s = (table(spark, sf, n) for n in ("lineitem", "part", "supplier"))
    names = s.groupBy("s_suppkey").agg(F.max("s_name").alias("name"), F.count(F.lit(1)).alias("copies"))
    k, keys = F.col("l_suppkey"), ["l_suppkey", "p_brand", "p_type"]
    j = li.join(p, li.l_partkey == p.p_partkey).select(*keys, "l_orderkey", "l_quantity", "l_extendedprice")
    lines = j.filter(k.isNotNull()).repartition(*keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum("l_quantity").alias("qty"),
        F.sum("l_extendedprice").alias("cost"),
        F.countDistinct("l_orderkey").alias("benes"),
        F.sum(F.when(F.col("l_quantity") > 20, 1).otherwise(0)).alias("ge65"),
    )
    # A supplier found twice has its lines twice.
    g = lines.join(names, k == F.col("s_suppkey")).withColumns(
        {c: F.col(c) * F.col("copies") for c in ("claims", "qty", "cost", "ge65")}
    )
    return g.select(
        provider_number("l_suppkey").alias("Prscrbr_NPI"),
        F.col("name").alias("Prscrbr_Last_Org_Name"),
        F.when(k % 3 != 0, coded("First", k % 7, 7)).alias("Prscrbr_First_Name"),
        coded("City", k % 13, 13).alias("Prscrbr_City"),
        F.element_at(F.array(*[F.lit(x) for x in STATES]), (1 + k % 11).cast("int")).alias(
            "Prscrbr_State_Abrvtn"
        ),
        F.when(k % 17 != 0, coded("", k % 11, 11, 2)).alias("Prscrbr_State_FIPS"),
        coded(
            "Specialty", F.when(F.col("p_type") == "ECONOMY", k % 2).otherwise(k % 6), 6
        ).alias("Prscrbr_Type"),
        F.when(k % 4 == 0, "NPPES-Taxonomy")
        .when(k % 29 == 1, "Guess")
        .otherwise("Claim-Specialty")
        .alias("Prscrbr_Type_Src"),
        F.col("p_brand").alias("Brnd_Name"),
        F.col("p_type").alias("Gnrc_Name"),
        F.col("claims").alias("Tot_Clms"),
        (F.col("qty") / 32).alias("Tot_30day_Fills"),
        F.col("qty").alias("Tot_Day_Suply"),
        F.col("cost").alias("Tot_Drug_Cst"),
        F.when(k % 31 != 5, F.col("benes")).alias("Tot_Benes"),
        F.when(k % 9 == 0, "*").when(k % 37 == 3, "?").otherwise("").alias("GE65_Sprsn_Flag"),
        F.when(
            k % 9 != 0, F.col("ge65") + F.when(k % 43 == 4, 9).otherwise(0)
        ).alias("GE65_Tot_Clms"),
    )


view(
    "drug_list",
    """
    SELECT p_brand AS drug_name, p_type AS generic_name,
           CASE WHEN min(p_size) % 5 = 0 THEN 'Y' ELSE 'N' END AS opioid_flag,
           CASE WHEN max(p_size) % 7 = 0 THEN 'y ' ELSE 'N' END AS la_opioid_flag,
           CASE WHEN length(p_brand) = 7 THEN 'Y' ELSE 'N' END AS antibiotic_flag,
           CASE WHEN p_brand LIKE '%3' THEN 'Y' ELSE 'N' END AS antipsychotic_flag,
           CASE WHEN count(*) % 4 = 0 THEN 'Y' ELSE 'N' END AS ndc_conflict_flag
    FROM part GROUP BY p_brand, p_type
    """,
)


def drug_list(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by brand and type as the flagged drug list."""

    def flag(condition, yes="Y"):
        return F.when(condition, yes).otherwise("N")

    g = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        F.col("p_brand").alias("drug_name"),
        F.col("p_type").alias("generic_name"),
        flag(F.col("lo") % 5 == 0).alias("opioid_flag"),
        flag(F.col("hi") % 7 == 0, "y ").alias("la_opioid_flag"),
        flag(F.length("p_brand") == 7).alias("antibiotic_flag"),
        flag(F.col("p_brand").like("%3")).alias("antipsychotic_flag"),
        flag(F.col("n") % 4 == 0).alias("ndc_conflict_flag"),
    )


view(
    "grand_totals",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS calendar_year, count(*) AS total_claims,
           sum(o_totalprice) / 1000 AS total_standardized_30_day_fills,
           sum(o_totalprice) AS total_drug_cost,
           count(DISTINCT o_custkey) AS total_beneficiaries,
           count(DISTINCT o_custkey % 97) AS total_prescribers,
           sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS total_claims_for_antibiotic_drugs,
           sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS total_claims_for_antipsychotic_drugs_age65plus,
           sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS total_claims_for_opioid_drugs,
           sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS total_claims_for_la_opioid_drugs
    FROM orders GROUP BY 1
    """,
)


def grand_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by year as the annual program totals."""

    def having(priority):
        return F.sum(F.when(F.col("o_orderpriority") == priority, 1).otherwise(0))

    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("calendar_year")).agg(
        F.count(F.lit(1)).alias("total_claims"),
        (F.sum("o_totalprice") / 1000).alias("total_standardized_30_day_fills"),
        F.sum("o_totalprice").alias("total_drug_cost"),
        F.countDistinct("o_custkey").alias("total_beneficiaries"),
        F.countDistinct(F.col("o_custkey") % 97).alias("total_prescribers"),
        having("1-URGENT").alias("total_claims_for_antibiotic_drugs"),
        having("2-HIGH").alias("total_claims_for_antipsychotic_drugs_age65plus"),
        having("3-MEDIUM").alias("total_claims_for_opioid_drugs"),
        having("5-LOW").alias("total_claims_for_la_opioid_drugs"),
    )


# -- run log and weekly batches -------------------------------------------------

view(
    "run_log",
    """
    SELECT CAST(event_id // 2 AS VARCHAR) AS run_id,
           CASE event_type WHEN 'click' THEN 'run_claims_checks' WHEN 'view' THEN 'load_claims' WHEN 'error' THEN 'data_quality' ELSE event_type END AS step_name,
           CASE WHEN event_id % 41 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
           ts AS started_at, ts AS completed_at,
           CASE WHEN event_id % 53 = 0 THEN NULL ELSE value * 60 END AS duration_seconds,
           user_id AS records_processed, event_type AS dataset_name,
           strftime(ts, '%Y%m%d') AS batch_id
    FROM events
    """,
)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as finished steps; two events share a run."""
    e = table(spark, sf, "events")
    return e.select(
        F.floor(F.col("event_id") / 2).cast("string").alias("run_id"),
        F.when(F.col("event_type") == "click", "run_claims_checks")
        .when(F.col("event_type") == "view", "load_claims")
        .when(F.col("event_type") == "error", "data_quality")
        .otherwise(F.col("event_type"))
        .alias("step_name"),
        F.when(F.col("event_id") % 41 == 0, "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("completed_at"),
        F.when(F.col("event_id") % 53 != 0, F.col("value") * 60).alias("duration_seconds"),
        F.col("user_id").alias("records_processed"),
        F.col("event_type").alias("dataset_name"),
        F.date_format("ts", "yyyyMMdd").alias("batch_id"),
    )


view(
    "dme_lines",
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS CLM_ID, o_orderdate AS CLM_FROM_DT,
           date_trunc('week', l_shipdate) AS NCH_WKLY_PROC_DT,
           l_extendedprice AS LINE_SBMTD_CHRG_AMT, l_extendedprice * (1 - l_discount) AS LINE_ALOWD_CHRG_AMT,
           CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE printf('H%04d', l_partkey % 20) END AS HCPCS_CD
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)


def dme_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a weekly processing date."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("CLM_ID"),
        F.col("o_orderdate").alias("CLM_FROM_DT"),
        F.date_trunc("week", "l_shipdate").alias("NCH_WKLY_PROC_DT"),
        F.col("l_extendedprice").alias("LINE_SBMTD_CHRG_AMT"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("LINE_ALOWD_CHRG_AMT"),
        F.when(F.col("l_partkey") % 10 != 0, F.format_string("H%04d", F.col("l_partkey") % 20)).alias(
            "HCPCS_CD"
        ),
    )
