import pytest
from pyspark.sql import functions as F

from payerlens.functions import bands as B
from payerlens.functions import clean as C
from payerlens.functions import codes, dates
from payerlens.functions.text import first_match, fixed, names_at_least, strongest


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("text", ["", " ", "nan", "NaN", "None", None, "\t"])
def test_blank(spark, text):
    value = F.lit(text).cast("string")
    assert one(spark, C.is_blank(value)) is (text != "\t")


@pytest.mark.parametrize(
    "text,value", [("1.5", 1.5), ("NaN", None), ("x", None), ("", None), (" 2 ", 2.0), (None, None)]
)
def test_number(spark, text, value):
    assert one(spark, C.number(F.lit(text).cast("string"))) == value


def test_identifiers(spark):
    assert one(spark, C.npi(F.lit(" 1234567890.0 "))) == "1234567890"
    assert one(spark, C.strip_minus(F.lit("--007"))) == "007"
    assert one(spark, C.npi_digits(F.lit("12a.0"))) == "12a.0"


def test_clip_keeps_null(spark):
    assert one(spark, C.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, C.clip(F.lit(3.0), 0.0, 1.0)) == 1.0


@pytest.mark.parametrize(
    "text,day",
    [
        ("20150930", "2015-09-30"),
        ("2015-9-3", "2015-09-03"),
        ("10/01/2015", "2015-10-01"),
        ("01-OCT-2015", "2015-10-01"),
        ("01-Oct-2015 ", "2015-10-01"),
        ("2015-13-40", None),
        ("soon", None),
        ("", None),
    ],
)
def test_dates(spark, text, day):
    assert one(spark, dates.parse_date(F.lit(text)).cast("string")) == day


def test_icd_cutover(spark):
    day = lambda d: codes.icd_version_on(F.lit(d).cast("date"))
    assert one(spark, day("2015-09-30")) == "9"
    assert one(spark, day("2015-10-01")) == "0"
    assert one(spark, day(None)) is None


@pytest.mark.parametrize(
    "code,version,ok",
    [("A01", "0", True), ("A01.1234", "10", True), ("A0", "0", False), ("123.45", "9", True),
     ("E12", "9", True), ("12", "9", False), ("??", "7", True), ("", "0", True), (None, "0", True)],
)
def test_diagnosis(spark, code, version, ok):
    assert one(spark, codes.valid_diagnosis(F.lit(code).cast("string"), F.lit(version))) is ok


@pytest.mark.parametrize(
    "band,value,result",
    [
        (B.VOLUME_DEVIATION_RISK, 5.0, 0.0), (B.VOLUME_DEVIATION_RISK, 5.01, 0.2),
        (B.VOLUME_DEVIATION_RISK, 30.0, 0.8), (B.VOLUME_DEVIATION_RISK, None, None),
        (B.ZSCORE_RISK, 1.0, 40.0), (B.ZSCORE_RISK, -4.0, 0.0), (B.PERCENTILE_RISK, 95.0, 100.0),
        (B.CLAIM_RISK_LEVEL, 0.24, "LOW"), (B.CLAIM_RISK_LEVEL, 0.245, "MEDIUM"),
        (B.CLAIM_RISK_LEVEL, 0.74, "HIGH"), (B.PROVIDER_RISK_LEVEL, 0.25, "Low"),
        (B.PROVIDER_RISK_LEVEL, 0.250001, "Moderate"), (B.QUALITY_STATUS, 9.0, "excellent"),
        (B.AUTH_CATEGORY, 94.99, "Good"), (B.PSI_LABEL, 0.25, "SIGNIFICANT DRIFT"),
        (B.GAUGE, 0.1, "Very Good"), (B.DRUG_SEVERITY, 5.0, "HIGH"), (B.YEARLY_SEVERITY, 4.0, "MEDIUM"),
    ],
)
def test_band_edges(spark, band, value, result):
    assert one(spark, band(F.lit(value).cast("double"))) == result


def test_severity(spark):
    case = lambda *v: one(spark, B.claims_severity(*[F.lit(x).cast("double") for x in v]))
    assert case(1, None, None) == "LOW"
    assert case(1, 7.0, None) == "HIGH"
    assert case(1, None, 0.75) == "HIGH"
    assert case(2, 6.9, 0.1) == "MEDIUM"
    assert case(0, 9.0, 9.0) == "NORMAL"


def test_text_helpers(spark):
    parts = [("a", F.lit(1.0)), ("b", F.lit(2.0)), ("c", F.lit(2.0)), ("d", F.lit(None).cast("double"))]
    assert [e["name"] for e in one(spark, strongest(parts))] == ["b", "c", "a"]
    assert one(spark, names_at_least(parts, 1.5)) == "b, c"
    assert one(spark, fixed(F.lit(62.125), 2)) == "62.12"
    assert one(spark, fixed(F.lit(None).cast("double"), 2)) is None
    assert one(spark, first_match(F.lit("Missing_NPI"), [("npi", "n"), ("missing", "m")], F.lit("?"))) == "n"


def test_padded_numbers_are_those_of_formatting(spark):
    from payerlens.catalog.standins import coded, numbered

    df = spark.createDataFrame([(x,) for x in (0, 7, 999, 1000, 123456789, 1234567890123, -5, -123456, None)], "k long")
    got = df.select(
        "k", numbered("1", F.col("k"), 9).alias("a"), numbered("Q", F.col("k"), 3).alias("b"), coded("A", F.col("k") % 12, 12, 2).alias("c"), coded("City", F.col("k") % 13, 13).alias("d"),
        F.format_string("1%09d", "k").alias("wa"), F.format_string("Q%03d", "k").alias("wb"), F.format_string("A%02d", F.col("k") % 12).alias("wc"), F.format_string("City%d", F.col("k") % 13).alias("wd"),
    ).collect()
    assert all((r["a"], r["b"], r["c"], r["d"]) == (r["wa"], r["wb"], r["wc"], r["wd"]) for r in got)


def test_trimmed_ids_take_no_regular_expression(spark):
    texts = ["", " ", "12.0", "\t1.0.0 \n", "\x0b\f\r7\x0c", "a b", ".0", " .0 ", "1.00", "é.0", " x ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", r"^\s+|\s+$", "")
    got = df.select(C.trim_text("t").alias("a"), C.npi("t").alias("b"), old.alias("wa"), F.regexp_replace(old, r"\.0$", "").alias("wb"))
    assert all((r["a"], r["b"]) == (r["wa"], r["wb"]) for r in got.collect())
    assert "regexp" not in df.select(C.npi("t"))._jdf.queryExecution().executedPlan().toString()
