import os

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
# A spread over the sections; tests/check_queries.py compares all of them.
SOME = (
    "pl04_provider_volume_risk",
    "pl10_claim_run_sla",
    "dq_c_claim_rules",
    "da17_record_scores",
)


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("key", SOME)
def test_query_matches_sql(spark, key):
    problem = compare(entry.queries()[key](spark, SF), connect(SF), entry.oracle_sql()[key])
    assert problem is None, problem


@needs_data
@pytest.mark.parametrize("key", ["pl12_auth_run_summary"])
def test_rerun_under_other_partitioning(spark, key):
    query = entry.queries()[key]
    before = sorted(map(repr, query(spark, SF).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(repr, query(spark, SF).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
