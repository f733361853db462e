import os

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, connect
from tests.test_catalog import SF, needs_data

CLAIMS = {"valid_claims", "rolling_history"}


@needs_data
@pytest.mark.parametrize(
    ("key", "read"),
    [
        ("rp31_trend_facts", CLAIMS),
        ("rp13_tk03_volume_top", CLAIMS | {"provider_volume_risk"}),
        ("rp04_tk01_top_drugs", {"prescriptions"}),
        ("rp10_claim_type_month_counts", {"claims_anomalies"}),
    ],
)
def test_a_report_writes_the_tables_it_reads(spark, tmp_path, key, read):
    queries = entry.queries()
    from payerlens.catalog import results

    data = tmp_path / "data"
    data.symlink_to(SF)  # a folder of its own, for which nothing is stored yet
    df = queries[key](spark, str(data))
    assert compare(df, connect(SF), entry.oracle_sql()[key]) is None
    written = {r for row in results.store(spark, str(data)).runs().collect() for r in row["tables"]}
    assert written == read


@needs_data
def test_stored_tables_are_those_of_a_whole_run(spark, tmp_path, rows):
    entry.queries()
    from payerlens.catalog import results

    one, all_of_them = tmp_path / "one", tmp_path / "all"
    for folder in (one, all_of_them):
        os.symlink(SF, folder)
    results.run_domain(spark, str(all_of_them), "claims")
    for name in ("claim_behavior", "provider_volume_risk"):
        assert rows(results.stored(spark, str(one), name)) == rows(results.stored(spark, str(all_of_them), name))
