"""Result runs over the stand-ins, which reports read.

A run of a domain writes all its result tables; a report that comes before it has the
tables it reads written, each by a run of its own.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from payerlens.catalog import pharmacy as PH
from payerlens.catalog import standins as S
from payerlens.catalog.registry import query, table
from payerlens.operators.stages import application_folder, new_stage
from payerlens.plans import auth_quality as A
from payerlens.plans import claims_anomaly as CA
from payerlens.plans import claims_quality as Q
from payerlens.plans import drug_anomaly as DA
from payerlens.plans import pharmacy_quality as PQ
from payerlens.plans import pharmacy_volume as PV
from payerlens.plans import risk as R
from payerlens.plans import sla
from payerlens.plans import volume as V
from payerlens.sources.store import ResultStore

#: The runs' start; it stands for the schedule's time.
STARTED = datetime(2025, 1, 31, 8, 0)
TODAY = "2001-07-20"


def _claims(spark, sf):
    from payerlens.catalog.anomaly import lines

    def quality(read):
        people = Q.prepare_beneficiaries(S.beneficiary(spark, sf))
        return Q.provider_completeness(Q.prepare(S.claims_text(spark, sf), people), "PRF_PHYSN_NPI", "carrier")

    return {
        "valid_claims": lambda read: V.valid_claims(S.claim_lines(spark, sf)),
        "rolling_history": lambda read: V.rolling_history(V.monthly_volume(read("valid_claims"))),
        "provider_volume_risk": lambda read: V.provider_volume_risk(read("rolling_history")),
        "claim_behavior": lambda read: sla.claim_behavior(
            read("rolling_history").withColumnsRenamed({"period": "current_period", "monthly_volume": "current_month_volume"})
        ),
        "claim_runs": lambda read: sla.claim_runs(S.run_log(spark, sf)),
        "claim_quality": quality,
        "claims_anomalies": lambda read: CA.claims_anomalies(lines(spark, sf))["claims_anomalies"],
        "claim_provider_risk": lambda read: R.claim_provider_risk(
            read("provider_volume_risk"), read("claim_quality"), read("claims_anomalies")
        ),
    }


def _pharmacy(spark, sf):
    return {
        "prescriptions": lambda read: PH.prescriptions(spark, sf),
        "drug_peer_risk": lambda read: PV.drug_peer_risk(read("prescriptions")),
        "provider_peer_risk": lambda read: PV.provider_peer_risk(read("prescriptions")),
        "pharmacy_quality": lambda read: PQ.provider_quality(S.prescriber_drug(spark, sf))["provider_dq_summary"],
        "drug_anomalies": lambda read: DA.drug_anomalies(
            S.prescriber_drug(spark, sf), S.drug_list(spark, sf), S.grand_totals(spark, sf)
        )["drug_anomalies"],
        "pharmacy_provider_risk": lambda read: R.pharmacy_provider_risk(
            read("pharmacy_quality"), read("provider_peer_risk"), PV.provider_drug_detail(read("prescriptions")), read("drug_peer_risk")
        ),
    }


def _authorization(spark, sf):
    quality = {}

    def quality_table(name):
        def build(read):
            if not quality:
                quality.update(A.auth_quality(S.authorizations(spark, sf), TODAY, run_id="run"))
            return quality[name]

        return build

    return {
        "auth_requests": lambda read: sla.auth_requests(S.authorizations(spark, sf)),
        "auth_volume_risk": lambda read: V.auth_volume_risk(V.auth_monthly_volume(S.authorizations(spark, sf))),
        "auth_metrics": lambda read: sla.auth_provider_metrics(read("auth_requests")),
        "auth_rules": quality_table("rules"),
        "auth_providers": quality_table("providers"),
    }


DOMAINS = {"claims": _claims, "pharmacy": _pharmacy, "authorization": _authorization}
TABLES = {
    "claims": (
        "valid_claims", "rolling_history", "provider_volume_risk", "claim_behavior", "claim_runs", "claim_quality", "claims_anomalies", "claim_provider_risk",
    ),
    "pharmacy": ("prescriptions", "drug_peer_risk", "provider_peer_risk", "pharmacy_quality", "drug_anomalies", "pharmacy_provider_risk"),
    "authorization": ("auth_requests", "auth_volume_risk", "auth_metrics", "auth_rules", "auth_providers"),
}
DOMAIN_OF = {name: domain for domain, names in TABLES.items() for name in names}


def store(spark, sf) -> ResultStore:
    """The store of one set of input tables."""
    return ResultStore(spark, f"{application_folder(spark)}/results-{hashlib.sha256(sf.encode()).hexdigest()[:12]}")


def run_domain(spark, sf, domain: str) -> str:
    """One run that writes all result tables of a domain."""
    return store(spark, sf).run(domain, DOMAINS[domain](spark, sf), STARTED, [sf])


def run_table(spark, sf, name: str) -> str:
    """One run that writes one result table; the tables it reads are the stored ones."""
    domain = DOMAIN_OF[name]
    build = DOMAINS[domain](spark, sf)[name]
    # Tables below this one are asked for when it is built, before its own run becomes visible.
    alone = {name: lambda _: build(lambda other: stored(spark, sf, other))}
    return store(spark, sf).run(f"{domain}-{name}", alone, STARTED, [sf])


def stored(spark, sf, name: str):
    """The latest result table; where the session has none yet, it and what it reads are made first."""
    results = store(spark, sf)
    if results.latest_run(name) is None:
        run_table(spark, sf, name)
    return results.latest(name)


# -- the store itself -------------------------------------------------------------


@query("snk03_snk04_fl06_latest_finished_run", """
    SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CAST(max(o_orderkey) AS BIGINT) AS last_key
    FROM orders WHERE o_orderdate < DATE '1997-01-01' GROUP BY 1""")
def _(spark, sf):
    """Two finished runs and a failed later one: the second is read; a repeated run replaces its part."""
    results, orders = ResultStore(spark, new_stage(spark)), table(spark, sf, "orders")

    def totals(until):
        def build(read):
            return read("base").filter(F.col("o_orderdate") < F.lit(until).cast("date")).groupBy(F.col("o_orderstatus").alias("status")).agg(
                F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").cast("bigint").alias("last_key")
            )

        return build

    base = {"base": lambda read: orders}
    for year in (1995, 1996, 1997):
        for _ in range(2 if year == 1997 else 1):
            results.run("orders", base | {"totals": totals(f"{year}-01-01")}, datetime(year, 1, 1))
    try:
        results.run("orders", base | {"totals": totals("1999-01-01"), "broken": lambda read: read("missing")}, datetime(1999, 1, 1))
    except Exception as failure:  # the run that fails half way stays unseen
        if "missing" not in str(failure):
            raise
    return results.latest("totals")


@query("snk06_schema_versions", """
    SELECT 1 AS version, CAST(o_orderkey AS BIGINT) AS order_key, o_orderstatus AS status, o_totalprice AS amount, NULL::VARCHAR AS priority FROM orders WHERE o_orderdate < DATE '1995-01-01'
    UNION ALL SELECT 2, CAST(o_orderkey AS BIGINT), o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate >= DATE '1995-01-01'""")
def _(spark, sf):
    """Two versions of a table in one store: a renamed, an added and an obsolete column."""
    results, orders = ResultStore(spark, new_stage(spark)), table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("bigint").alias("order_key")
    first = orders.filter("o_orderdate < '1995-01-01'").select(
        F.lit(1).alias("version"), key, F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit("old").alias("clerk_note")
    )
    second = orders.filter("o_orderdate >= '1995-01-01'").select(
        F.lit(2).alias("version"), key, F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority")
    )
    for number, rows in enumerate((first, second), 1):
        results.run("orders", {"orders": lambda read, rows=rows: rows}, datetime(2024, number, 1), version=number)
    return results.history("orders", renamed={"price": "amount"}, obsolete=["clerk_note"]).select(
        "version", "order_key", "status", "amount", "priority"
    )


@query("pl18_snk08_audit_rows", """
    SELECT * FROM (VALUES ('auth_requests', 'SUCCESS', true), ('auth_volume_risk', 'SUCCESS', true), ('auth_metrics', 'SUCCESS', true),
      ('auth_rules', 'SUCCESS', true), ('auth_providers', 'SUCCESS', true)) t(step_name, status, timed)""")
def _(spark, sf):
    """One audit row a step of a run over the given tables."""
    results = ResultStore(spark, new_stage(spark))
    results.run("authorization", _authorization(spark, sf), STARTED, [sf])
    audit = spark.read.parquet(results.path("_audit"))
    return audit.select("step_name", "status", (F.col("duration_seconds") >= 0).alias("timed"))
