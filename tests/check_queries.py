"""Compare registered queries with their SQL: python tests/check_queries.py [prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from payerlens import session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    expected = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    order = sorted(names)
    family = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool"}
    duck = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
    for name, kind in df.dtypes:
        if family.get(kind, kind) != duck.get(kinds[name], kinds[name]):
            return f"type of {name}: {kind} vs {kinds[name]}"
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    idx = [names.index(c) for c in order]
    want = [tuple(plain(r[i]) for i in idx) for r in expected]
    a, b = Counter(map(repr, got)), Counter(map(repr, want))
    if a == b:
        return None
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return (
        f"rows {len(got)} vs {len(want)}; {len(only_a)} differ\n   {order}\n"
        f"   spark {sorted(only_a)[:2]}\n   sql   {sorted(only_b)[:2]}"
    )


def main(prefixes: list[str]) -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = session.build("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark._jvm.org.apache.logging.log4j.core.config.Configurator.setRootLevel(
        spark._jvm.org.apache.logging.log4j.Level.OFF
    )
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in sorted(queries):
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracles:
                problem = compare(df, con, oracles[key])
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        note = "" if key in oracles else " (no sql)"
        print(f"{'ok ' if problem is None else 'BAD'} {key}{note} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("   " + problem, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
