"""Queries over files that are written from the tables, against their SQL."""

import os

import duckdb
import pytest

from plumbline.operators import detect
from plumbline.plans import registry, texts

NAMES = sorted(n for n in registry.QUERIES if n.startswith(("src_", "text_")) or n in ("trace_probes", "health_gate", "suppress_by_module", "module_argmax"))


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in ("customer", "part", "lineitem", "supplier", "events"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, sf, sql, name):
    df = registry.QUERIES[name](spark, sf)
    want = sql.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(map(str, map(tuple, df.select(*columns).collect())))
    assert got and got == sorted(map(str, want.fetchall()))


def test_both_ways_of_call_sites_agree(spark, sf):
    text = texts._code(lambda n: spark.read.parquet(f"{sf}/{n}.parquet"), "ruby", ".rb", texts._cat("é run(", texts._keys()[0], ") x\nab\nfetch run("))
    cat = texts._catalog(spark, ("ruby", "call", "run(", "exec"), ("ruby", "call", "ab", "env"), ("ruby", "call", "fetch", "network"), ("ruby", "call", "none", "network"))
    lines = detect.scan(text)
    few, many = (sorted(map(tuple, detect.match_calls(lines, cat, limit).collect())) for limit in (100, 0))
    assert few == many and len({r[4] for r in few}) == 3
