"""Queries against DuckDB on the smallest tables."""

import importlib
import math
import os

import duckdb
import pytest

from meshwright.plans import CORE_MODULES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
PAIRS = {n: (m.QUERIES[n], m.SQL[n]) for m in map(importlib.import_module, CORE_MODULES) for n in m.SQL}
PICKED = [
    "p2_found", "merc_y", "ll2px", "channels", "aligned", "polyline_len", "g_degree", "g_components", "g_eff", "g_node_bc", "g_edge_bc", "g_density",
    "g_angle", "whatif_resilience", "ras_blend", "ras_tta8", "ras_close", "ras_hyst", "ras_shift", "agg_sweep", "agg_relaxed", "agg_board", "snk_manifest", "flt_exclude", "snk_jsonl",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", PICKED)
def test_same_rows(spark, duck, name):
    build, sql = PAIRS[name]
    df = build(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries().keys() >= PAIRS.keys()


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True)
    assert run.returncode == 0 and int(run.stdout) >= len(PAIRS)
