"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from weftgraph.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SAMPLE = "gq01_bfs_unreached gq03_pagerank_leaking gq16_components agg04_degrees agg05_degree_describe win02_offsets scl03_next_hop scl12_cost_torus lay05_channels set04_edge_differences trf05_csr acc01_messages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(rows):
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalog.ORACLE[name]})").fetchall()
    assert plain(map(tuple, got.collect())) == plain(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
