"""Driver contract: every query has a callable, oracles reference registered
queries, and the small relational queries agree with DuckDB at sf0.001."""

import duckdb

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

TABLES = "customer orders part lineitem supplier nation".split()
FAST = ["edges_weighted", "edges_missing_tokens", "edges_key_parse", "edges_top",
        "edges_limited", "sweep_edges", "inverted_index_a", "indexed_table", "record_nodes",
        "normalized_entries"]


def test_registry_shapes():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 25


def test_fast_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q, o = entry.queries(), entry.oracle_sql()
    for name in FAST:
        got = q[name](spark, SF_SMALL).toPandas()
        want = con.execute(o[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        g = sorted(map(tuple, got[cols].astype(str).values.tolist()))
        w = sorted(map(tuple, want[cols].astype(str).values.tolist()))
        assert g == w, name


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["side", "node", "cluster_no"]
    assert df.count() == 10
