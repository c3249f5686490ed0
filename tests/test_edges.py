"""E2E1 edges: the pre-aggregated join equals the naive record-pair join; hot
keys of either side are split; Q2 key rules; LIM1; AGG4-8; E2E3 sweep."""

import random

import pytest
from pyspark.sql import functions as F

from cobi.operators import edges as E
from cobi.operators.sweep import sweep_edges
from tests.conftest import rows, table


def naive_edges(a_rows, b_rows, min_a=0, min_b=1):
    """Brute force: every record pair sharing a key, counted."""
    from collections import Counter
    w = Counter()
    for ka, fa in a_rows:
        if ka is None or fa is None or ka < min_a:
            continue
        for kb, pb in b_rows:
            if kb is None or pb is None or kb < min_b:
                continue
            if ka == kb:
                w[(fa, pb)] += 1
    return sorted((f, p, float(c)) for (f, p), c in w.items())


def test_random_property_preaggregation_equals_naive(spark):
    rnd = random.Random(7)
    a_rows = [(rnd.randint(-1, 6), rnd.choice("abcde")) for _ in range(200)]
    b_rows = [(rnd.randint(-1, 6), rnd.choice("uvwxyz")) for _ in range(300)]
    a = spark.createDataFrame(a_rows, "ka long, fa string")
    b = spark.createDataFrame(b_rows, "kb long, pb string")
    want = naive_edges(a_rows, b_rows)
    got = rows(E.build_edges(a, b, "ka", "kb", "fa", "pb"))
    assert got == want
    # swapping A and B transposes the edges (with the key rules swapped too)
    swapped = rows(E.build_edges(b, a, "kb", "ka", "pb", "fa", min_key_a=1, min_key_b=0))
    assert sorted((p, f, w) for f, p, w in want) == swapped


@pytest.mark.parametrize("hot", ["left", "right"])
def test_hot_key_of_either_side_is_split(spark, hot):
    """One key with very many values: Spark cuts its partition in several
    tasks, whichever side it is on; nothing is cached while the plan is built."""
    many = spark.range(40000).select(
        F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id") % 50).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("n"))
    few = spark.range(1, 50).select(F.col("id").alias("k"), F.lit("x").alias("n"))
    a, b = (many, few) if hot == "left" else (few, many)
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
                "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        edges = E.build_edges(a, b, "k", "k", "n", "n")
        assert edges.agg(F.sum("weight")).first()[0] == many.filter("k > 0").count()
        edges.collect()
        assert "skew=true" in edges._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_products_beyond_a_long(spark, monkeypatch):
    big = spark.createDataFrame([(1, 10**10)], "key long, n long")
    monkeypatch.setattr(E, "key_value_counts", lambda side, name: side.select("key", "node").join(
        big.withColumnRenamed("n", name), "key"))
    t = spark.createDataFrame([(1, "a")], "k long, v string")
    assert rows(E.build_edges(t, t, "k", "k", "v", "v")) == [("a", "a", 1e20)]


def test_segment_priority_totals(spark):
    e = E.build_edges(table(spark, "customer"), table(spark, "orders"), "c_custkey", "o_custkey",
                      "c_mktsegment", "o_orderpriority")
    n, total = e.agg(F.count("*"), F.sum("weight")).first()
    assert n == 25
    zero = table(spark, "orders").filter("o_custkey = 0").count()
    assert total == table(spark, "orders").count() - zero      # key 0 never joins (Q2)


def test_string_keys_compare_as_strings(spark):
    a = spark.createDataFrame([("7", "f"), ("007", "g"), ("12.0", "h")], "k string, n string")
    b = spark.createDataFrame([(7, "p")], "k long, n string")
    assert rows(E.build_edges(a, b, "k", "k", "n", "n")) == [("f", "p", 1.0)]
    ends = spark.createDataFrame([("7\n", "f"), ("7", "g")], "k string, n string")
    assert rows(E.build_edges(ends, b, "k", "k", "n", "n")) == [("g", "p", 1.0)]


def test_limit_empty_and_sizes(spark):
    c, o = table(spark, "customer"), table(spark, "orders")
    capped = E.build_edges(c, o, "c_custkey", "o_custkey", "c_mktsegment", "o_orderpriority",
                           limit_b=100, order_b=["o_orderkey"])
    assert capped.agg(F.sum("weight")).first()[0] <= 100
    empty = E.build_edges(c.filter("c_custkey < 0"), o, "c_custkey", "o_custkey",
                          "c_mktsegment", "o_orderpriority")
    assert empty.isEmpty() and empty.columns == E.EDGE_COLUMNS
    e = E.build_edges(table(spark, "part"), table(spark, "lineitem"), "p_partkey", "l_partkey",
                      "p_brand", "l_returnflag")
    size = E.graph_size(e).first()
    nodes = E.node_sets(e)
    assert size.n_rows == nodes.filter("side = 'row'").count()
    assert size.n_cols == nodes.filter("side = 'column'").count()
    assert size.n_edges == e.count()
    top = E.top_edges(e, 3).collect()
    assert [r.weight for r in top] == sorted([r.weight for r in e.collect()], reverse=True)[:3]


def test_inverted_index_flat(spark):
    c = table(spark, "customer")
    idx = E.inverted_index(c, "c_custkey", "c_mktsegment", ["c_custkey"])
    assert idx.count() == c.count()
    pdf = c.toPandas().sort_values("c_custkey").reset_index(drop=True)
    got = {r.row_id: (r.node, r.key) for r in idx.collect()}
    for i, r in pdf.iterrows():
        assert got[i] == (r.c_mktsegment, r.c_custkey)


def test_sweep_equals_single_pairs(spark):
    c, o = table(spark, "customer"), table(spark, "orders")
    sw = sweep_edges(c, o, "c_custkey", "o_custkey")
    pairs = {(r.column_a, r.column_b) for r in sw.select("column_a", "column_b").distinct().collect()}
    assert pairs == {(a, b) for a in ("c_name", "c_mktsegment")
                     for b in ("o_orderstatus", "o_orderpriority")}
    one = E.build_edges(c, o, "c_custkey", "o_custkey", "c_mktsegment", "o_orderstatus")
    got = sw.filter("column_a = 'c_mktsegment' AND column_b = 'o_orderstatus'")
    assert rows(got, *E.EDGE_COLUMNS) == rows(one)
