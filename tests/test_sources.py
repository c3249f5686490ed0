"""SRC1-SRC4, SNK1-SNK9, E2E4/E2E5 with a pair list and description files."""

import os

from pyspark.sql import functions as F

from cobi.operators.foldin import CoclusterModel, load_model
from cobi.plans.runs import run_pair, write_pair
from cobi.sources import sinks
from cobi.sources.describe import field_pairs, read_description, string_fields
from cobi.sources.pairs import parse_pairs, read_pairs, select_pair
from cobi.sources.publish import current
from cobi.sources.tables import TableResolver, read_tsv
from tests.conftest import SF_SMALL, rows, table


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_tsv_table(spark, tmp_out):
    p = os.path.join(tmp_out, "t.tsv")
    _write(p, 'id\tname\tgrp\tprice\tmix\n1\tsay "hi"\ta\t1.5\tx\n2\t\\N\t\tx\t7\n3\t na\tb\t2.0\t\n')
    df = read_tsv(spark, p)
    got = df.orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3]
    assert got[0].name == 'say "hi"'            # quotes stay part of the value
    assert got[1].name == "\\N" and got[1].grp is None   # token kept, empty -> null
    assert got[2].name == " na"
    assert dict(df.dtypes)["price"] == "string"  # 'x' makes the column a string


def test_pairs_and_descriptions(spark, tmp_out):
    pairs_path = os.path.join(tmp_out, "pairs.csv")
    _write(pairs_path, "PART.p_partkey,LINEITEM.l_partkey\ncustomer.C_CUSTKEY,Orders.o_custkey\n")
    pairs = read_pairs(spark, pairs_path)
    assert rows(pairs) == [(0, "PART", "p_partkey", "LINEITEM", "l_partkey"),
                           (1, "CUSTOMER", "c_custkey", "ORDERS", "o_custkey")]
    assert select_pair(pairs).first().table_a == "CUSTOMER"     # default pair number 1
    desc_path = os.path.join(tmp_out, "desc.txt")
    _write(desc_path, "c_custkey\tbigint\nc_mktsegment\t String \nc_name\tvarchar(25)\n")
    fields = [r.field_name for r in string_fields(read_description(spark, desc_path)).collect()]
    assert fields == ["c_mktsegment"]
    assert field_pairs(["a", "b"], ["x"]) == [("a", "x"), ("b", "x")]
    lines = spark.createDataFrame([("A.x,B.y",)], "value string")
    assert parse_pairs(lines).first().column_b == "y"


def test_run_pair_and_write(spark, tmp_out):
    os.makedirs(os.path.join(tmp_out, "desc"), exist_ok=True)
    _write(os.path.join(tmp_out, "desc", "CUSTOMER.txt"),
           "c_custkey\tbigint\nc_name\tstring\nc_mktsegment\tstring\n")
    _write(os.path.join(tmp_out, "desc", "ORDERS.txt"),
           "o_custkey\tbigint\no_orderstatus\tstring\no_orderpriority\tSTRING\n")
    resolver = TableResolver(SF_SMALL, desc_pattern=tmp_out + "/desc/{table}.txt")
    pairs = parse_pairs(spark.createDataFrame(
        [("PART.p_partkey,LINEITEM.l_partkey",), ("CUSTOMER.c_custkey,ORDERS.o_custkey",)],
        "value string"))
    sweep = run_pair(spark, pairs, resolver, 1)
    assert {r.column_a for r in sweep.select("column_a").distinct().collect()} == \
        {"c_name", "c_mktsegment"}
    one = sweep.filter("column_a = 'c_mktsegment' AND column_b = 'o_orderpriority'")
    edges = one.select("first_field", "second_field", "weight")
    out = write_pair(tmp_out + "/out", 1, "CUSTOMER", "c_mktsegment", "ORDERS", "o_orderpriority", edgelist=edges)
    back = spark.read.option("sep", "\t").option("header", True).csv(current(spark, out) + "/edgelist")
    assert back.columns == ["first_field", "Second_field", "Weight"]
    ws = [float(r.Weight) for r in back.collect()]
    assert ws == sorted(ws, reverse=True) and len(ws) == 25
    # two pairs written in turn: the second leaves the first, a repeat replaces it
    other = sweep.filter("column_a = 'c_mktsegment' AND column_b = 'o_orderstatus'")
    for part in (one, other, one):
        sinks.write_sweep(part, tmp_out + "/sweep")
    parts = spark.read.parquet(tmp_out + "/sweep")
    assert parts.count() == one.count() + other.count()


def test_live_run_to_files(spark, tmp_out):
    from cobi.__main__ import main
    spark.createDataFrame([(str(k % 7), "s" + str(k % 3), k) for k in range(60)], "id string, grp string, n long") \
        .write.parquet(tmp_out + "/t/a.parquet")
    spark.createDataFrame([(str(k % 7), "q" + str(k % 4)) for k in range(40)], "id string, kind string") \
        .write.parquet(tmp_out + "/t/b.parquet")
    _write(tmp_out + "/pairs.csv", "X.x,Y.y\nA.id,B.id\n")
    out = main([tmp_out + "/pairs.csv", tmp_out + "/t", tmp_out + "/out", "2"])
    names = sorted(os.path.basename(o) for o in out)
    assert names == sorted(f"1-A_{a}__B_{b}" for a in ("id", "grp") for b in ("id", "kind"))   # the key columns too
    for o in out:
        back = spark.read.option("sep", "\t").option("header", True).csv(current(spark, o) + "/edgelist")
        ws = [float(r.Weight) for r in back.collect()]
        assert ws and ws == sorted(ws, reverse=True)
    assert main([tmp_out + "/pairs.csv", tmp_out + "/t", tmp_out + "/out2", "2", "10", "1", "--edges-only"])
    small = spark.read.option("sep", "\t").option("header", True).csv(
        current(spark, tmp_out + "/out2/1-A_grp__B_kind") + "/edgelist")
    assert 0 < sum(float(r.Weight) for r in small.collect()) <= 10 * 60


def test_other_sinks(spark, tmp_out):
    from cobi.operators.cluster import kmeans_labels
    emb = spark.createDataFrame([("row", f"r{i}", [float(i % 2), 0.0]) for i in range(6)]
                                + [("column", "c", [1.0, 0.0])], "side string, node string, embedding array<double>")
    sinks.write_embedding(emb, tmp_out + "/e")
    sinks.write_embedding(emb, tmp_out + "/j", fmt="json")
    assert rows(spark.read.parquet(tmp_out + "/e").select("side", "node")) == rows(emb.select("side", "node"))
    assert spark.read.json(tmp_out + "/j").count() == 7
    sinks.write_table(emb, tmp_out + "/t")
    assert spark.read.parquet(tmp_out + "/t").columns == emb.columns
    res = kmeans_labels(emb, 2, runs=1)
    sinks.write_labels(res.labels, tmp_out + "/c", "column")
    assert spark.read.option("sep", "\t").option("header", True).csv(tmp_out + "/c").first().recordValue == "c"
    model = CoclusterModel(res.points.select("side", "node", "embedding", F.col("prediction").alias("cluster_no")),
                           [0.5, 0.4], res.model.centres)
    sinks.save_model(model, tmp_out + "/m")
    model.sigma[0] = 0.6
    sinks.save_model(model, tmp_out + "/m")
    back = load_model(spark, tmp_out + "/m")
    assert back.k == 2 and back.sigma == [0.6, 0.4] and back.nodes.count() == 7


def test_label_and_indexed_sinks(spark, tmp_out):
    labels = spark.createDataFrame([("row", "b", 1), ("row", "a", 0), ("column", "x", 0)],
                                   "side string, node string, cluster_no int")
    sinks.write_labels(labels, tmp_out + "/rowlabels", "row")
    back = spark.read.option("sep", "\t").option("header", True).csv(tmp_out + "/rowlabels")
    assert [(r.cluster_no, r.recordValue) for r in back.collect()] == [("0", "a"), ("1", "b")]
    from cobi.operators.numbering import index_table
    sinks.write_indexed_tsv(index_table(table(spark, "supplier"), ["s_suppkey"]),
                            tmp_out + "/indexed")
    back = spark.read.option("sep", "\t").option("header", True).csv(tmp_out + "/indexed")
    assert back.columns[0] == "Index No" and back.count() == 10
    sinks.write_node_labels(labels, tmp_out + "/all")
    assert spark.read.parquet(tmp_out + "/all").count() == 3


def test_cluster_sweep(spark):
    from cobi.operators.sweep import sweep_edges
    from cobi.plans.runs import cluster_sweep
    sw = sweep_edges(table(spark, "customer"), table(spark, "orders"), "c_custkey", "o_custkey",
                     ["c_mktsegment"], ["o_orderstatus", "o_orderpriority"])
    labels = cluster_sweep(sw, 3, runs=1)
    got = {(r.column_b, r.side) for r in labels.select("column_b", "side").distinct().collect()}
    assert got == {(b, s) for b in ("o_orderstatus", "o_orderpriority") for s in ("row", "column")}
    assert labels.filter("cluster_no < 0 OR cluster_no >= 3").count() == 0
    flat = spark.createDataFrame([("a", "b", f"x{i}", f"y{j}", 1.0) for i in range(3) for j in range(2)],
                                 "column_a string, column_b string, first_field string, second_field string, weight double")
    got = cluster_sweep(flat, 3, runs=1).collect()
    assert len(got) == 5 and {r.cluster_no for r in got} == {0}      # rank 1: one cluster
