"""WIN1/WIN2/PRJ4/PRJ5: distributed numbering equals a sort."""

from pyspark.sql import functions as F

from cobi.operators.numbering import index_table, number_nodes, number_rows, record_node_id
from tests.conftest import table


def test_number_rows_matches_sort(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("k"))
    got = number_rows(df, ["k"], num_partitions=5).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(5000))
    ks = [r.k for r in got]
    assert ks == sorted(ks)


def test_index_table_and_nodes(spark):
    s = table(spark, "supplier")
    idx = index_table(s, ["s_suppkey"])
    assert idx.columns[0] == "Index No"
    got = [(r["Index No"], r.s_suppkey) for r in idx.orderBy("Index No").collect()]
    keys = sorted(r.s_suppkey for r in s.collect())
    assert got == list(enumerate(keys))
    nodes = spark.createDataFrame([("row", "b"), ("row", "a"), ("column", "z"), ("row", "a")],
                                  "side string, node string")
    got = sorted((r.side, r.node, r.node_id) for r in
                 number_nodes(nodes, partition_cols=["side"]).collect())
    assert got == [("column", "z", 0), ("row", "a", 0), ("row", "b", 1)]
    assert spark.range(1).select(record_node_id(F.lit(3), F.lit(17))).first()[0] == "3_17"


def test_number_rows_with_a_hot_order_value(spark):
    """Most rows share one order value: the row hash spreads them over range
    partitions, and the numbering is still a permutation that respects the order."""
    from pyspark.sql import functions as F
    df = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"),
        F.col("id").alias("payload"))
    got = number_rows(df, ["k"], num_partitions=6)
    rows = got.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(3000))
    ks = [r.k for r in rows]
    assert ks == sorted(ks)
    sizes = [r["count"] for r in
             got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert len(sizes) > 1
