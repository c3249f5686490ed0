"""Record-level bipartite graph (E2E2, FLT6, PRJ4, JON4, AGG7 on records, Q19, Q20).

Nodes are single records, named ``"{row_id}_{value}"`` (PRJ4), rows numbered
after the ``value > 0`` filter in the given order (Q19).  Two records are
linked, weight 1.0, when they hold the same value (JON4); record ids are
unique, so weights never add up (Q20).

The pair list is a union of complete bipartite blocks, one per shared value:
block v links every A record of v with every B record of v.  Materialising it
would emit all pairs inside each group -- quadratic in a hot value -- so the
graph is kept factorised instead:

* ``blocks``: one row per shared value, (value, n_a, n_b, n_edges = n_a * n_b),
  from two grouped counts; no row is numbered for it;
* ``nodes()``: one row per record with a partner, (side, node, value, row_id,
  degree), the degree being the other side's record count for the value.  Only
  this table needs row numbers.

Every edge-list quantity (sizes, degrees, the normalised weight
1 / sqrt(d_a d_b) of any pair, spectral products) follows from these two
tables with grouped sums and joins on ``value``; each value's block counts are
pre-aggregated before any join, so a hot value costs one row there.

``FactorisedGraph`` embeds and clusters the record graph (MAT2): with B_a, B_b the
record x value incidence matrices of the two sides, A = B_a B_b^T, so

    An x = D_a^-1/2 B_a (B_b^T (D_b^-1/2 x)),

one grouped sum by value and one join back, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.functions.clean import resolve_column
from cobi.operators.edges import cap_rows
from cobi.operators.numbering import number_rows, record_node_id
from cobi.operators.skew import key_join
from cobi.operators.spectral import Graphs, GraphSize, with_scale
from cobi.session import ensure_checkpoint_dir


@dataclass
class RecordGraph:
    blocks: DataFrame                  # (value, n_a, n_b, n_edges)
    _nodes: Callable[[], DataFrame]

    def nodes(self) -> DataFrame:
        """(side, node, value, row_id, degree); numbers the rows of both tables."""
        return self._nodes()


def _kept(df: DataFrame, col: str, order: list[str], limit: int | None) -> DataFrame:
    df = cap_rows(df, limit, order)
    col = resolve_column(df, col)
    return df.filter(F.col(col) > 0).select(F.col(col).alias("_v"), *order)   # FLT6


def filtered_count(df: DataFrame, col: str) -> DataFrame:
    """AGG9: the number of rows that pass FLT6 -> (n_rows)."""
    col = resolve_column(df, col)
    return df.filter(F.col(col) > 0).agg(F.count(F.lit(1)).alias("n_rows"))


def _records(kept: DataFrame, order: list[str]) -> DataFrame:
    numbered = number_rows(kept, order, id_col="row_id")                      # WIN1
    return numbered.select(F.col("_v").cast("string").alias("value"), "row_id",
                           record_node_id(F.col("row_id"), F.col("_v")).alias("node"))


def build_record_graph(a: DataFrame, b: DataFrame, col_a: str, col_b: str,
                       order_a: list[str], order_b: list[str], *,
                       limit_a: int | None = None, limit_b: int | None = None) -> RecordGraph:
    """E2E2: records of A and B linked by equal values of ``col_a`` / ``col_b``."""
    ka, kb = _kept(a, col_a, order_a, limit_a), _kept(b, col_b, order_b, limit_b)

    def counts(kept: DataFrame, name: str) -> DataFrame:
        return (kept.groupBy("_v").agg(F.count(F.lit(1)).alias(name))
                .select(F.col("_v").cast("string").alias("value"), name))

    ca, cb = counts(ka, "n_a"), counts(kb, "n_b")
    blocks = ca.join(cb, "value").withColumn("n_edges", F.col("n_a") * F.col("n_b"))

    def nodes() -> DataFrame:
        # One count row per value meets the value's records; a value of very
        # many records is split by Spark on the record side.
        rows = key_join(_records(ka, order_a), cb, "value").select(
            F.lit("row").alias("side"), "node", "value", "row_id", F.col("n_b").cast("double").alias("degree"))
        cols = key_join(_records(kb, order_b), ca, "value").select(
            F.lit("column").alias("side"), "node", "value", "row_id", F.col("n_a").cast("double").alias("degree"))
        return rows.unionByName(cols)

    return RecordGraph(blocks, nodes)


def record_graph_size(g: RecordGraph) -> DataFrame:
    """AGG8 on the record graph: (n_rows, n_cols, n_edges) from the blocks."""
    return g.blocks.agg(F.sum("n_a").cast("long").alias("n_rows"),
                        F.sum("n_b").cast("long").alias("n_cols"),
                        F.sum("n_edges").cast("long").alias("n_edges"))


@dataclass
class FactorisedGraph(Graphs):
    """An of a record graph as two incidence tables.

    ``members``: (id, vid, small, salt): a record, its value's number, whether
    it is on the smaller side, and which part of a hot value it is in.
    ``values``: (vid, scale, parts_big, parts_small), scale = (n_a n_b)^-1/2,
    which is D_a^-1/2 D_b^-1/2 for all pairs of a value.
    """

    members: DataFrame
    values: DataFrame
    n_values: int
    nodes: DataFrame
    sizes: dict[int, GraphSize]
    _layouts: dict = field(default_factory=dict)

    def half(self, block, to_small, b, active, *, broadcast_bytes, min_hot_rows):
        cols = [f"f{j}" for j in range(b)]
        src, dst = self.members.where(F.col("small") != to_small), self.members.where(F.col("small") == to_small)
        sums = (block.join(src.select("id", "vid"), "id").groupBy("vid").agg(*[F.expr(f"sum({c}) AS {c}") for c in cols])
                .join(self.values, "vid")
                .select("vid", *[F.expr(f"{c} * scale AS {c}") for c in cols],
                        F.col("parts_small" if to_small else "parts_big").alias("parts")))
        if self.n_values * (b + 2) * 8 <= broadcast_bytes:
            return dst.join(F.broadcast(sums), "vid").select("id", *cols)
        if to_small not in self._layouts:   # stored once; only the sums move afterwards
            p = int(dst.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self._layouts[to_small] = dst.select("id", "vid", "salt").repartition(p, "vid", "salt").persist(
                StorageLevel.MEMORY_AND_DISK), p
        laid_out, p = self._layouts[to_small]
        sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        sums = sums.repartition(p, "vid", "salt").hint("shuffle_hash")
        return laid_out.join(sums, ["vid", "salt"]).select("id", *cols)

    def release(self) -> None:
        for laid_out, _ in self._layouts.values():
            laid_out.unpersist()
        self._layouts.clear()


def factorised(g: RecordGraph, part_rows: int = 1_000_000) -> FactorisedGraph:
    """The record graph as input of ``spectral_embeddings``; a value of more than
    ``part_rows`` records is stored in several parts."""
    spark = g.blocks.sparkSession
    ensure_checkpoint_dir(spark)
    values = g.blocks.withColumn("vid", F.monotonically_increasing_id()).checkpoint(eager=True)
    total = values.agg(F.count(F.lit(1)).alias("values"), F.sum("n_a").alias("m"), F.sum("n_b").alias("n"),
                       F.sum("n_edges").cast("double").alias("total")).first()
    if not total["values"]:
        raise ValueError("the graph has no edges; nothing to decompose (FLT9)")
    size = GraphSize(int(total["m"]), int(total["n"]), float(total["total"]))
    rows_small = F.lit(size.flip)
    parts = lambda c: F.ceil(F.col(c) / part_rows)
    values = values.select(
        "vid", "value", (1 / F.sqrt(F.col("n_a").cast("double") * F.col("n_b"))).alias("scale"),
        F.when(rows_small, parts("n_b")).otherwise(parts("n_a")).alias("parts_big"),
        F.when(rows_small, parts("n_a")).otherwise(parts("n_b")).alias("parts_small"))
    nodes = (g.nodes().withColumn("pair", F.lit(0))
             .withColumn("id", F.col("row_id") * 2 + F.when(F.col("side") == "row", 0).otherwise(1))
             .withColumnRenamed("degree", "d"))
    rows = key_join(nodes, values.select("value", "vid", "parts_big", "parts_small"), "value").checkpoint(eager=True)
    small = (F.col("side") == "row") == rows_small
    members = rows.select("id", "vid", small.alias("small"), F.pmod(
        F.xxhash64("id"), F.when(small, F.col("parts_small")).otherwise(F.col("parts_big"))).alias("salt"))
    return FactorisedGraph(members, values.drop("value"), int(total["values"]), with_scale(rows, {0: size}), {0: size})
