"""The edge list as a sparse matrix: degrees, normalisation, row summaries
(AGG2, AGG3, AGG6, MAT1, MAT3, MAT4).

The edge DataFrame (first_field, second_field, weight) *is* the coordinate
form of the m x n adjacency matrix A: rows are values of table A's column,
columns are values of table B's column.  Transposing swaps the two fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.session import ensure_checkpoint_dir


def row_degrees(edges: DataFrame) -> DataFrame:
    """AGG3: d_row(F) = sum of F's row of A -> (node, degree)."""
    return edges.groupBy(F.col("first_field").alias("node")).agg(
        F.sum("weight").alias("degree"))


def col_degrees(edges: DataFrame) -> DataFrame:
    """AGG2: d_col(P) = sum of P's column of A -> (node, degree)."""
    return edges.groupBy(F.col("second_field").alias("node")).agg(
        F.sum("weight").alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """Both sides -> (side, node, degree): a grouped sum a side with map-side partial
    sums.  Callers that have no written edges write them first: they are read twice."""
    return (row_degrees(edges).select(F.lit("row").alias("side"), "node", "degree")
            .unionByName(col_degrees(edges).select(F.lit("column").alias("side"), "node", "degree")))


def transpose(edges: DataFrame) -> DataFrame:
    """MAT3: A^T as an edge list."""
    return edges.select(F.col("second_field").alias("first_field"),
                        F.col("first_field").alias("second_field"), "weight")


def normalize(edges: DataFrame) -> DataFrame:
    """MAT4: An = D1^-1/2 A D2^-1/2 -> (first_field, second_field, weight, w_norm,
    d_row, d_col).

    The edge list is computed once and checkpointed; both degree tables come
    from it (``degrees``), checkpointed too, so that the two joins read plain tables: Spark chooses a broadcast when a side is small at
    run time and splits a hot node otherwise.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.checkpoint(eager=True)
    deg = degrees(edges).checkpoint(eager=True)
    dr = deg.filter(F.col("side") == "row").select(F.col("node").alias("first_field"),
                                                   F.col("degree").alias("d_row"))
    dc = deg.filter(F.col("side") == "column").select(F.col("node").alias("second_field"),
                                                      F.col("degree").alias("d_col"))
    return (edges.join(dr, "first_field").join(dc, "second_field")
            .withColumn("w_norm", F.col("weight") / F.sqrt(F.col("d_row") * F.col("d_col"))))


def adjacency_summary(edges: DataFrame) -> DataFrame:
    """AGG6 without collecting a row into one value: per row node, its number
    of non-zeros, row sum and first/last column in binary string order."""
    return edges.groupBy(F.col("first_field").alias("node")).agg(
        F.count(F.lit(1)).alias("nnz"),
        F.sum("weight").alias("row_sum"),
        F.min("second_field").alias("first_col"),
        F.max("second_field").alias("last_col"))
