"""Correlated column-pair lists (SRC1, PRJ6, FLT7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobi.operators.numbering import number_rows

PAIR_COLUMNS = ["pair_no", "table_a", "column_a", "table_b", "column_b"]


def parse_pairs(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """PRJ6: ``TABLE.col,TABLE.col`` lines -> (pair_no, table_a, column_a,
    table_b, column_b).  Tables are upper-cased, columns lower-cased; lines
    are numbered from 0 in read order."""
    mono = "_line_pos"
    fields = F.split(F.col(value_col), ",")
    left = F.split(fields.getItem(0), r"\.")
    right = F.split(fields.getItem(1), r"\.")
    parsed = (lines.withColumn(mono, F.monotonically_increasing_id())
              .select(mono,
                      F.upper(left.getItem(0)).alias("table_a"),
                      F.lower(left.getItem(1)).alias("column_a"),
                      F.upper(right.getItem(0)).alias("table_b"),
                      F.lower(right.getItem(1)).alias("column_b")))
    return number_rows(parsed, [mono], id_col="pair_no").select(*PAIR_COLUMNS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: read a pair-list text file (one pair per line, comma-separated)."""
    return parse_pairs(spark.read.text(path))


def select_pair(pairs: DataFrame, pair_no: int = 1) -> DataFrame:
    """FLT7: the ``pair_no``-th line, 0-based (the reference's default is 1,
    that is the *second* line)."""
    return pairs.filter(F.col("pair_no") == pair_no)
