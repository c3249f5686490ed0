"""Sweep every string-column pair of two tables in one job (E2E3).

The reference loops over field pairs on the driver and rereads both tables for
each pair.  Here each table is scanned once: its string columns are unpivoted
to (key, column, value), counted by (key, column, value), and the two counts
are joined on the key, so all pairs come out of one aggregate keyed by
(column_a, column_b, first_field, second_field).  The number of pairs is data,
not a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.functions.clean import is_integral, keep_node, resolve_column
from cobi.operators.edges import cap_rows, key_is_valid
from cobi.operators.skew import key_join
from cobi.sources.describe import string_fields_of

SWEEP_COLUMNS = ["column_a", "column_b", "first_field", "second_field", "weight"]


def _long_side(df: DataFrame, key: str, fields: list[str], min_key: int, as_long: bool,
               column_name: str, extra_tokens) -> DataFrame:
    key = resolve_column(df, key)
    fields = [resolve_column(df, f) for f in fields]
    k = F.col(key).cast("long") if as_long else F.col(key).cast("string")
    narrow = df.filter(key_is_valid(k, min_key, as_long)).select(
        k.alias("_cobi_key"), *[F.col(f).cast("string").alias(f) for f in fields])
    long = narrow.unpivot(["_cobi_key"], fields, column_name, "node").withColumnRenamed("_cobi_key", "key")
    return long.filter(keep_node(F.col("node"), extra_tokens))


def sweep_edges(a: DataFrame, b: DataFrame, key_a: str, key_b: str,
                fields_a: list[str] | None = None, fields_b: list[str] | None = None, *,
                min_key_a: int = 0, min_key_b: int = 1, limit_a: int | None = None,
                limit_b: int | None = None, order_a: list[str] | None = None,
                order_b: list[str] | None = None, extra_tokens=()) -> DataFrame:
    """E2E3: edges of every (string field of A, string field of B) pair.

    Field lists default to the string columns of each schema, the key column
    too if it is one (FLT5 for typed sources).  A row cap (LIM1) takes the
    first rows by ``order_a`` / ``order_b``, by default by the key.
    """
    a = cap_rows(a, limit_a, order_a or [resolve_column(a, key_a)])
    b = cap_rows(b, limit_b, order_b or [resolve_column(b, key_b)])
    ka = resolve_column(a, key_a)
    kb = resolve_column(b, key_b)
    fields_a = fields_a if fields_a is not None else string_fields_of(a)
    fields_b = fields_b if fields_b is not None else string_fields_of(b)
    as_long = is_integral(a, ka) and is_integral(b, kb)
    la = _long_side(a, ka, fields_a, min_key_a, as_long, "column_a", extra_tokens)
    lb = _long_side(b, kb, fields_b, min_key_b, as_long, "column_b", extra_tokens)
    ca = la.groupBy("key", "column_a", F.col("node").alias("node_a")).agg(
        F.count(F.lit(1)).alias("ca"))
    cb = lb.groupBy("key", "column_b", F.col("node").alias("node_b")).agg(
        F.count(F.lit(1)).alias("cb"))
    return (key_join(ca, cb, "key").groupBy("column_a", "column_b", F.col("node_a").alias("first_field"),
                           F.col("node_b").alias("second_field"))
            .agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("weight")))
