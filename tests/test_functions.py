"""FN9-FN15 and MAT5 helpers."""

from pyspark.sql import functions as F

from cobi.functions.vectors import (const_vector, embedding_width, hadamard, log2, prefix,
                                    scale, vector_sum)


def test_embedding_width():
    assert [embedding_width(k) for k in (1, 2, 3, 4, 5, 8, 9)] == [1, 2, 3, 3, 4, 4, 5]
    assert abs(log2(8.0) - 3.0) < 1e-12


def test_vector_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 0.5, -1.0], 2.0)],
                               "v array<double>, w array<double>, s double")
    r = df.select(scale(F.col("v"), F.col("s")).alias("a"),
                  hadamard(F.col("v"), F.col("w")).alias("b"),
                  const_vector(0.5, 3).alias("c"),
                  prefix(F.col("v"), 1).alias("d"),
                  vector_sum(F.col("v")).alias("e")).first()
    assert r.a == [2.0, 4.0, 6.0]
    assert r.b == [2.0, 1.0, -3.0]
    assert r.c == [0.5, 0.5, 0.5]
    assert r.d == [1.0, 2.0]
    assert r.e == 6.0
