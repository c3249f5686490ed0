"""Field descriptions (SRC2), string-field selection (FLT5, PRJ7, PRJ8) and
field pairs (JON3)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobi.functions.clean import remove_whitespace, strip_margin, type_is_string


def read_description(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: a tab-separated description file -> (field_name, type_name,
    type_norm).  Fields past the second are ignored.  ``type_norm`` is the
    lower-cased, margin-stripped type name (PRJ8)."""
    parts = F.split(F.col("value"), "\t")
    return (spark.read.text(path)
            .select(parts.getItem(0).alias("field_name"), parts.getItem(1).alias("type_name"))
            .withColumn("type_norm", strip_margin(F.lower("type_name"))))


def string_fields(desc: DataFrame) -> DataFrame:
    """FLT5 + PRJ7: names of the fields whose type contains ``string``,
    normalised (lower-cased, margin-stripped, whitespace removed)."""
    return (desc.filter(type_is_string(F.col("type_name")))
            .select(remove_whitespace(strip_margin(F.lower("field_name"))).alias("field_name")))


def string_fields_of(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """FLT5 for typed sources: the string columns of a DataFrame's schema."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def field_pairs(fields_a: list[str], fields_b: list[str]) -> list[tuple[str, str]]:
    """JON3: every (field of A, field of B).

    Field lists are schema metadata (one entry per column), so they are
    handled as plain lists; the data-sized work of a sweep runs in one Spark
    job (``cobi.operators.sweep``).
    """
    return list(product(fields_a, fields_b))


def collect_field_names(desc_fields: DataFrame) -> list[str]:
    """Field names of a description (metadata: bounded by the column count)."""
    return [r["field_name"] for r in desc_fields.select("field_name").collect()]
