"""Writers (SNK1-SNK9, SRT1-SRT3).  All default to ``errorifexists`` (Q16);
pass ``mode='overwrite'`` to replace earlier output (SNK8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tsv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK1: edge list TSV with the reference's header, heaviest edge first.
    The global order is a range-partitioned sort: part files are in order."""
    out = edges.orderBy(F.desc("weight"), "first_field", "second_field").select(
        "first_field", F.col("second_field").alias("Second_field"), F.col("weight").alias("Weight"))
    _tsv(out, path, mode)


def write_labels(labels: DataFrame, path: str, side: str, mode: str = "errorifexists") -> None:
    """SNK2/SNK3: (cluster_no, recordValue) TSV of one side, by cluster then value."""
    out = (labels.filter(F.col("side") == side)
           .select("cluster_no", F.col("node").alias("recordValue"))
           .orderBy("cluster_no", "recordValue"))
    _tsv(out, path, mode)


def write_embedding(embedding: DataFrame, path: str, fmt: str = "parquet",
                    mode: str = "errorifexists") -> None:
    """SNK4: the stacked embedding (side, node, embedding); ``fmt='json'`` for text."""
    embedding.write.mode(mode).format(fmt).save(path)


def write_node_labels(labels: DataFrame, path: str, fmt: str = "parquet",
                      mode: str = "errorifexists") -> None:
    """SNK5: labels of all nodes; (side, node) replaces the reference's position."""
    labels.write.mode(mode).format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "errorifexists") -> None:
    """SNK6: a filtered / indexed source table."""
    df.write.mode(mode).format(fmt).save(path)


def write_indexed_tsv(indexed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK7: a table with its leading ``Index No`` column, as TSV with header."""
    _tsv(indexed.orderBy("Index No"), path, mode)


def pair_dir(root: str, pair_no: int, table_a: str, column_a: str, table_b: str,
             column_b: str) -> str:
    """SNK8 layout: ``{root}/{pair_no}-{TABLE_A}_{col_a}__{TABLE_B}_{col_b}``."""
    return f"{root}/{pair_no}-{table_a}_{column_a}__{table_b}_{column_b}"


def write_sweep(sweep: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK8 for a one-job sweep: one directory per field pair through
    ``partitionBy``; ``overwrite`` replaces earlier output of the same pairs
    and leaves that of others."""
    sweep.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("column_a", "column_b").parquet(path)


def save_model(model, path: str) -> str:
    """SNK9: persist a co-clustering model (``cobi.operators.foldin``), replacing
    an earlier one in ``path`` as a whole; returns the folder of its tables."""
    return model.save(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table as tab-separated lines without a header; nulls are empty fields."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode(mode).text(path)


def write_description(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The description file of a table (SRC2): its field and type names."""
    lines = [(f"{f.name}\t{f.dataType.simpleString()}",) for f in df.schema.fields]
    df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode(mode).text(path)
