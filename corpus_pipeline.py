"""A training corpus from the documents table, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the cluster's shared folder and hands the table that it
reads back to the next one.  All but the last return the columns of
``documents`` (further columns of the table stay too).  Where a stage edits
texts, ``n_chars`` is counted again.

Repeated ids: rows of one id stay or go together, each judged as it stands.
Rows without an id pass the stages that decide by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobi.llm.common import table
from cobi.llm.decontaminate import decontaminate
from cobi.llm.minmax_dedup import near_duplicates
from cobi.llm.packing import pack
from cobi.llm.pii import pseudonymise
from cobi.llm.quality import select_quality
from cobi.session import ensure_checkpoint_dir


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (junk, toxic text) go."""
    return select_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity of 0.8 or more), the smallest id stays."""
    gone = near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; texts that are mostly benchmark go."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms."""
    return _counted(pseudonymise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document and its place."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_dedup", near_dedup), ("benchmark", benchmark), ("pii", pii), ("packing", packing)]

#: hashing, trees and branch and bound have no SQL form: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
