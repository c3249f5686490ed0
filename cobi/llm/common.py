"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from cobi.session import ensure_checkpoint_dir


#: rows of an Arrow batch: whole texts are wide rows, and a batch of Spark's
#: default of 10,000 would hold tens of megabytes several times over
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder
    (``spark.checkpoint.dir``) and read it back: lineage ends there, so a lost
    executor costs no recomputation, and each use reads the same rows."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Spark's cleaner removes the shuffle files of finished queries once their
    # plans are garbage; without this they would stay on disk to the end
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Shared:
    """A broadcast value whose class the executors need not import."""

    def __init__(self, spark: SparkSession, value):
        self._bytes, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._bytes.value)
        return self._value

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}
