"""Replacing output as a whole (SNK8).

A result of several tables is written into a folder of its own and then named
by one appended row of a manifest, which is a single file.  Until that row is
there, readers see the earlier result; after it, the new one; a run that dies
in between changes nothing for them.  On stores without an atomic rename of
folders this is what can be relied on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

MANIFEST = "_manifest"
_SCHEMA = "version long, folder string"


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_SCHEMA).json(f"{root}/{MANIFEST}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, folder) of the result that readers see; None if there is none."""
    versions = _versions(spark, root)
    last = versions.orderBy(F.desc("version"), F.desc("folder")).first() if versions is not None else None
    return (last.version, f"{root}/{last.folder}") if last else None


def current(spark: SparkSession, root: str) -> str:
    """The folder of the published result."""
    found = published(spark, root)
    if found is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return found[1]


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Call ``write(folder)`` for a new folder under ``root``, then make it what
    readers see.  One writer at a time; of two, the row that sorts last counts,
    and neither's tables are mixed."""
    before = published(spark, root)
    version = before[0] + 1 if before else 0
    name = f"v{version:06d}-{uuid.uuid4().hex[:12]}"
    write(f"{root}/{name}")
    (spark.createDataFrame([(version, name)], _SCHEMA).coalesce(1)
     .write.mode("append").json(f"{root}/{MANIFEST}"))
    return f"{root}/{name}"
