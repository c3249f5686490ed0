"""Hot keys of a join.

Joins of tables go through Spark's own skew handling: both sides of ``key_join``
reach the join as plain shuffles by the key, and adaptive execution cuts a
partition that is far larger than the others, on either side, into pieces that
are joined in several tasks (``spark.sql.adaptive.skewJoin.*``).  Nothing runs
and nothing is cached while the plan is built.

``hot_keys`` finds hot keys ahead of time for layouts that are built once and
read many times (the spectral engine's cached edges).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

_ROWS = "_cobi_rows"


def key_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner equi-join whose hot keys, of either side, Spark splits at run time.

    The sides are (pre-aggregated) tables partitioned by more than the key, so
    Spark shuffles both by the key itself; it is those shuffles it can split.
    """
    return left.join(right, key)


def hot_keys(left: DataFrame, key: str, min_hot_rows: int,
             num_partitions: int | None = None) -> list[tuple[object, int]]:
    """Hot keys of ``left`` and the number of buckets for each (at most P rows).

    One job: the per-key counts are observed for their total while the P + 1
    largest are taken (a bounded top-k).  At most P keys can exceed total / P,
    so every hot key is among those P + 1.
    """
    spark = left.sparkSession
    p = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    obs = Observation()
    stats = (left.groupBy(key).agg(F.count(F.lit(1)).alias(_ROWS))
             .observe(obs, F.sum(_ROWS).alias("total")))
    top = stats.orderBy(F.desc(_ROWS)).limit(p + 1).collect()
    total = obs.get.get("total") or 0
    threshold = max(int(min_hot_rows), math.ceil(total / p), 1)
    return [(r[0], min(math.ceil(r[1] / threshold), p)) for r in top if r[1] > threshold]
