"""Row and node numbering (WIN1, WIN2) and the columns built from it (PRJ4, PRJ5).

``row_number().over(Window.orderBy(...))`` without a partition key moves the
whole table into one task.  Here numbering is distributed instead:

1. range-partition on the order columns into ``n`` partitions and sort inside
   each (one shuffle, balanced by sampled bounds);
2. ``monotonically_increasing_id`` then holds (partition index << 33) + the
   position inside the partition;
3. per-partition row counts (at most ``n`` rows, a proven bound) give
   cumulative offsets, broadcast back onto the rows.

The ranged frame is checkpointed in the cluster's shared folder, so both uses
read one materialisation (the range bounds are sampled once), nothing stays
cached, and a lost executor changes no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobi.session import ensure_checkpoint_dir

_MID = "_cobi_mid"
_PID = "_cobi_pid"
_OFF = "_cobi_off"
_TIE = "_cobi_tie"
_DUP = "_cobi_dup"
_LOCAL_BITS = 33


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order_cols: list[str | Column], id_col: str = "row_id",
                num_partitions: int | None = None) -> DataFrame:
    """WIN1: add ``id_col`` = 0-based position of each row in ``order_cols`` order.

    Rows that tie on ``order_cols`` are numbered by a hash of the whole row
    (deterministic; exact duplicates are interchangeable, and a random number
    decides between them so that many of them still spread over partitions).
    """
    n = _partitions(df, num_partitions)
    # A hash of the whole row breaks ties in the order: range partitioning
    # cannot split equal keys, so without it one frequent order value would
    # land in a single task.  The hash is deterministic, so is the numbering.
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.withColumn(_TIE, F.xxhash64(*df.columns)).withColumn(_DUP, F.rand(0))
              .repartitionByRange(n, *order_cols, _TIE, _DUP).sortWithinPartitions(*order_cols, _TIE, _DUP)
              .withColumn(_MID, F.monotonically_increasing_id()).checkpoint(eager=True))
    pid = F.shiftright(F.col(_MID), _LOCAL_BITS)
    counts = ranged.groupBy(pid.alias(_PID)).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # ``counts`` has at most ``n`` rows (one per range partition): the window
    # over it and the broadcast below are bounded by the partition count.
    offsets = counts.select(_PID, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_OFF))
    local = F.col(_MID).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (ranged.join(F.broadcast(offsets), pid == F.col(_PID))
            .withColumn(id_col, (F.col(_OFF) + local).cast("long"))
            .drop(_MID, _PID, _OFF, _TIE, _DUP))


def number_nodes(nodes: DataFrame, node_col: str = "node", id_col: str = "node_id",
                 partition_cols: list[str] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """WIN2: number distinct node values from 0 in binary string order.

    With ``partition_cols`` (for example ``["side"]``) each group is numbered
    from 0 on its own: the global position minus the group's first position.
    """
    distinct = nodes.select(*(partition_cols or []), node_col).distinct()
    order = [*(partition_cols or []), node_col]
    numbered = number_rows(distinct, order, id_col=id_col, num_partitions=num_partitions)
    if not partition_cols:
        return numbered
    starts = numbered.groupBy(*partition_cols).agg(F.min(id_col).alias("_start"))
    return (numbered.join(starts, partition_cols)
            .withColumn(id_col, F.col(id_col) - F.col("_start")).drop("_start"))


def index_table(df: DataFrame, order_cols: list[str], index_col: str = "Index No",
                num_partitions: int | None = None) -> DataFrame:
    """PRJ5: prepend a long ``Index No`` (0-based, in ``order_cols`` order) to
    every column of ``df``."""
    numbered = number_rows(df, order_cols, id_col=index_col, num_partitions=num_partitions)
    return numbered.select(index_col, *df.columns)


def record_node_id(row_id: Column, value: Column) -> Column:
    """PRJ4: record node name ``"{row_id}_{value}"``."""
    return F.concat_ws("_", row_id.cast("string"), value.cast("string"))
