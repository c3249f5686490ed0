"""Operator 7: token ids in training order, as shards of fixed stride.

Every document is its token ids and the end id, cut into sequences of
``length`` ids.  The sequences are numbered from 0 (offset of the block that
made them, and their place in it); a keyed Feistel permutation with
cycle-walking gives each number its slot in the training order.  A shard holds
``per_shard`` slots in order, each at slot * stride bytes, the rest of a short
sequence filled with ``PAD``.

Slots are a permutation of 0..n-1, so a reader can stop at any slot and go on
there: shard slot // per_shard, byte slot % per_shard * stride.  The order needs
no shuffle file of its own, can be made again from the key, and every shard has
the same size, whatever the corpus.  ``write_shards`` writes one row a shard
through Spark's writers (any store that Spark reaches), ``read_from`` streams
sequences from a slot on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import partitions, saved
from cobi.llm.feistel import permute_array
from cobi.llm.tokens import TOKENIZER, Encoder

LENGTH = 1024
PER_SHARD = 2048
PAD = 0
KEY = 20240607

_SHARD = ("shard long, first_slot long, n_slots int, stride int, width int, payload binary, sha256 string, "
          "doc_id array<long>, piece array<int>, length array<int>")


def _sequences(length: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, n = Encoder.shared(tokenizer), TaskContext.get().partitionId(), 0
        dtype = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                ids, limits = encoder.encode(data, offsets)
                count = -(-np.diff(limits) // length)
                doc = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = limits[doc] + piece * length
                end = np.minimum(start + length, limits[doc + 1])
                ids = ids.astype(dtype)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                     pa.array([ids[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()),
                     pa.array(np.full(len(doc), block, np.int64)), pa.array(n + np.arange(len(doc)))],
                    names=["doc_id", "piece", "ids", "block", "place"])
                n += len(doc)
    return run


def _slots(shared, total: int, key: int, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, before = shared.value
        for batch in batches:
            block = batch.column("block").to_numpy()
            number = before[np.searchsorted(blocks, block)] + batch.column("place").to_numpy()
            slot = permute_array(number, total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // per_shard), pa.array(slot), *(batch.column(c) for c in ("doc_id", "piece", "ids"))],
                names=["shard", "slot", "doc_id", "piece", "ids"])
    return run


def _fill(per_shard: int, stride: int, width: int):
    """Rows come sorted by slot; a shard at a time is filled."""
    pad = np.array([PAD], dtype=f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> pa.RecordBatch:
            payload = b"".join(r[3] + pad * ((stride - len(r[3])) // width) for r in rows)
            first = rows[0][0]
            assert [r[0] for r in rows] == list(range(first, first + len(rows))) and first == now * per_shard
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([first], pa.int64()), pa.array([len(rows)], pa.int32()),
                 pa.array([stride], pa.int32()), pa.array([width], pa.int32()), pa.array([payload], pa.binary()),
                 pa.array([hashlib.sha256(payload).hexdigest()]),
                 pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                 pa.array([[r[2] for r in rows]], pa.list_(pa.int32())),
                 pa.array([[len(r[3]) // width for r in rows]], pa.list_(pa.int32()))],
                names=["shard", "first_slot", "n_slots", "stride", "width", "payload", "sha256", "doc_id", "piece",
                       "length"])
        for batch in batches:
            shards = batch.column("shard").to_pylist()
            values = zip(*(batch.column(c).to_pylist() for c in ("slot", "doc_id", "piece", "ids")), strict=True)
            for shard, row in zip(shards, values, strict=True):
                if shard != now:
                    if rows:
                        yield close()
                    now, rows = shard, []
                rows.append(row)
        if rows:
            yield close()
    return run


def shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           per_shard: int = PER_SHARD, key: int = KEY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a shard: shard, first_slot, n_slots, stride (bytes), width (bytes of an id), payload,
    its sha256, and for each slot the doc_id, piece and ids it holds.

    Null and empty texts are the end id alone.  Rows without an id and rows
    with a repeated id are sequences of their own.  Other columns are not read.
    The last shard may hold fewer slots; no rows give no shard.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = saved(base.mapInArrow(_sequences(length, tokenizer), "doc_id long, piece int, ids binary, block long, "
                                                                "place long"), "sequences")
    # one row for each task of the first pass
    counts = sorted((r.block, r.n) for r in made.groupBy("block").agg(F.count("*").alias("n")).collect())
    n = np.array([c for _, c in counts], dtype=np.int64)
    total = int(n.sum())
    before = spark.sparkContext.broadcast((np.array([b for b, _ in counts], dtype=np.int64), np.cumsum(n) - n))
    width = 2 if Encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4
    placed = made.mapInArrow(_slots(before, total, key, per_shard),
                             "shard long, slot long, doc_id long, piece int, ids binary")
    return (placed.repartition(2 * partitions(spark), "shard").sortWithinPartitions("shard", "slot")
            .mapInArrow(_fill(per_shard, length * width, width), _SHARD))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    shards(docs, **options).write.mode("overwrite").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int = 0) -> Iterator[tuple[int, bytes]]:
    """(slot, ids without padding) from ``slot`` on, a shard at a time."""
    table = spark.read.parquet(path).where(F.col("first_slot") + F.col("n_slots") > slot)
    for r in table.select("first_slot", "n_slots", "stride", "width", "payload",
                          "length").orderBy("first_slot").toLocalIterator():
        for k in range(max(0, slot - r.first_slot), r.n_slots):
            yield r.first_slot + k, bytes(r.payload[k * r.stride:k * r.stride + r.length[k] * r.width])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            at = [k * r["stride"] for k in range(r["n_slots"])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(r["doc_id"], pa.int64()), "piece": pa.array(r["piece"], pa.int32()),
                "slot": pa.array([r["first_slot"] + k for k in range(r["n_slots"])], pa.int64()),
                "shard": pa.array([r["shard"]] * r["n_slots"], pa.int64()), "byte_offset": pa.array(at, pa.int64()),
                "n_ids": pa.array(r["length"], pa.int32()),
                "ids_crc32": pa.array([zlib.crc32(r["payload"][a:a + n * r["width"]])
                                       for a, n in zip(at, r["length"], strict=True)], pa.int64())})


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all ``documents``; a row for each sequence, read from its shard."""
    from cobi.llm.common import table
    return shards(table(spark, sf_dir, "documents")).mapInArrow(
        _digests, "doc_id long, piece int, slot long, shard long, byte_offset long, n_ids int, ids_crc32 long")
