"""Shingle sets of texts, their classes, and the documents of linked classes.

Shared by the operators that link documents by the likeness of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.bitmap import bitmap_of
from cobi.llm.common import Shared, saved
from cobi.llm.graph import components


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, in one array with limits.
    A document of fewer words than ``size`` has its whole sequence as one."""
    w = W.Words(W.LOWER[data], offsets, W.NON_SPACE)
    h = w.hashes()
    at = W.inside_document(w.first, size)
    doc, key = w.doc()[at], W.windows(h, size)[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = [W.windows(h[w.first[i]:w.first[i + 1]], int(w.counts[i]), int(w.counts[i]))[0]
                 for i in short]
        doc, key = np.concatenate([doc, short]), np.concatenate([key, np.array(whole, W.U64)])
    doc, key = W.distinct_pairs(doc, key)
    return key, np.searchsorted(doc, np.arange(len(w.counts) + 1))


def set_keys(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set; zeros for an empty one."""
    n = np.diff(first)
    k1, k2 = np.zeros(len(n), W.U64), np.zeros(len(n), W.U64)
    some = n > 0
    if some.any():
        at = first[:-1][some]
        k1[some] = np.add.reduceat(W.mix(key, 11), at)
        k2[some] = np.add.reduceat(W.mix(key, 12), at)
    return k1, k2


def lists(values: np.ndarray, each: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)),
                                    pa.array(W.signed(np.ascontiguousarray(values))))


def cells(key: np.ndarray, first: np.ndarray) -> pa.Array:
    """How many values of each set lie in each of its cells, a byte a cell: two
    sets have at most the sum of the smaller counts in common.  A set of n values
    has about n / 3 cells (a power of two, by the top bits of a hash, so that
    finer cells add up to coarser ones).  Null with over 255 values in a cell."""
    n = np.diff(first)
    bits = np.clip(np.ceil(np.log2(np.maximum(n, 1) / 4)), 5, 16).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(1 << bits)])
    doc = np.repeat(np.arange(len(n)), n)
    at = start[doc] + (W.mix(key, 21) >> (64 - bits[doc]).astype(W.U64)).astype(np.int64)
    count = np.bincount(at, minlength=int(start[-1]))
    over = np.zeros(len(n), dtype=bool)
    over[doc[(count > 255)[at]]] = True
    count = count.astype(np.uint8).tobytes()
    return pa.array([None if o else count[a:b] for o, a, b in
                     zip(over.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True)], pa.binary())


def folded(rows: list[bytes], width: int) -> np.ndarray:
    """Cells of sets with ``width`` or more, added up to that many."""
    out = np.empty((len(rows), width), dtype=np.int32)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row, np.uint8).reshape(width, -1).sum(axis=1)
    return out


def classes(real: DataFrame, *columns: str) -> DataFrame:
    """One row (node, rep, k1, k2, n, ``columns``) for each distinct set, rep its
    smallest doc_id; a written table.  The columns depend on the set alone."""
    rows = real.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in columns])
    return saved(rows.withColumn("node", F.monotonically_increasing_id()), "classes")


def _wanted_sets(size: int, wanted: Shared, reps: Shared):
    """(k1, k2, n, shingles) of the wanted classes, once in a run of texts.  Only the
    texts of ids that stand for one of them are made into shingles again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(reps.value.has(batch.column("h").to_numpy().view(W.U64))))
            if not batch.num_rows:
                continue
            for _, data, offsets in W.chunks(batch, "text"):
                key, first = shingle_sets(data, offsets, size)
                k1, k2 = set_keys(key, first)
                n = np.diff(first)
                hit = np.flatnonzero((n > 0) & wanted.value.has(k1))
                hit = hit[np.unique(k1[hit], return_index=True)[1]] if len(hit) else hit
                take = [key[first[i]:first[i + 1]] for i in hit.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(k1[hit])), pa.array(W.signed(k2[hit])), pa.array(n[hit].astype(np.int64)),
                     lists(np.concatenate(take) if take else np.zeros(0, W.U64), n[hit])],
                    names=["k1", "k2", "n", "shingles"])
    return run


def with_sets(base: DataFrame, nodes: DataFrame, places: DataFrame, size: int, bits: int) -> DataFrame:
    """``places`` (with a column node) and the ``shingles`` of their classes: one
    more pass over the texts, of which those with the id of such a class (its ``rep``)
    are read, and the sets of those classes alone go on.  A class may come several
    times, from different runs of texts."""
    some = saved(nodes.select("node", "k1", "k2", "n", F.xxhash64("rep").alias("h")).join(places.select("node").distinct(), "node"), "candidates")
    known, reps = (Shared(base.sparkSession, bitmap_of(some, bits, c)) for c in ("k1", "h"))
    found = base.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_wanted_sets(size, known, reps), "k1 long, k2 long, n long, shingles array<long>")
    keyed = places.join(some.select("node", "k1", "k2", F.col("n").alias("size")), "node")
    return (keyed.join(found.withColumnRenamed("n", "size").hint("merge"), ["k1", "k2", "size"])
            .drop("k1", "k2", "size"))


def one_bucket_each(buckets: DataFrame) -> DataFrame:
    """One bucket for all (bucket, node, own, n, pos) that have the same members;
    a member keeps its smallest ``pos`` and is own if it was in one of them."""
    both = saved(buckets, "buckets")
    sign = both.groupBy("bucket").agg(
        F.count("*").alias("c"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    names = saved(sign.select("bucket", F.xxhash64("c", "low", "x", "y").alias("name")), "bucketnames")
    return saved(both.join(names, "bucket").groupBy(F.col("name").alias("bucket"), "node").agg(
        F.max("own").alias("own"), F.first("n").alias("n"), F.min("pos").alias("pos")), "buckets")


def smallest_ids(sig: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n, component_id) of each row of ``sig`` (doc_id, n, k1, k2):
    the smallest doc_id reachable over ``links`` of classes.  Rows of one id tie
    their classes together; a row without an id has a null component."""
    real = sig.where("doc_id is not null and n > 0")
    member = saved(real.select("doc_id", "k1", "k2", "n").distinct()
                   .join(nodes.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).select("doc_id", "node"), "members")
    several = member.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u != w")
    several = saved(several.select("doc_id", "u"), "several")
    ties = member.join(several, "doc_id").select("u", F.col("node").alias("v"))
    linked = components(links.unionAll(ties), "links")
    named = saved(nodes.select("node", "k1", "k2", "n", "rep").join(linked, "node", "left")
                  .withColumn("component", F.coalesce("component", "node")), "named")
    low = saved(named.groupBy("component").agg(F.min("rep").alias("component_id")), "lowest")
    label = saved(named.join(low, "component").select("k1", "k2", "n", "component_id"), "labels")
    return (sig.select("doc_id", "n", "k1", "k2").join(label, ["k1", "k2", "n"], "left")
            .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
                    .alias("component_id")))
