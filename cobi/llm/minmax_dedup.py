"""Operator 10: near duplicates by min-max hashing.

Each document is its set of distinct word shingles.  A permutation (odd
multiplier modulo 2^64 over mixed shingle hashes) gives two signature values,
its minimum and its maximum over the set, so P permutations make 2P unbiased
values for P hash evaluations.  A band is three permutations (six values);
documents that agree on a band are candidates.  At the defaults a pair at the
threshold of 0.85 shares no band with probability (1 - 0.85^6)^40 = 6e-9.

From candidates to exact components, without a pair list:

1. documents with the same set are one class, and one node from here on;
2. each band value that several classes share is a bucket; buckets with the same
   members are one;
3. ``confirmed_links`` compares full sets inside buckets, where a link would still
   join two components: one member with the others first, then bounded tiles;
4. the components of the confirmed links, spread over the classes.

No bucket, class or component is collected whole.  Identical rows reach the
comparison as one set, whatever their number.

Cases: as in ``near_duplicates``; texts of any length are whole, an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import saved
from cobi.llm.shingles import cells, classes, lists, one_bucket_each, set_keys, shingle_sets, smallest_ids, with_sets
from cobi.llm.verify import BLOCK, BLOCK_VALUES, confirmed_links

SHINGLE = 5
BANDS = 40
PER_BAND = 3        # permutations of a band: two values each
BITS = 26           # bitmap of candidate classes

_SIGNATURE = "doc_id long, n long, k1 long, k2 long, bands array<long>, cells binary"


def band_keys(key: np.ndarray, first: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """(documents, bands) keys; documents without shingles must be left out."""
    n = len(first) - 1
    rng = np.random.Generator(np.random.PCG64(20))
    odd = rng.integers(0, 1 << 63, size=bands * per_band, dtype=np.uint64) * W.U64(2) + W.U64(1)
    out = np.zeros((n, bands), dtype=W.U64)
    i = 0
    while i < n:  # about 64 k shingles at a time stay in the cache
        j = max(i + 1, int(np.searchsorted(first, first[i] + 65536, side="right")) - 1)
        part, at = W.mix(key[first[i]:first[j]], 3), first[i:j] - first[i]
        for b in range(bands):
            k = np.full(j - i, b + 1, dtype=W.U64)
            for p in range(per_band):
                y = part * odd[b * per_band + p]
                k = W.mix(k + np.minimum.reduceat(y, at), 1)
                k = W.mix(k + np.maximum.reduceat(y, at), 2)
            out[i:j, b] = k
        i = j
    return out


def _signatures(size: int, bands: int, per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                key, first = shingle_sets(data, offsets, size)
                n = np.diff(first)
                some = n > 0
                k1, k2 = set_keys(key, first)
                keys = np.zeros((0, bands), W.U64)
                if some.any():
                    keys = band_keys(key, np.concatenate([first[:-1][some], first[-1:]]), bands, per_band)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(W.signed(k1)),
                     pa.array(W.signed(k2)), lists(keys.reshape(-1), some * bands), cells(key, first)],
                    names=["doc_id", "n", "k1", "k2", "bands", "cells"])
    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE, percent: int = 85, bands: int = BANDS,
                    per_band: int = PER_BAND, bits: int = BITS, block: int = BLOCK,
                    block_values: int = BLOCK_VALUES, done: dict | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Two documents are linked when 100 * |intersection| >= ``percent`` *
    |union| of their distinct shingles.  ``component_id`` is the smallest id
    reachable over links.  Null and word-less texts have no shingles and are
    linked with nothing.  Rows that share an id are one document of the graph
    (each row is returned); a row without an id is returned with a null
    component and ``kept`` true.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = saved(base.mapInArrow(_signatures(size, bands, per_band), _SIGNATURE), "minmax")
    nodes = classes(sig.where("doc_id is not null and n > 0"), "bands", "cells")
    rows = (nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
            .select("node", "n", F.xxhash64("band", "key").alias("bucket")))
    # written before the join, which then reads two plain shuffles: Spark can split a hot bucket
    used = saved(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "used")
    buckets = one_bucket_each(rows.join(used, "bucket").select(
        "bucket", "node", F.lit(True).alias("own"), "n", F.lit(0).cast("long").alias("pos")))
    links = confirmed_links(buckets, nodes.select("node", "cells"),
                            lambda places: with_sets(base, nodes, places, size, bits),
                            percent, block=block, block_values=block_values, done=done)
    return (smallest_ids(sig, nodes, links).withColumnRenamed("n", "n_shingles")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: near duplicates of all ``documents`` at 0.85."""
    from cobi.llm.common import table
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM low WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.g = y.g
                        AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN size s ON s.doc_id = p.a JOIN size t ON t.doc_id = p.b WHERE 100 * c >= 85 * (s.n + t.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT low.doc_id, coalesce(n, 0) AS n_shingles, least(low.doc_id, coalesce(r.m, low.doc_id)) AS component_id,
       low.doc_id <= coalesce(r.m, low.doc_id) AS kept
FROM low LEFT JOIN size ON size.doc_id = low.doc_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = low.doc_id
"""
