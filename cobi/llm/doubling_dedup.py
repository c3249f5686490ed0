"""Operator 3: repeated passages by level-wise doubling.

A word goes if a window of ``window`` consecutive words that covers it also
starts in a document with a smaller id.  Lengths double: only windows whose
halves are repeated are tested at the next length, until the asked length or
until no candidate survives.

The first level looks at half-length grams.  Of these it takes from every
window the one with the smallest hash (content-defined, so equal windows take
equal grams): a window can only be repeated if the gram that it takes is.
That is one row for about every fourth word instead of one for each.
Later levels test every surviving position, by a 128-bit hash.

Whole copies are one text: each copy is covered by the smallest id that has
the text, so only that one takes part, and a hot group of copies costs nothing.
Each level is an aggregate with partial sums followed by a join of two plain
shuffles, which Spark splits where a gram or passage is very frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import saved

WINDOW = 13
FIRST_FULL = 13   # the first length at which every position is tested


def levels(window: int) -> list[int]:
    out = [min(window, FIRST_FULL)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width and len(x):
        step = min(have, width - have)
        x = op(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def taken_grams(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, gram hash) of each window: the smallest of its gram hashes."""
    gram = (window + 1) // 2
    starts = W.inside_document(first, window)
    if not len(starts):
        return starts, np.zeros(0, dtype=W.U64)
    return starts, sliding(np.minimum, W.windows(h, gram), window - gram + 1)[starts]


def _gram_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                w = W.Words(data, offsets, W.NON_SPACE)
                starts, key = taken_grams(w.hashes(), w.first, window)
                doc = w.doc()[starts]
                if len(key):  # neighbouring windows mostly take the same gram
                    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
                    doc, key = W.distinct_pairs(doc[new], key[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(key)), rows.column("doc_id").take(pa.array(doc)),
                     rows.column("th").take(pa.array(doc))], names=["h", "doc_id", "th"])
    return run


def _in_lists(doc: np.ndarray, key: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Mask of the (document, key) pairs that the documents' lists hold."""
    flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    own = np.repeat(np.arange(len(n)), n)

    def joined(d, k):
        return W.mix(k ^ W.mix(d.astype(W.U64), 5), 6)
    return np.isin(joined(doc, key), joined(own, flat.to_numpy(zero_copy_only=False).view(W.U64)))


def _window_rows(length: int, before: int | None, later: bool):
    """(a, b, doc_id, th, start) of each candidate window: by its gram at the
    first level, else by its two windows of the length ``before``.  With
    ``later``, only of those that may start in a smaller id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text", W.CHUNK_BYTES // 2):
                w = W.Words(data, offsets, W.NON_SPACE)
                h, doc = w.hashes(), w.doc()
                if before is None:
                    starts, gram = taken_grams(h, w.first, length)
                    starts = starts[_in_lists(doc[starts], gram, rows.column("later" if later else "seen"))]
                else:
                    starts = W.inside_document(w.first, length)
                    lists = rows.column("starts")
                    ok = np.zeros(len(w) + 1, dtype=bool)
                    own = np.repeat(w.first[:-1], np.diff(lists.offsets.to_numpy()))
                    ok[own + lists.flatten().to_numpy(zero_copy_only=False)] = True
                    starts = starts[ok[starts] & ok[starts + length - before]]
                d = doc[starts]
                a, b = W.windows(h, length, 1)[starts], W.windows(h, length, 2)[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(a)), pa.array(W.signed(b)), rows.column("doc_id").take(pa.array(d)),
                     rows.column("th").take(pa.array(d)), pa.array((starts - w.first[d]).astype(np.int32))],
                    names=["a", "b", "doc_id", "th", "start"])
    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.column_bytes(batch.column("text"))
            starts, copy = batch.column("starts"), batch.column("copy").to_pylist()
            total, gone, digest, kept = [], [], [], []
            for i in range(batch.num_rows):
                words = data[offsets[i]:offsets[i + 1]].tobytes().split()  # bytes: ASCII white space alone
                total.append(len(words))
                if copy[i] and len(words) >= window:
                    left = []
                elif starts[i].is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.unique(starts[i].values.to_numpy())
                    edge[at] += 1
                    edge[at + window] -= 1
                    left = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                else:
                    left = words
                text = b" ".join(left)
                gone.append(len(words) - len(left))
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` unchanged; ``kept_text`` joins the words
    that stay by one space.  Null and empty texts have no words.  Rows that
    share an id are not smaller than each other; a row without an id keeps its
    words and covers no other.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    named = base.where("doc_id is not null")

    digest = named.select("doc_id", "th", F.sha2("text", 256).alias("sha"))
    least = saved(digest.groupBy("sha").agg(F.min("doc_id").alias("least")), "texts")
    copies = saved(digest.join(least, "sha").where("doc_id > least").select("doc_id", "th").distinct(), "copies")

    grams = named.mapInArrow(_gram_rows(min(window, FIRST_FULL)), "h long, doc_id long, th long")
    repeated = saved(grams.groupBy("h").agg(F.min("th").alias("lo"), F.max("th").alias("hi"),
                                            F.min("doc_id").alias("least"))
                     .where("lo < hi").select("h", "least"), "grams")
    # written on its own, so that the grams' shuffle is gone when the texts are shuffled
    seen = saved(grams.join(repeated, "h").groupBy("doc_id", "th")
            .agg(F.collect_list("h").alias("seen"),
                 F.collect_list(F.when(F.col("least") < F.col("doc_id"), F.col("h"))).alias("later"))
            .join(copies, ["doc_id", "th"], "left_anti"), "seen")
    work = saved(named.join(seen, ["doc_id", "th"]).select("doc_id", "th", "text", "seen", "later"), "work")

    schema = "a long, b long, doc_id long, th long, start int"
    before = None
    for length in levels(window):
        last = length == window
        found = work.mapInArrow(_window_rows(length, before, False), schema)
        known = saved(found.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                      .where("lo < hi").select("a", "b", "lo"), f"level{length}")
        if last and before is None:
            found = work.mapInArrow(_window_rows(length, before, True), schema)
        hit = found.join(known, ["a", "b"])
        hit = (hit.where("lo < doc_id") if last else hit).groupBy("doc_id", "th").agg(
            F.collect_list("start").alias("starts"))
        if last or known.isEmpty():
            break
        work, before = saved(work.select("doc_id", "th", "text").join(hit, ["doc_id", "th"]), f"work{length}"), length

    flags = copies.withColumn("copy", F.lit(True))
    # a text that is a copy never has starts of its own
    fate = saved(hit.select("doc_id", "th", "starts", F.lit(False).alias("copy"))
                 .unionByName(flags.withColumn("starts", F.lit(None).cast("array<int>"))), "fate")
    return (base.join(fate, ["doc_id", "th"], "left")
            .select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
            .mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                                       "kept_text string"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: repeated 13-word passages of all ``documents``."""
    from cobi.llm.common import table
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM low WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (
           SELECT win.doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN least ON win.g = least.g WHERE lo < win.doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM low),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY doc_id)
SELECT low.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM low LEFT JOIN kept ON low.doc_id = kept.doc_id
"""
