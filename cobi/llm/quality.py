"""Operator 5: quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target text (labelled
good and not toxic) and one of the raw corpus (every document), give each
document the importance weight p_target / p_raw.  A model is the rate at which a
hashed n-gram occurs in documents, so bursts inside one text count once.
N-grams are words, the first bytes of words (inflected forms share them), runs
of symbols, and the rates of repeated words, capitals and symbol runs.

Weights are truncated at 1: an n-gram that the target holds more often does not
raise a weight (else long texts win by length alone), and a ratio counts only
if the target's shortfall is beyond ``SIGMAS`` standard errors of chance.  An
n-gram too rare for that counts if no target document holds it and the labelled
junk or toxic documents hold it as far beyond chance: b of B bad documents and
none of T good ones have the log-likelihood ratio 2 b log((T + B) / B).

Documents are sampled by Gumbel top-k over log-weight / ``TEMPERATURE``, with k
the number of documents at or above the threshold.  That is the weight below
which no more than ``MAX_LOSS`` of the labelled good documents lie.  The
temperature is low, so noise only decides between weights that are about equal.

The raw model covers every document, the target model at most ``MAX_LABELLED``
labelled ones, drawn by a hash of their ids.  Tables that reach the driver are
bounded by the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import Shared, saved

BUCKET_BITS = 20
PREFIX = 5
RATES = (0.05, 0.2, 0.5)
SIGMAS = 4.0
SMOOTHING = 1.0
MIN_LOG_RATIO = 1.0
MAX_LOSS = 0.002
TEMPERATURE = 0.05
MAX_LABELLED = 50_000
_SYMBOLS = W.NON_SPACE & ~W.ALNUM
_COUNTED = ["raw", "target", "junk", "toxic"]
_KEYED = "doc_id long, log_weight double, key double"


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, bucket) pairs."""
    low, n = W.LOWER[data], len(offsets) - 1
    w = W.Words(low, offsets, W.ALNUM)
    h, doc = w.hashes(), w.doc()
    first, second = data[w.start], data[np.minimum(w.start + 1, w.end - 1)]
    upper = (w.end - w.start > 1) & (low[w.start] != first) & (low[np.minimum(w.start + 1, w.end - 1)] != second)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    head = W.Words.__new__(W.Words)
    head.data, head.start, head.end = low, w.start, np.minimum(w.end, w.start + PREFIX)
    s = W.Words(low, offsets, _SYMBOLS)
    keys = [(doc, W.mix(h, 1)), (doc, W.mix(head.hashes(), 2)), (s.doc(), W.mix(s.hashes(), 3))]
    for k, count in enumerate((np.bincount(doc[same], minlength=n), np.bincount(doc[upper], minlength=n), s.counts)):
        rate = np.searchsorted(RATES, count / np.maximum(w.counts, 1)).astype(W.U64)
        keys.append((np.arange(n), W.mix(rate + W.U64(100 * k), 4)))
    doc, key = (np.concatenate(x) for x in zip(*keys, strict=True))
    both = W.distinct(doc << bits | (key >> W.U64(64 - bits)).astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


def _counts(labelled, bits: int):
    """(bucket, documents that hold it, target, junk and toxic documents that
    do), once a task; bucket -1 holds the numbers of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 + len(labelled.value), 1 << bits), dtype=np.int64)
        n = np.zeros(len(counts), dtype=np.int64)
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                ids = rows.column("doc_id").fill_null(-1).to_numpy()
                valid = rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                doc, bucket = features(data, offsets, bits)
                for k, own in enumerate([np.ones(len(ids), bool), *(np.isin(ids, x) & valid for x in labelled.value)]):
                    counts[k] += np.bincount(bucket[own[doc]], minlength=1 << bits)
                    n[k] += int(own.sum())
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), *(pa.array(np.append(c[at], x)) for c, x in zip(counts, n, strict=True))],
            names=["bucket", *_COUNTED])
    return run


@dataclass
class Model:
    """Log-ratios of the buckets that have one, and the threshold."""
    buckets: np.ndarray
    ratios: np.ndarray
    bits: int = BUCKET_BITS
    threshold: float = -np.inf

    def log_weights(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << self.bits)
        table[self.buckets] = self.ratios
        doc, bucket = features(data, offsets, self.bits)
        return np.bincount(doc, weights=table[bucket], minlength=len(offsets) - 1)


def _keys(model: Model, batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(log-weight, key) of each row: Gumbel noise by the row's hash, which is
    the last column, over the tempered weight."""
    parts = [model.log_weights(data, offsets) for _, data, offsets in W.chunks(batch, text)]
    weight = np.concatenate(parts) if parts else np.zeros(0)
    u = (batch.column(batch.num_columns - 1).to_numpy().view(W.U64) >> W.U64(12)).astype(np.float64)
    return weight, weight / TEMPERATURE - np.log(-np.log((u + 0.5) / float(1 << 52)))


def _noise(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, F.lit("gumbel")).alias("_u")


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, key = _keys(shared.value, batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(key)],
                                             names=["doc_id", "log_weight", "key"])
    return run


def _accepted(shared, text: str, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_keys(shared.value, batch, text)[1] >= cut))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(kept.schema)[:-1]))
    return run


def kth_largest(df: DataFrame, column: str, k: int, most: int = 10_000) -> float:
    """The exact k-th largest value, by histograms that close in on it; no more
    than ``most`` values (or one repeated value) come to the driver."""
    df = df.select(F.col(column).alias("x"))
    lo, hi = df.agg(F.min("x"), F.max("x")).first()
    while True:
        inside = df.where((F.col("x") >= lo) & (F.col("x") <= hi))
        step = (hi - lo) / 1024
        if not step or lo + step == lo:
            return hi
        bins = {r.b: r for r in inside.groupBy(F.least(F.floor((F.col("x") - lo) / step), F.lit(1023)).alias("b"))
                .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b].n:
                break
            k -= bins[b].n
        lo, hi = bins[b].lo, bins[b].hi
        if lo == hi:
            return hi
        if bins[b].n <= most:
            return sorted((r.x for r in inside.where((F.col("x") >= lo) & (F.col("x") <= hi)).collect()), reverse=True)[k - 1]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED, bits: int = BUCKET_BITS) -> Model:
    """The model of ``docs``; ``labels`` has doc_id, quality (1 is good) and
    toxic (1 is toxic).  Unlabelled and null labels are not used; of repeated
    ones the worst holds.  Without good labels every weight is 1."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rated = (labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = rated.collect()
    good, junk, toxic = (np.array(sorted(r.doc_id for r in rows if rule(r)), dtype=np.int64) for rule in (
        lambda r: r.quality == 1 and r.toxic == 0, lambda r: r.quality == 0, lambda r: r.toxic == 1))
    labelled = Shared(spark, [good, junk, toxic])
    counts = saved(base.mapInArrow(_counts(labelled, bits), "bucket int, " + ", ".join(f"{c} long" for c in _COUNTED))
                   .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _COUNTED)), "counts")
    total = counts.where("bucket = -1").first()
    if total is None or not total.target:
        return Model(np.zeros(0, np.int64), np.zeros(0), bits)
    expected = F.col("raw") * (total.target / total.raw)
    ratio = F.log((F.col("target") + SMOOTHING) / (expected + SMOOTHING))
    short = expected - F.col("target") >= SIGMAS * F.sqrt(expected + 1)
    for bad in ("junk", "toxic"):
        if total[bad]:
            proof = 2 * F.col(bad) * float(np.log((total.target + total[bad]) / total[bad]))
            short = short | ((F.col("target") == 0) & (proof >= SIGMAS ** 2))
    kept = counts.where("bucket >= 0").select("bucket", ratio.alias("r")).where(short & (ratio <= -MIN_LOG_RATIO)).collect()
    model = Model(np.array([r.bucket for r in kept], dtype=np.int64), np.array([r.r for r in kept]), bits)
    shared = Shared(spark, model)

    rated = F.broadcast(spark.createDataFrame([(int(i),) for i in good], "doc_id long"))   # max_labelled at most
    known = base.join(rated, "doc_id", "left_semi").select("doc_id", "text", F.lit(0).cast("long").alias("_u"))
    weights = sorted(r.log_weight for r in known.mapInArrow(_keyed(shared), _KEYED).collect())
    model.threshold = weights[int(MAX_LOSS * len(weights))] if weights else -np.inf
    return model


def resample(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """((doc_id, log_weight, key, accepted) of each row, the key from which
    documents are in the sample).  Null and empty texts have weight 1.  Rows
    that are alike have the same key, so they are in or out together."""
    shared = Shared(docs.sparkSession, model)
    doc_id, text = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    keyed = saved(docs.select(doc_id, text, _noise(doc_id, text)).mapInArrow(_keyed(shared), _KEYED), "keyed")
    k = keyed.where(F.col("log_weight") >= model.threshold).count()
    cut = kth_largest(keyed, "key", k) if k else np.inf
    return keyed.withColumn("accepted", F.col("key") >= cut), cut


def select_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are in the sample, with all their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    _, cut = resample(docs, model, id_col=id_col, text_col=text_col)
    shared = Shared(docs.sparkSession, model)
    noise = _noise(docs[id_col].cast("long"), docs[text_col].cast("string"))
    name = "_u"
    while name in map(str.lower, docs.columns):
        name += "_"
    return docs.select(*[docs[c] for c in docs.columns], noise.alias(name)).mapInArrow(
        _accepted(shared, text_col, float(cut)), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all ``documents``, with the models of them and of ``labels``."""
    from cobi.llm.common import table
    docs = table(spark, sf_dir, "documents")
    return resample(docs, fit(docs, table(spark, sf_dir, "labels")))[0]
