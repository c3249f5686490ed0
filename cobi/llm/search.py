"""Operator 12: ranked lexical search, term at a time and document at a time.

1. The items' terms go into a bitmap of fixed size.  One pass over the
   documents keeps, of each whole text, the number of its terms and the
   occurrences of the terms that the bitmap has (a document without any cannot
   be found); the same pass counts N and L over all documents.
2. Document frequencies and weights are joined to the items' terms by Spark.
3. Documents are dealt over shards and items over blocks, both of bounded size
   (``shard_postings``, ``block_terms``).  A task holds one shard and one block,
   turns the shard into inverted lists, and answers each item by the hybrid:

   * *term at a time*: the short lists are summed into accumulators, sorted by
     document.  Their ``top``-th largest sum is a first threshold;
   * *document at a time*: the accumulators are then one more bounded list
     beside the long ones.  Each list knows the most that it adds within each
     run of ``RUN`` documents; runs whose bounds add up to less than the
     threshold are skipped, the others are scored document by document, in
     order, and raise the threshold.

4. The best of each shard meet per item.

Terms are compared by 64-bit hashes.  All sums are 64-bit integers.

Cases: null and empty texts and texts without a term count in nothing and are
never found; every row of the documents is a document of its own, also if its
id is repeated or null (null ids come last among equals); rows of the items with
the same id and text are one item, those that share an id alone are ranked one
by one; items without a term, empty tables: no rows; texts of any length are
whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.bitmap import bitmap_of
from cobi.llm.common import Shared, partitions, saved

TOP = 20
BITS = 24                 # of the bitmap of query terms
SHARD_POSTINGS = 500_000
BLOCK_TERMS = 200_000
RUN = 128                 # documents of a skipped run
SHORT = 24                # a list of at most 1 / SHORT of a shard's documents is short

_HITS = "kind int, id long, n long, terms array<long>, counts array<long>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    limits = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(values))


def term_counts(data: np.ndarray, offsets: np.ndarray, known=None):
    """(number of terms, document, term, occurrences) with the last three for
    each distinct term of a document, of those ``known``."""
    w = W.Words(W.LOWER[data], offsets, W.ALNUM)
    h, doc = w.hashes(), w.doc()
    if known is not None:
        hit = known.has(h)
        h, doc = h[hit], doc[hit]
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) \
        if len(h) else np.zeros(0, np.int64)
    return w.counts, doc[at], h[at], np.diff(np.append(at, len(h)))


def _terms(known: Shared | None):
    """A row (kind 0) for each document with a known term, and one (kind 1) with
    the documents that have terms, and their terms, of a run of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                n, doc, term, tf = term_counts(data, offsets, known.value if known else None)
                held, each = np.unique(doc, return_counts=True)
                ids = rows.column("id").take(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(np.zeros(len(held)), 1).astype(np.int32)),
                     pa.concat_arrays([ids.cast(pa.int64()), pa.array([int((n > 0).sum())], pa.int64())]),
                     pa.array(np.append(n[held], n.sum()).astype(np.int64)),
                     _lists(W.signed(term), np.append(each, 0)), _lists(tf, np.append(each, 0))],
                    names=["kind", "id", "n", "terms", "counts"])
    return run


class Shard:
    """The inverted lists of some documents, in document order."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, each: np.ndarray, terms: np.ndarray, tf: np.ndarray,
                 docs: int, words: int):
        m = 75 + (25 * n * docs) // words
        place = np.repeat(np.arange(len(ids)), each)
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[place])
        order = np.argsort(terms, kind="stable")
        self.place, self.part = place[order], part[order]
        terms = terms[order]
        at = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        self.where = dict(zip(terms[at].tolist(), zip(at.tolist(), np.append(at[1:], len(terms)).tolist(), strict=True),
                              strict=True))
        self.ids, self.runs, self._most = ids, -(-len(ids) // RUN), {}

    def most(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a list: where each run of documents begins in it, and the most a
        document of the run has."""
        if term not in self._most:
            lo, hi = self.where[term]
            begin = lo + np.searchsorted(self.place[lo:hi], np.arange(self.runs + 1) * RUN)
            most = np.zeros(self.runs, dtype=np.int64)
            full = begin[:-1] < begin[1:]
            most[full] = np.maximum.reduceat(self.part[lo:hi], begin[:-1][full] - lo)
            self._most[term] = begin, most
        return self._most[term]

    def best(self, query: list[tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores) of the ``top`` documents with a score
        above 0, for (term, weight) pairs."""
        lists = [(t, x, *self.where[t]) for t, x in query if x > 0 and t in self.where]
        limit = max(RUN, len(self.ids) // SHORT)
        long = [q for q in lists if q[3] - q[2] > limit]
        short = [q for q in lists if q[3] - q[2] <= limit]
        # accumulators of the short lists
        place, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if short:
            place = np.concatenate([self.place[lo:hi] for _, _, lo, hi in short])
            value = np.concatenate([x * self.part[lo:hi] for _, x, lo, hi in short])
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
            at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            place, value = place[at], np.add.reduceat(value, at)
        if not long:
            return _first(place, value, top)
        floor = int(np.partition(value, -top)[-top]) if len(value) >= top else 1
        # the accumulators are one more list with bounds
        begin = np.searchsorted(place, np.arange(self.runs + 1) * RUN)
        bound = np.zeros(self.runs, dtype=np.int64)
        full = begin[:-1] < begin[1:]
        bound[full] = np.maximum.reduceat(value, begin[:-1][full]) if len(value) else 0
        heads = []
        for t, x, _, _ in long:
            start, most = self.most(t)
            bound += x * most
            heads.append((x, start))
        got, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for r in np.flatnonzero(bound >= floor).tolist():
            if bound[r] <= least:       # later documents lose ties
                continue
            score = np.zeros(RUN, dtype=np.int64)
            base = r * RUN
            lo, hi = begin[r], begin[r + 1]
            score[place[lo:hi] - base] = value[lo:hi]
            for x, start in heads:
                lo, hi = start[r], start[r + 1]
                score[self.place[lo:hi] - base] += x * self.part[lo:hi]  # a document stands once in a list
            new = np.flatnonzero(score > least)
            if len(new):
                got, scores = _first(np.append(got, base + new), np.append(scores, score[new]), top)
                least = int(scores[-1]) if len(scores) == top else 0
        return got, scores


def _first(place: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((place, -score))[:top]
    return place[order], score[order]


def _answered(docs: int, words: int, top: int):
    """Rows arrive by group, the items of a group before its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items, held = None, [], []

        def close():
            out = {"q": [], "item_id": [], "doc_id": [], "score": []}
            if items and held:
                table = pa.Table.from_batches(held).combine_chunks()
                rank = pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_end")
                table = table.take(rank).combine_chunks()
                terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
                ids = table.column("id").to_pylist()
                shard = Shard(np.arange(len(ids)), table.column("n").to_numpy(), np.diff(terms.offsets.to_numpy()),
                              terms.flatten().to_numpy(), counts.flatten().to_numpy(), docs, words)
                for q, item, query in items:
                    place, score = shard.best(query, top)
                    out["q"] += [q] * len(place)
                    out["item_id"] += [item] * len(place)
                    out["doc_id"] += [ids[i] for i in place.tolist()]
                    out["score"] += score.tolist()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], names=list(out))

        for batch in batches:
            groups = batch.column("g").to_numpy()
            limits = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else []
            for lo, hi in zip(limits, [*limits[1:], len(groups)], strict=True):
                if groups[lo] != group:
                    if group is not None:
                        yield close()
                    group, items, held = groups[lo], [], []
                part = batch.slice(lo, hi - lo)
                kind = part.column("kind").to_numpy()
                mid = int(np.searchsorted(kind, 1))
                for row in part.slice(0, mid).to_pylist():
                    items.append((row["n"], row["id"], list(zip(row["terms"], row["counts"], strict=True))))
                if mid < len(kind):
                    held.append(part.slice(mid).select(["id", "n", "terms", "counts"]))
        if group is not None:
            yield close()
    return run


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", top: int = TOP,
                  shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS, bits: int = BITS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a
    score above 0, highest first, equal scores by doc_id.

    Terms are runs of letters, digits and non-ASCII, only A-Z lower-cased.  A
    term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score
    adds weight * (10^9 tf div (1000 tf + 12 m)) for each of the item's terms,
    repeats included, where m = 75 + 25 n N div L.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.distinct().repartition(partitions(spark), "id")
    asked = saved(asked.mapInArrow(_terms(None), _HITS).where("kind = 0")
                  .withColumn("q", F.monotonically_increasing_id()), "items")
    words = asked.select("q", "id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(
        "q", "id", F.col("x.terms").alias("term"), F.col("x.counts").alias("times"))

    known = Shared(spark, bitmap_of(words, bits, "term"))
    hits = saved(base.mapInArrow(_terms(known), _HITS), "hits")
    total = hits.agg(F.sum(F.when(F.col("kind") == 1, F.col("id"))), F.sum(F.when(F.col("kind") == 1, F.col("n"))),
                     F.sum(F.size("terms"))).first()
    n_docs, n_words, postings = (int(x or 0) for x in total)
    found = hits.where("kind = 0")
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2)) / (F.lit(2.0) * F.col("df") + 1)))
    weighed = (words.join(df, "term").withColumn("w", weight.cast("long") * F.col("times"))
               .groupBy("q", "id").agg(F.collect_list(F.struct("term", "w")).alias("x"))
               .select("q", "id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")))
    weighed = saved(weighed, "weights")
    asked_terms = weighed.agg(F.sum(F.size("terms"))).first()[0] or 0

    shards, blocks = max(1, -(-postings // shard_postings)), max(1, -(-asked_terms // block_terms))
    group = F.col("block") * F.lit(shards) + F.col("shard")
    questions = (weighed.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
                 .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
                 .select(group.alias("g"), F.lit(0).alias("kind"), "id", F.col("q").alias("n"), "terms",
                         F.col("weights").alias("counts")))
    # every row is a document, so rows are dealt by their place in the written table
    lists = (found.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select(group.alias("g"), F.lit(1).alias("kind"), "id", "n", "terms", "counts"))
    best = (questions.unionByName(lists).repartition(4 * partitions(spark), "g").sortWithinPartitions("g", "kind")
            .mapInArrow(_answered(n_docs, max(1, n_words), top), "q long, item_id long, doc_id long, score long"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the 20 best documents of each ``benchmark`` item."""
    from cobi.llm.common import table
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM doc WHERE len(w) > 0),
posting AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM doc) GROUP BY doc_id, n, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, total GROUP BY term, nn),
item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM item GROUP BY item_id, term),
score AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= 20
"""
