"""Operator 11: phrase collocations by Toivonen's sampling algorithm.

Phrases are 1 to ``longest`` consecutive words inside a piece of text; ``f`` is
how often one occurs in all texts of its language.

1. **Proposal.**  A sample of the documents (``fraction``, drawn by hash) is
   mined level by level at a lowered threshold: 3 standard deviations under
   what a phrase at ``least`` is expected to have there.
2. **Full pass.**  Every text is read once and two kinds of phrases are counted
   exactly: the proposed ones, and their *negative border*, which are the
   phrases that were not proposed although their first k - 1 and their last
   k - 1 words were (single words always count).
3. **Closing passes.**  A border phrase that reaches ``least`` is a failure of
   the sample: longer phrases around it may be frequent without having been
   counted.  Failures join the proposals, and one more pass counts only what
   the larger border adds, until a pass finds no failure.  A phrase of ``f >=
   least`` has only parts with ``f >= least``, so the result is exact whatever
   the sample was; the sample decides the number of passes alone.

A pass keeps the proposals as a bitmap of ``2**bits`` phrase hashes: a fixed size
at any corpus, and a false hit only has one more phrase counted.  Phrases are
compared by 93 bits and their length (in the sample, which only proposes, by 64
bits of these), counted in tasks and summed by Spark; their words come back in a last pass, which spells each frequent phrase from a few of
its occurrences.  Parts, scores and containment are then joins of the frequent
phrases.

Cases: a null text is empty, a null language is ``und``; rows are counted as
they stand, repeated ids or not (ids only draw the sample); a text of any
length is worked on whole; an empty table gives no rows; ties go by score, a
and the phrase's bytes, which differ within a language; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.bitmap import Bitmap, bitmap_of
from cobi.llm.common import Shared, partitions, saved
from cobi.operators.numbering import number_rows

LEAST = 100       # occurrences of a candidate
LONGEST = 5       # words
TOP = 2000        # phrases reported for each language
FRACTION = 4      # one document in so many is sampled
BITS = 26
_FLUSH = 1 << 22  # phrases held in a task before equal ones are summed
_TAKEN = 12       # occurrences from which a phrase's words are read

_END = np.zeros(256, dtype=bool)       # bytes that end a piece
_END[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_WORD = ~_END                          # bytes of a word
_WORD[[0x20, 9]] = False

# a phrase is h1 and the number of its words with 29 more bits, in h2
_COUNTS = "h1 long, h2 int, n long"
_PROPOSED = "h1 long, n long"
_LEVEL = "h2 & 7"
_ZEROS = W.mix(np.arange(24, dtype=W.U64), 6)   # a mask for each class of frequency
_A1, _A2 = W.U64(0xD6E8FEB86659FD93), W.U64(0xA0761D6478BD642F)


def _pieces(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """(words, word hashes of their language, words left in the piece from each word on)."""
    w = W.Words(W.LOWER[data], offsets, _WORD)
    lang_data, lang_offsets = W.column_bytes(rows.column("lang"))
    full = np.zeros(256, dtype=bool) | True
    lang = np.zeros(len(w.counts), dtype=W.U64)
    names = W.Words(lang_data, lang_offsets, full)
    lang[names.counts > 0] = names.hashes()
    h = w.hashes() + W.mix(lang, 9)[w.doc()]
    n = len(w)
    if not n:
        return w, h, np.zeros(0, np.int64)
    piece = np.cumsum(_END[data])[w.start] + w.doc()  # both rise, so a change of either shows
    last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True))
    return w, h, last[np.searchsorted(last, np.arange(n))] + 1 - np.arange(n)


def _first_hashes(h: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hash of the k words from each word on), each from the one before."""
    raw = h
    for k in range(1, longest + 1):
        if k > 1:
            raw = raw[:-1] * _A1 + h[k - 1:]
        yield k, W.mix(raw, 7)


def _second_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """h2 of the k words from each of ``at`` on."""
    raw = W.mix(h[at], 5)
    for j in range(1, k):
        raw = raw * _A2 + W.mix(h[at + j], 5)
    return ((W.mix(raw, 8) >> W.U64(35)).astype(np.int64) * 8 + k - (1 << 31)).astype(np.int32)


def _summed(h1: list, h2: list) -> pa.RecordBatch:
    if not h2:
        h1 = np.sort(np.concatenate(h1))
        new = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(W.signed(h1[new])), pa.array(np.diff(np.append(new, len(h1))))], names=["h1", "n"])
    h1, h2 = np.concatenate(h1), np.concatenate(h2)
    order = np.argsort(h1)
    h1, h2 = h1[order], h2[order]
    new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
    return pa.RecordBatch.from_arrays(
        [pa.array(W.signed(h1[new])), pa.array(h2[new]), pa.array(np.diff(np.append(new, len(h1))))],
        names=["h1", "h2", "n"])


def _count(levels: list[int], known: Shared | None, added: Shared | None, both_hashes: bool):
    """Occurrences of each phrase whose two parts of one word less are
    ``known``; with ``added``, the part of known that is new, only of those that
    have a new part (the others were counted before)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), 0
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                _, h, left = _pieces(rows, data, offsets)
                both = None     # words from which the k - 1 words here and one further are known
                for k, x in _first_hashes(h, max(levels)):
                    if k in levels:
                        at = np.flatnonzero(left >= k)
                        at = at if both is None else at[both[at]]
                        if len(at):
                            held[0].append(x[at])
                            if both_hashes:
                                held[1].append(_second_hashes(h, at, k))
                            size += len(at)
                    if k + 1 in levels and len(x) > 1:
                        both = np.zeros(len(x), dtype=bool)
                        if added is None:
                            hit = known.value.has(x)
                            both[:-1] = hit[:-1] & hit[1:]
                        else:
                            new = added.value.has(x)
                            at = np.flatnonzero(new[:-1] | new[1:])
                            both[at] = known.value.has(x[at]) & known.value.has(x[at + 1])
                if size > _FLUSH:
                    yield _summed(*held)
                    held, size = ([], []), 0
        if size:
            yield _summed(*held)
    return run


def _taken(x: np.ndarray, place: np.ndarray, wanted: Bitmap, thin: bool) -> np.ndarray:
    """Places of the occurrences to spell.  With ``thin`` a phrase of class s is
    wanted under a mask of s, and an occurrence stands for the classes up to the
    number of zeros that its hash ends in."""
    if not thin:
        at = np.flatnonzero(wanted.has(x))
        return at[wanted.has(_turned(x[at]))]
    r, at, out = W.mix(x ^ place[:len(x)], 4), np.arange(len(x)), []
    for s in range(len(_ZEROS)):
        if s:
            at = at[r[at] & W.U64(1 << (s - 1)) == 0]
        if not len(at):
            break
        key = x[at] ^ _ZEROS[s]
        hit = np.flatnonzero(wanted.has(key))
        out.append(at[hit[wanted.has(_turned(key[hit]))]])
    return np.concatenate(out) if out else at


def _turned(x: np.ndarray) -> np.ndarray:
    return (x << W.U64(32)) | (x >> W.U64(32))


def _spelled(longest: int, wanted: Shared, thin: bool):
    """(h1, h2, lang, phrase) of wanted phrases, from some occurrences or from all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                w, h, left = _pieces(rows, data, offsets)
                langs = rows.column("lang").to_pylist()
                doc = w.doc()
                place = W.mix(np.arange(len(h), dtype=W.U64) + h.sum(), 3)
                out = {"h1": [], "h2": [], "lang": [], "phrase": []}
                for k, x in _first_hashes(h, longest):
                    at = _taken(x, place, wanted.value, thin)
                    at = at[left[at] >= k]
                    if not len(at):
                        continue
                    x, y = W.signed(x[at]), _second_hashes(h, at, k)
                    # one occurrence of each
                    order = np.argsort(x, kind="stable")
                    at, x, y = at[order], x[order], y[order]
                    one = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                    out["h1"] += x[one].tolist()
                    out["h2"] += y[one].tolist()
                    out["lang"] += [langs[i] for i in doc[at[one]].tolist()]
                    out["phrase"] += [b" ".join(w.text(j) for j in range(i, i + k)).decode() for i in at[one].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["h1"], pa.int64()), pa.array(out["h2"], pa.int32()),
                     pa.array(out["lang"], pa.string()), pa.array(out["phrase"], pa.string())], names=list(out))
    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n): the words of each language."""
    for batch in batches:
        total: dict[str, int] = {}
        for rows, data, offsets in W.chunks(batch, "text"):
            w = W.Words(data, offsets, _WORD)
            for lang, n in zip(rows.column("lang").to_pylist(), w.counts.tolist(), strict=True):
                total[lang] = total.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["lang", "n"])


def spelled_phrases(docs: DataFrame, frequent: DataFrame, longest: int, bits: int) -> DataFrame:
    """(level, lang, phrase, f) of ``frequent`` phrases (h1, h2, n).  The first pass
    takes each phrase from about ``_TAKEN`` to twice as many of its occurrences; a
    second pass takes all occurrences of those that this has missed, if any."""
    spark, schema = docs.sparkSession, "h1 long, h2 int, lang string, phrase string"
    zeros = F.array(*[F.lit(int(x)) for x in W.signed(_ZEROS)])
    last = F.lit(len(_ZEROS) - 1)
    least = F.least(last, F.floor(F.log2(F.greatest(F.col("n") / _TAKEN, F.lit(1.0)))).cast("int"))
    keys = frequent.select(F.col("h1").bitwiseXOR(F.element_at(zeros, least + 1)).alias("h1"))

    def found(wanted: DataFrame, phrases: DataFrame, thin: bool) -> DataFrame:
        # two bits a phrase, so that hardly any other is spelled
        turned = F.shiftleft("h1", 32).bitwiseOR(F.shiftrightunsigned("h1", 32)).alias("h1")
        both = bitmap_of(wanted.select("h1").unionAll(wanted.select(turned)), bits)
        rows = docs.mapInArrow(_spelled(longest, Shared(spark, both), thin), schema).distinct()
        return saved(rows.join(phrases, ["h1", "h2"]).select(
            "h1", "h2", F.expr(_LEVEL).alias("level"), "lang", "phrase", F.col("n").alias("f")), "spelled")
    first = found(keys, frequent, True)
    missed = saved(frequent.join(first.select("h1", "h2"), ["h1", "h2"], "left_anti"), "missed")
    if not missed.isEmpty():
        first = first.unionAll(found(missed, missed, False))
    return first.drop("h1", "h2")


def _sums(docs: DataFrame, levels: list[int], known: Bitmap | None, added: Bitmap | None, name: str,
          least: int, both_hashes: bool = True) -> DataFrame:
    spark = docs.sparkSession
    share = lambda x: None if x is None else Shared(spark, x)
    rows = docs.mapInArrow(_count(levels, share(known), share(added), both_hashes),
                           _COUNTS if both_hashes else _PROPOSED)
    return saved(rows.groupBy(*rows.columns[:-1]).agg(F.sum("n").alias("n")).where(F.col("n") >= least), name)


def lowered(least: int, fraction: int) -> int:
    """The sample's threshold: 3 standard deviations under the expected count."""
    expected = least / fraction
    return max(2, math.floor(expected - 3 * math.sqrt(expected)))


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, fraction: int = FRACTION,
                     bits: int = BITS, passes: list | None = None) -> DataFrame:
    """(h1, h2, n) of every phrase of up to ``longest`` words with n >=
    ``least``; ``docs`` is (doc_id, text, lang).  ``passes`` collects the number
    of failures of each full pass."""
    if not 1 <= longest <= 7:
        raise ValueError("phrases have 1 to 7 words")
    levels = list(range(1, longest + 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(fraction)) == 0)
    proposed, known = None, None
    for k in levels:
        found = _sums(sample, [k], known, None, f"sample{k}", lowered(least, fraction), both_hashes=False)
        more = bitmap_of(found, bits)
        known = more if known is None else known | more
        proposed = found if proposed is None else proposed.unionAll(found)
        if k > 1 and not more.cells.any():
            break
    counted, added, frequent = levels, None, None
    while True:
        # only frequent ones leave the pass: the others were counted and are out
        now = _sums(docs, counted, known, added, "counts", least)
        frequent = now if frequent is None else frequent.unionAll(now)
        failures = saved(now.where(F.expr(_LEVEL) < longest).join(proposed, "h1", "left_anti"), "failures")
        more = bitmap_of(failures, bits)
        if passes is not None:
            passes.append(failures.count())
        added = more.without(known)
        if not added.cells.any():
            return frequent
        known, counted = known | more, levels[1:]
        proposed = proposed.unionAll(failures.drop("h2"))


def collocations(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 least: int = LEAST, longest: int = LONGEST, top: int = TOP, fraction: int = FRACTION,
                 bits: int = BITS, passes: list | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each
    language by score, then a, both descending, then phrase.

    A candidate has 2 to ``longest`` words and a = f >= ``least``.  Cut after k
    words, it scores floor(1000 * a * n / (l * r)); the lowest-scoring cut
    counts (ties: smallest k).  A candidate is dropped if a longer one contains
    it and is as frequent.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    frequent = frequent_phrases(base, least=least, longest=longest, fraction=fraction, bits=bits, passes=passes)
    totals = saved(base.mapInArrow(_words, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    f = spelled_phrases(base, frequent, longest, bits)

    # contained in a phrase of one word more that is as frequent (a phrase in
    # between is at least as frequent as the longer one, so one word suffices)
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("level") - 1), " "),
                              F.array_join(F.slice(words, F.lit(2), F.col("level") - 1), " ")))
    covered = (f.where("level > 2").select("lang", inner.alias("phrase"), F.col("f").alias("longer"))
               .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    candidates = (f.where("level > 1").join(covered, ["lang", "phrase"], "left")
                  .where("longer is null or longer < f").select("lang", "phrase", "level", F.col("f").alias("a")))

    parts = f.select("lang", F.col("phrase").alias("part"), "f")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("k")).select(
        "lang", "phrase", "level", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("level") - F.col("k")), " ").alias("rest"))
    cuts = (cuts.join(parts.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"])
            .join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]))
    # a language may hold most phrases: joined, and ranked, in parts of it
    salts = partitions(spark)
    cuts = cuts.withColumn("salt", F.expr(f"pmod(xxhash64(phrase), {salts}L)")).join(
        totals.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)"))), ["lang", "salt"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # exact: a product of a and n has at most 38 digits, and the quotient fits a long, as l >= a
    over = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(16,0)")
    cuts = cuts.withColumn("over", over).withColumn("under", wide("l") * wide("r"))
    cut = F.struct(F.expr("over div under").alias("score"), "k", "l", "r")
    best = (cuts.select("lang", "salt", "phrase", "a", "n", cut.alias("cut"))
            .groupBy("lang", "salt", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
            .select("lang", "salt", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    return _ranked(best, top)


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """The first of each language: first those of each part of it, then by the
    place in a distributed sort of what is left, so that no task has to sort a
    whole language."""
    part = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    few = best.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= top).drop("_rank", "salt")
    few = few.withColumn("_score", -F.col("score")).withColumn("_a", -F.col("a"))
    placed = number_rows(few, ["lang", "_score", "_a", "phrase"], id_col="_place")
    first = saved(placed.groupBy("lang").agg(F.min("_place").alias("_first")), "first")
    return (placed.join(first, "lang").withColumn("rank", F.col("_place") - F.col("_first") + 1)
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the collocations of all ``documents``."""
    from cobi.llm.common import table
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT lang, p, row_number() OVER () AS id FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s
    FROM split, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS f FROM gram GROUP BY lang, phrase, k HAVING count(*) >= 100),
part AS (SELECT lang, phrase, f, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + j - 1], ' ') AS phrase, max(f) AS longer FROM (
    SELECT lang, w, f, j, unnest(range(1, k - j + 2)) AS s FROM part, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)
  GROUP BY 1, 2),
cut AS (
  SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM part)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, c, x.f AS l, y.f AS r, n,
         ((1000::HUGEINT * cut.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest
  JOIN total ON total.lang = cut.lang),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE o = 1 AND (longer IS NULL OR longer < a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""
