"""Operator 4: benchmark decontamination with a generalised suffix automaton.

The normalised test items are the query set: they are read in blocks of at most
``BLOCK_WORDS`` words, each block becomes one generalised suffix automaton (at
most two states a word, so its broadcast has a known bound), and every training
text streams through it once.  After each word the automaton gives the longest
item passage that ends there; where that reaches a window's length, the state
names the items.  Blocks follow each other as narrow steps without a shuffle.

Most words need no step: a word that no item holds resets the match, so only
runs of known words at least as long as the shortest window are streamed.  The
runs are found on whole byte arrays.

``decontaminate`` cuts the matched spans out of the texts, and drops a document
if more than ``max_coverage`` of its words are matched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import Shared

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 100_000


def item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    w = W.Words(W.LOWER[data], np.array([0, len(data)]), W.ALNUM)
    return [w.text(i) for i in range(len(w))]


class Automaton:
    """Generalised suffix automaton of items, over word numbers.

    ``step`` maps state * size + word to the next state, ``items`` a state to
    the items whose ``window``-word passage it holds, ``short`` a state to the
    (length, item) of whole shorter items that end there.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        names = sorted({x for _, ws in items for x in ws})
        number = {x: k for k, x in enumerate(names)}
        self.size, self.window = max(1, len(names)), window
        self.shortest = min([window, *(len(ws) for _, ws in items)])
        joined = b" ".join(names)
        data = np.frombuffer(joined, dtype=np.uint8)
        w = W.Words(data, np.array([0, len(data)]), W.ALNUM)
        h = w.hashes()
        self.order = np.argsort(h)
        self.known = h[self.order]
        self.step: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        out: list[list[int]] = [[]]  # words with a step from the state, for copying
        size, step, length, link = self.size, self.step, self.length, self.link

        def state(n: int, back: int, words: list[int]) -> int:
            length.append(n)
            link.append(back)
            out.append(words)
            return len(length) - 1

        def split(p: int, c: int, q: int) -> int:
            clone = state(length[p] + 1, link[q], list(out[q]))
            for x in out[q]:
                step[clone * size + x] = step[q * size + x]
            while p != -1 and step.get(p * size + c) == q:
                step[p * size + c] = clone
                p = link[p]
            link[q] = clone
            return clone

        for _, ws in items:
            last = 0
            for c in (number[x] for x in ws):
                q = step.get(last * size + c)
                if q is not None:  # the passage is known from an earlier item
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                    continue
                cur, p = state(length[last] + 1, 0, []), last
                while p != -1 and p * size + c not in step:
                    step[p * size + c] = cur
                    out[p].append(c)
                    p = link[p]
                if p != -1:
                    q = step[p * size + c]
                    link[cur] = q if length[q] == length[p] + 1 else split(p, c, q)
                last = cur
        self.items: dict[int, list[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, ws in items:
            at = 0
            for k, x in enumerate(ws, 1):
                at = step[at * size + number[x]]
                if k >= window:
                    held = self.items.setdefault(self.holder(at), [])
                    if name not in held:
                        held.append(name)
            if len(ws) < window:
                short.setdefault(at, []).append((len(ws), name))
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for v in range(len(length)):
                chain, u = [], v
                while u > 0:
                    chain += short.get(u, [])
                    u = link[u]
                if chain:
                    self.short[v] = chain

    def holder(self, v: int) -> int:
        """The state on v's suffix chain that holds the passage of ``window`` words."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def words(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no item holds."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.order[at], -1)

    def stream(self, numbers: list[int]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, end, items) of each window that occurs."""
        v = n = 0
        step, size, length, link = self.step, self.size, self.length, self.link
        for k, c in enumerate(numbers):
            to = step.get(v * size + c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = step.get(v * size + c)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            if n >= self.window:
                yield k + 1 - self.window, k + 1, self.items[self.holder(v)]
            if self.short and v in self.short:
                for m, name in self.short[v]:
                    if n >= m:
                        yield k + 1 - m, k + 1, [name]


def matches(auto: Automaton, w: W.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """(mask of the words hit, items by document number)."""
    hit, found = np.zeros(len(w), dtype=bool), {}
    if not len(w) or not len(auto.known):
        return hit, found
    numbers = auto.words(w.hashes())
    known = numbers >= 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    edge = w.first[:-1][w.counts > 0]
    begin[edge] = known[edge]
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    edge = w.first[1:][w.counts > 0] - 1
    stop[edge] = known[edge]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    enough = b - a >= auto.shortest
    doc = np.searchsorted(w.first, a, side="right") - 1
    for i, j, d in zip(a[enough].tolist(), b[enough].tolist(), doc[enough].tolist(), strict=True):
        for x, y, names in auto.stream(numbers[i:j].tolist()):
            hit[i + x:i + y] = True
            found.setdefault(d, set()).update(names)
    return hit, found


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_STATE = "doc_id long, text string, n_words long, spans array<int>, items array<string>"


def _scan(shared):
    """One block: adds its spans (word numbers) and items to the earlier ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                w = W.Words(W.LOWER[data], offsets, W.ALNUM)
                hit, found = matches(auto, w)
                spans, items = rows.column("spans").to_pylist(), rows.column("items").to_pylist()
                touched = np.unique(w.doc()[hit])
                for d in touched.tolist():
                    own = hit[w.first[d]:w.first[d + 1]]
                    for k in range(0, len(spans[d]), 2):
                        own[spans[d][k]:spans[d][k + 1]] = True
                    spans[d] = [x for s in _spans(own) for x in s]
                    items[d] = sorted({*items[d], *found[d]})
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text"), pa.array(w.counts.astype(np.int64)),
                     pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "spans", "items"])
    return run


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``most`` words (a longer item alone)."""
    block, n = [], 0
    for name, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                                       F.col(text_col).cast("string")).toLocalIterator():
        ws = item_words(text)
        if not ws:
            continue
        if block and n + len(ws) > most:
            yield block
            block, n = [], 0
        block.append((name, ws))
        n += len(ws)
    if block:
        yield block


def automata(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
             block_words: int = BLOCK_WORDS) -> list:
    spark = benchmark.sparkSession
    return [Shared(spark, Automaton(b, window)) for b in blocks(benchmark, id_col, text_col, block_words)]


def find_matches(docs: DataFrame, shared: list, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, spans, items) of each row: the word limits of
    the hit spans (flat pairs) and the ids of the items that occur."""
    state = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"),
        F.array().cast("array<string>").alias("items"))
    for auto in shared or [Shared(docs.sparkSession, Automaton([], WINDOW))]:
        state = state.mapInArrow(_scan(auto), _STATE)
    return state


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()),
             pa.array([len(x) for x in items], pa.int64()),
             pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
             pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row.

    A null or empty text has no words, an item without words no window.  Rows
    are judged one by one, so repeated ids and rows without an id are returned
    as they come; items that share an id count once, and a null item id is the
    empty string.  Other columns are not read.
    """
    return find_matches(docs, automata(benchmark, **options)).mapInArrow(
        _report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut(text: bytes, autos: list[Automaton]) -> tuple[bytes, float]:
    """The text without hit spans, again until none is left (a cut may join
    the ends of another one), and the share of its words that were hit."""
    total = gone = 0
    while True:
        data = np.frombuffer(text, dtype=np.uint8)
        w = W.Words(W.LOWER[data], np.array([0, len(data)]), W.ALNUM)
        total = total or len(w)
        hit = np.zeros(len(w), dtype=bool)
        for auto in autos:
            hit |= matches(auto, w)[0]
        if not hit.any():
            return text, gone / total if total else 0.0
        gone += int(hit.sum())
        parts, at = [], 0
        for a, b in _spans(hit):
            parts.append(text[at:w.start[a]])
            at = w.end[b - 1]
        text = b"".join([*parts, text[at:]])


def _cleaned(shared: list, text_col: str, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = [s.value for s in shared]
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for rows, data, offsets in W.chunks(batch, text_col):
                w = W.Words(W.LOWER[data], offsets, W.ALNUM)
                hit = np.zeros(len(w), dtype=bool)
                for auto in autos:
                    hit |= matches(auto, w)[0]
                touched = np.unique(w.doc()[hit]).tolist()
                if touched:
                    texts, kept = rows.column(at).to_pylist(), np.ones(rows.num_rows, dtype=bool)
                    for d in touched:
                        text, share = cut(data[offsets[d]:offsets[d + 1]].tobytes(), autos)
                        texts[d], kept[d] = text.decode(), share <= max_coverage
                    rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
                    rows = rows.filter(pa.array(kept))
                yield rows
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                  max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """``docs`` with the matched spans cut out of its texts; documents of which
    more than ``max_coverage`` of the words were matched are dropped.  All
    other columns and rows (also those with a null text) stay as they are."""
    shared = automata(benchmark, **options)
    return docs.mapInArrow(_cleaned(shared, text_col, max_coverage), docs.schema) if shared else docs


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all ``documents`` against all ``benchmark`` items."""
    from cobi.llm.common import table
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
passage AS (
  SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
    SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM item WHERE len(w) > 0)),
found AS (
  SELECT d.doc_id, d.s, d.k, p.item FROM (
    SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
      SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM low, (SELECT DISTINCT k FROM passage) WHERE len(w) >= k)
  ) d JOIN passage p ON d.g = p.g AND d.k = p.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT low.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit ON low.doc_id = hit.doc_id LEFT JOIN named ON low.doc_id = named.doc_id
"""
