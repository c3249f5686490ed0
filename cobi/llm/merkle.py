"""Operator 6: document fingerprints as Merkle trees.

A text is cut into units (a word with the white space that follows it).  Units
form leaves, leaves paragraphs (a line break ends one), paragraphs sections (a
blank line, or a paragraph whose digest says so), and sections the root.  Where
a leaf ends is decided by its last word alone, so an edit moves no other limit.
Each node's digest is made from its children's, the root by BLAKE2 over the
sections' digests.

The fingerprint holds the root and one record of 8 hex digits for each leaf:
30 bits of its digest and, in the two low bits, whether it ends a paragraph
(1) or a section (2).  Inner digests follow from the records, so two
fingerprints alone test equality (roots), give the likeness (the leaves shared,
as a Dice coefficient) and locate edits (``differences``).

Next documents come from one shuffle: rows are dealt to ranges of ids and
sorted there, and the first row of each range is also sent to the range before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import partitions

LEAF = 8      # a leaf has this many words on average
SECTION = 4   # and a section this many paragraphs, where blank lines say nothing
_PARAGRAPH, _SECTION = 1, 2


def _fold(values: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    """Digest of each run of ``values`` (runs start at ``begin``), in order."""
    if not len(begin):
        return np.zeros(0, dtype=W.U64)
    size = np.diff(np.append(begin, len(values)))
    place = np.arange(len(values)) - np.repeat(begin, size)
    power = np.full(int(size.max()), 0xD6E8FEB86659FD93, dtype=W.U64)
    power[0] = 1
    power = np.cumprod(power, dtype=W.U64)
    total = np.add.reduceat(W.mix(values, salt) * power[place], begin)
    return W.mix(total + size.astype(W.U64) * W.U64(0x9E3779B97F4A7C15), salt)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """(fingerprint, leaf records) of each text."""
    w = W.Words(data, offsets, W.NON_SPACE)
    n_docs = len(offsets) - 1
    # units: from a word to the next one; the first takes leading white space
    none = w.counts == 0
    spaces = none & (offsets[1:] > offsets[:-1])        # white space alone is one unit
    start, word = w.start.copy(), w.hashes()
    start[w.first[:-1][~none]] = offsets[:-1][~none]
    begin = np.concatenate([start, offsets[:-1][spaces]])
    word = np.concatenate([word, np.zeros(int(spaces.sum()), W.U64)])
    order = np.argsort(begin, kind="stable")
    begin, word = begin[order], word[order]
    counts = w.counts + spaces
    first = np.concatenate([[0], np.cumsum(counts)])
    end = np.append(begin[1:], len(data))
    last = first[1:][counts > 0] - 1
    end[last] = offsets[1:][counts > 0]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    breaks = lines[end] - lines[begin]
    unit = W.Words.__new__(W.Words)
    unit.data, unit.start, unit.end = data, begin, end
    h = unit.hashes()

    ends_paragraph = breaks > 0
    ends_paragraph[last] = True
    ends_leaf = ends_paragraph | (W.mix(word, 31) % W.U64(LEAF) == 0)
    leaf_begin = np.concatenate([[0], np.flatnonzero(ends_leaf)[:-1] + 1]) if len(h) else np.zeros(0, np.int64)
    leaf = _fold(h, leaf_begin, 41)
    leaf_last = np.flatnonzero(ends_leaf)
    paragraph_end = ends_paragraph[leaf_last]
    par_begin = np.concatenate([[0], np.flatnonzero(paragraph_end)[:-1] + 1]) if len(leaf) else np.zeros(0, np.int64)
    par = _fold(leaf, par_begin, 42)
    par_last = leaf_last[paragraph_end]
    ends_doc = np.zeros(len(h), dtype=bool)
    ends_doc[last] = True
    section_end = ends_doc[par_last] | (breaks[par_last] > 1) | (W.mix(par, 32) % W.U64(SECTION) == 0)
    sec_begin = np.concatenate([[0], np.flatnonzero(section_end)[:-1] + 1]) if len(par) else np.zeros(0, np.int64)
    section = _fold(par, sec_begin, 43)

    record = (leaf >> W.U64(34)).astype(np.uint32) << np.uint32(2)
    at = np.flatnonzero(paragraph_end)
    record[at] |= np.where(section_end, _SECTION, _PARAGRAPH).astype(np.uint32)
    leaf_first = np.searchsorted(leaf_last, first)
    section_first = np.searchsorted(par_last[section_end], first)
    out, leaves = [], []
    for d in range(n_docs):
        own = record[leaf_first[d]:leaf_first[d + 1]]
        root = hashlib.blake2b(section[section_first[d]:section_first[d + 1]].astype("<u8").tobytes(), digest_size=16)
        out.append(root.hexdigest() + own.astype(">u4").tobytes().hex())
        leaves.append(own)
    return out, leaves


def leaves_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint[32:]), dtype=">u4").astype(np.uint32)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    x, n = np.unique(a >> np.uint32(2), return_counts=True)
    y, m = np.unique(b >> np.uint32(2), return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _likeness(root_a: str, a: np.ndarray, root_b: str, b: np.ndarray) -> float:
    if root_a == root_b:
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    # different roots are never quite alike, whatever the records say
    return min(2 * _shared(a, b) / (len(a) + len(b)), 1 - 1 / (len(a) + len(b) + 1))


def likeness(a: str, b: str) -> float:
    """Share of the leaves that two fingerprints have in common, 0 to 1; 1 for
    equal roots alone."""
    return _likeness(a[:32], leaves_of(a), b[:32], leaves_of(b))


def differences(a: str, b: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """Leaves between the branches that both trees start and end with:
    (first, end) in each; empty for equal texts.  Whole sections that agree are
    passed by their digests, then paragraphs, then leaves."""
    if a[:32] == b[:32]:
        n = len(leaves_of(a))
        return (n, n), (n, n)
    x, y = leaves_of(a), leaves_of(b)

    def common(x: np.ndarray, y: np.ndarray, most: int) -> int:
        n = min(len(x), len(y), most)
        other = np.flatnonzero(x[:n] != y[:n])
        return int(other[0]) if len(other) else n

    def branches(x: np.ndarray, mask: int) -> list[bytes]:
        cut = np.flatnonzero((x & mask) != 0) + 1
        return [p.tobytes() for p in np.split(x, cut[:-1] if len(cut) and cut[-1] == len(x) else cut)]

    def along(x: np.ndarray, y: np.ndarray) -> int:
        done = 0
        for mask in (_SECTION, _SECTION | _PARAGRAPH):
            for p, q in zip(branches(x[done:], mask), branches(y[done:], mask), strict=False):
                if p != q:
                    break
                done += len(p) // 4
        return done + common(x[done:], y[done:], 1 << 60)
    head = along(x, y)
    tail = common(x[::-1], y[::-1], min(len(x), len(y)) - head)
    return (head, len(x) - tail), (head, len(y) - tail)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range; each row's next one follows it, at the end of a
    range as a copy (``ahead``)."""
    held = None  # the last row: id, text, ahead, fingerprint, leaves
    for batch in batches:
        for rows, data, offsets in W.chunks(batch, "text"):
            prints, leaves = fingerprints(data, offsets)
            ahead = rows.column("ahead").to_pylist()
            ids = rows.column("doc_id").to_pylist()
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            line = list(zip(ids, texts, ahead, prints, leaves, strict=True))
            if held is not None:
                line.insert(0, held)
            held = line.pop()
            pairs = [(a, b) for a, b in zip(line, [*line[1:], held], strict=True) if not a[2]]
            edited = []
            for a, b in pairs:
                n = len(a[1])
                edited.append((a[1][:n - n // 2] + b[1][:n // 2]).encode())
            joined = np.frombuffer(b"".join(edited), dtype=np.uint8)
            limits = np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64)
            new, new_leaves = fingerprints(joined, limits)
            yield pa.RecordBatch.from_arrays([
                pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([a[3] for a, _ in pairs], pa.string()), pa.array(new, pa.string()),
                pa.array([_likeness(a[3][:32], a[4], f[:32], g)
                          for (a, _), f, g in zip(pairs, new, new_leaves, strict=True)], pa.float64()),
                pa.array([_likeness(a[3][:32], a[4], b[3][:32], b[4]) for a, b in pairs], pa.float64()),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of each row.

    The edited text keeps the first code points and takes as many as the last
    half had from the next row in ascending id (after the last: the first).
    A null text is empty; an empty text has the root of no sections and is
    like nothing but another empty one.  Rows without an id come before all
    others; rows that share an id follow each other in the order of their
    texts.  Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    parts = 2 * partitions(spark)
    ranges = 3 * parts
    found = base.select(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q")).first().q
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))
    # one row for each range, of which there are as many as asked for
    firsts = {r.range: r.k for r in base.select(key.alias("k")).select(range_of("k").alias("range"), "k")
              .groupBy("range").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    starts = np.array([firsts[r] for r in order], dtype=np.int64)
    before = np.array([order[k - 1] for k in range(len(order))], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series) -> pd.Series:
        """The row's range; for a range's first row also the range before."""
        x = k.to_numpy()
        own = np.searchsorted(bounds, x, side="right")
        at = np.minimum(np.searchsorted(starts, x), len(starts) - 1)
        is_first = starts[at] == x
        return pd.Series([[int(r), int(before[a])] if f else [int(r)] for r, a, f in zip(own, at, is_first, strict=True)])
    dealt = base.select("doc_id", "text", F.posexplode(targets(key)).alias("copy", "range"))
    return (dealt.select("doc_id", "text", "range", (F.col("copy") > 0).alias("ahead"))
            .repartition(parts, "range").sortWithinPartitions("range", "ahead", F.asc_nulls_first("doc_id"), "text")
            .mapInArrow(_stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all ``documents``."""
    from cobi.llm.common import table
    return fingerprint_documents(table(spark, sf_dir, "documents"))
