"""Operator 8: packing documents into fixed-size sequences by bin completion.

Only lengths matter to a packing, and there are at most ``size`` of them.  So:

1. one pass tokenizes every text and writes a row for each piece, with its
   rank among the pieces of its length in its block (the task that made it);
2. the histogram of lengths (at most ``size`` rows) goes to the driver, which
   completes bins there by branch and bound over the whole of it: around the
   largest length left it tries the undominated fillings, fullest first, each as
   often as the histogram allows; the waste bound prunes, best fit is the first
   incumbent, and the search ends at a lower bound on the sequences;
3. a piece's rank among all pieces of its length (block offsets from the
   histogram by block) names its sequence and place in the plan of step 2.

The plan has one entry for each filling and length, so it is bounded by the
sequence size, not by the corpus; no group of pieces ever meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import saved
from cobi.llm.tokens import TOKENIZER, Encoder

SIZE = 4096
NODES = 20_000      # of the search after its first descent; the incumbent is kept beyond it
LIVE = 16           # levels of the search whose fillings are held

Filling = tuple[tuple[int, int], ...]   # (length, times), longest first


# -- the plan -----------------------------------------------------------------

def best_fit(counts: np.ndarray, size: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: bins alike are kept as one entry."""
    open_: dict[int, dict[Filling, int]] = {}
    for length in range(size, 0, -1):
        n = int(counts[length])
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                times = size // length
                full, rest = divmod(n, times)
                for k, m in ((times, full), (rest, 1 if rest else 0)):
                    if m:
                        bins = open_.setdefault(size - k * length, {})
                        f = ((length, k),)
                        bins[f] = bins.get(f, 0) + m
                break
            f, m = next(iter(open_[room].items()))
            times = min(n, room // length)
            used = min(m, n // times)
            n -= used * times
            left = open_[room].pop(f) - used
            if left:
                open_[room][f] = left
            if not open_[room]:
                del open_[room]
            g = f + ((length, times),)
            bins = open_.setdefault(room - times * length, {})
            bins[g] = bins.get(g, 0) + used
    return [(f, m) for bins in open_.values() for f, m in bins.items()]


def _filling(lengths: list[int]) -> Filling:
    out: dict[int, int] = {}
    for a in sorted(lengths, reverse=True):
        out[a] = out.get(a, 0) + 1
    return tuple(out.items())


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences that any packing needs: for each k, pieces over size - k stand
    alone, those over half stand apart, and pieces from k to half fill at most
    what the latter leave (Martello and Toth's second bound)."""
    at = np.arange(size + 1)
    n, w = np.append(np.cumsum(counts), counts.sum()), np.append(np.cumsum(counts * at), (counts * at).sum())
    k, half = np.arange(size // 2 + 1), size // 2
    alone = n[size] - n[size - k]
    apart, apart_w = n[size - k] - n[half], w[size - k] - w[half]
    fill = w[half] - np.where(k > 0, w[k - 1], 0)
    more = -(-(fill - (apart * size - apart_w)) // size)
    return int((alone + apart + np.maximum(0, more)).max())


def undominated(counts: np.ndarray, room: int) -> Iterator[list[int]]:
    """Fillings of ``room``, fullest first: lists of lengths, longest first.

    Left out are fillings to which a piece could be added, and those in which a
    free single piece of the same length could stand for several pieces (it
    would leave the more flexible ones for later)."""
    have = np.flatnonzero(counts[:room + 1])
    if not len(have):
        yield []
        return
    smallest, lengths, reach = int(have[0]), have[::-1].tolist(), None
    for total in range(room, 0, -1):
        if counts[total]:
            rest = counts[:room - total + 1].copy()
            if total < len(rest):
                rest[total] -= 1
            if not rest.any():
                yield [total]
            continue        # one piece dominates several of the same sum
        rest = total - have
        ok = (rest <= have) & (rest > 0)
        ok[ok] = counts[rest[ok]] > (rest[ok] == have[ok])
        for a in have[ok][::-1].tolist():
            if _closed(counts, [a, total - a], room - total, smallest):
                yield [a, total - a]
        if smallest * 3 > total:
            continue
        if reach is None:   # sums that can be made of the lengths from each one on, as bits
            reach, have_bits, cover = [1] * (len(lengths) + 1), 1, (1 << (room + 1)) - 1
            for i in range(len(lengths) - 1, -1, -1):
                a, k, left = lengths[i], 1, min(int(counts[lengths[i]]), room // lengths[i])
                while left:  # 1, 2, 4, ... pieces at once
                    k = min(k, left)
                    have_bits |= have_bits << (a * k) & cover
                    left -= k
                    k *= 2
                reach[i] = have_bits
        for f in _sums(counts, lengths, reach, 0, total, []):
            if len(f) > 2 and not _merged(counts, f) and _closed(counts, f, room - total, smallest):
                yield f


def _sums(counts: np.ndarray, lengths: list[int], reach: list[int], i: int, left: int, f: list[int]):
    """Lists of lengths with the sum ``left``, without dead ends."""
    if not left:
        yield list(f)
        return
    while i < len(lengths) and reach[i] >> left & 1:
        a = lengths[i]
        most = min(int(counts[a]), left // a)
        for k in range(most, 0, -1):
            if reach[i + 1] >> (left - k * a) & 1:
                yield from _sums(counts, lengths, reach, i + 1, left - k * a, f + [a] * k)
        i += 1


def _merged(counts: np.ndarray, f: list[int]) -> bool:
    """Two pieces of a filling could be one free piece."""
    return any(counts[f[i] + f[j]] > f.count(f[i] + f[j]) for i in range(min(len(f), 8)) for j in range(i))


def _closed(counts: np.ndarray, f: list[int], waste: int, smallest: int) -> bool:
    """No piece left over fits in the waste."""
    if waste < smallest:
        return True
    rest = counts[:waste + 1].copy()
    for a in f:
        if a <= waste:
            rest[a] -= 1
    return not rest.any()


def complete(counts: np.ndarray, size: int, nodes: int = NODES) -> tuple[list[tuple[Filling, int]], int, bool]:
    """Branch and bound on the whole histogram: (fillings and times, lower bound,
    proven).  A node takes the largest length left and completes its sequence by
    an undominated filling, as often as there are pieces for it (then less
    often); it is pruned when its waste cannot lead under the incumbent, which is
    best fit at first.  The search ends at the lower bound, when it is exhausted
    (both prove the result), or after ``nodes`` nodes, not counting the ones of
    the first descent, which is always finished."""
    best = best_fit(counts, size)
    best_n, low = sum(m for _, m in best), lower_bound(counts, size)
    if best_n <= low:
        return best, low, True
    left = counts.astype(np.int64).copy()
    total = int((left * np.arange(len(left))).sum())
    chosen: list[tuple[Filling, int]] = []
    used, waste, spent, first = 0, 0, 0, True

    def branches(tried: list[int]) -> Iterator[tuple[list[int], int]]:
        # goes on after ``tried``: the fillings taken so far, the times of the last
        top = int(np.flatnonzero(left)[-1])
        options, f, most = undominated(left, size - top), None, tried[1] - 1
        left[top] -= 1
        for _ in range(tried[0]):
            f = [top, *next(options)]
        left[top] += 1
        while True:
            for times in range(most, 0, -1):
                tried[1] = times
                yield f, times
            left[top] -= 1
            f = next(options, None)
            left[top] += 1
            if f is None:
                return
            f = [top, *f]
            each = size - sum(f)
            spare = (best_n - 1) * size - total - waste
            most = min(int(left[a]) // k for a, k in _filling(f))
            if each:
                most = min(most, max(0, spare // each))
            if not most:    # later fillings waste more
                return
            tried[0] += 1

    def level() -> list:
        tried = [0, 1]
        return [branches(tried), tried]

    stack = [level()]
    while stack:
        if len(stack) > LIVE:
            stack[-1 - LIVE][0] = None  # its sums take megabytes; made again when the search comes back
        if stack[-1][0] is None:
            stack[-1][0] = branches(stack[-1][1])
        step = next(stack[-1][0], None) if first or spent <= nodes else None
        if step is None:
            stack.pop()
            if chosen and len(chosen) > len(stack) - 1 >= 0:
                f, times = chosen.pop()
                for a, k in f:
                    left[a] += k * times
                used -= times
                waste -= times * (size - sum(a * k for a, k in f))
            first = False
            continue
        lengths, times = step
        f = _filling(lengths)
        spent += not first
        for a, k in f:
            left[a] -= k * times
        used += times
        waste += times * (size - sum(lengths))
        chosen.append((f, times))
        if not left.any():
            if used < best_n:
                best, best_n = list(chosen), used
            if best_n <= low:
                return best, low, True
        rest = total - (used * size - waste)
        if left.any() and (first or used + -(-rest // size) < best_n):
            stack.append(level())
        else:
            chosen.pop()
            for a, k in f:
                left[a] += k * times
            used -= times
            waste -= times * (size - sum(lengths))
            first = False
    return best, low, spent <= nodes


def plan(counts: np.ndarray, size: int, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """(filling, times) for a histogram ``counts[length]``."""
    return complete(counts, size, nodes)[0]


def places(fillings: list[tuple[Filling, int]], size: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, in order of their rank: arrays
    sorted by (length, first rank)."""
    rows, seen, sequence = [], {}, 0
    for f, times in fillings:
        offset = 0
        for a, k in f:
            at = seen.get(a, 0)
            rows.append((a, at, sequence, k, offset))
            seen[a] = at + k * times
            offset += a * k
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), table.T.copy(), strict=True))


# -- the passes over the corpus ------------------------------------------------

_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank long, ids binary")


def _pieces(size: int, tokenizer: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = Encoder.shared(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for rows, data, offsets in W.chunks(batch, "text"):
                ids, limits = encoder.encode(data, offsets)
                n = np.diff(limits)
                count = -(-n // size)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(n[doc] - start, size)
                order = np.argsort(length, kind="stable")
                by = length[order]
                run_start = np.searchsorted(by, by, side="left")
                rank = np.empty(len(doc), dtype=np.int64)
                rank[order] = np.arange(len(doc)) - run_start + seen[by]
                seen += np.bincount(length, minlength=size + 1)
                ids = ids.astype("<u4")
                at = limits[doc] + start
                parts = [ids[a:b].tobytes() for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                     pa.array(np.full(len(doc), block, dtype=np.int64)), pa.array(rank),
                     pa.array(parts if with_ids else [None] * len(doc), pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank", "ids"])
    return run


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            # entries of a length are contiguous, and so are its ranks
            at = np.empty(len(length), dtype=np.int64)
            for a in np.unique(length).tolist():
                lo, hi = np.searchsorted(t["length"], [a, a + 1])
                own = length == a
                at[own] = lo + np.searchsorted(t["rank"][lo:hi], rank[own], side="right") - 1
            within = rank - t["rank"][at]
            times = t["times"][at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(t["sequence"][at] + within // times),
                 pa.array(t["offset"][at] + within % times * length), batch.column("ids")],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])
    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A document is its token ids and the end id; one longer than ``size`` is
    cut into pieces of that size, the last one shorter.  Null and empty texts
    are the end id alone.  Rows without an id and rows with a repeated id are
    documents of their own; other columns are not read.  ``ids``: the piece's
    ids as little-endian unsigned 32-bit numbers.  Sequences are numbered from
    0 and filled from offset 0 without gaps.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = saved(base.mapInArrow(_pieces(size, tokenizer, with_ids), _PIECES), "pieces")
    by_block = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r.length] = r.n
    table = docs.sparkSession.sparkContext.broadcast(places(plan(counts, size), size))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids").mapInArrow(
        _placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
                        "offset long, ids binary")
    return out if with_ids else out.drop("ids")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all ``documents`` in sequences of 4,096 tokens."""
    from cobi.llm.common import table
    return pack(table(spark, sf_dir, "documents"))
