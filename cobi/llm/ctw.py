"""Operator 9: language-model scores by context-tree weighting over bytes.

A text is scored as its lower-cased words with one space between them and an
end byte.  Each byte is eight binary decisions; a node is (context of d bytes,
bits of the byte so far) with the Krichevsky-Trofimov estimate of its counts.
With P_e(node) the KT block probability, the weighted probability

    P_w(node) = 1/2 P_e(node) + 1/2 product of P_w(children)

mixes all depths 0..``DEPTH``, and a bit's probability is the estimates along
its path, each with the node's posterior weight w = 1/2 P_e / P_w.  A path ends
at the deepest context seen in training, so each conditional distribution is
proper for any text.

At scale: documents are dealt into blocks of about ``BLOCK_BYTES`` of text.  A
block sends each distinct word and (context, byte) gram once, however often it
holds it.  The model is the aggregated tables of these, built level by level
with grouped sums (up: counts and log P_w; down: the mixture), and grows with
the corpus.  Only the levels 0..``SPLIT`` are tables of nodes.  The deeper ones
have several times as many nodes as there are grams, so they are never stored:
the grams with the same last ``SPLIT`` context bytes hold whole subtrees, and a
task builds these from the grams, once for the way up and once for the way down.
A block gets back the entries of its own words and grams and
scores its documents with them: nothing is broadcast and no key can be hot,
since it occurs once a block at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobi.llm import words as W
from cobi.llm.common import partitions, saved

DEPTH = 5
SPLIT = 3            # context bytes down to which the levels are tables
TASK_GRAMS = 1 << 18
BLOCK_BYTES = 32_000_000
HELD_OUT = 10        # crc32 of the id modulo this is 0: held out
_SPACE, _END = 0x20, 0x0A
_END_WORD = 0        # key of the end token
_WORD, _GRAM = 0, 1


# -- texts to words and grams --------------------------------------------------

def canonical(w: W.Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram codes, limits by document): every byte of the scored form with the
    ``depth`` bytes before it, high to low; end bytes stand before a text."""
    empty = np.flatnonzero(w.counts == 0)
    at = w.first[empty]
    start = np.insert(w.start, at, 0)
    size = np.insert(w.end - w.start, at, 0)
    counts = np.maximum(w.counts, 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    size = size + 1                                     # the space or end that follows
    pad = np.zeros(len(size), dtype=np.int64)
    pad[first[:-1]] = depth
    stop = np.cumsum(size + pad)
    out = np.full(int(stop[-1]) if len(stop) else 0, _END, dtype=np.uint8)
    body = size - 1
    to = np.repeat(stop - size, body) + (np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body))
    out[to] = w.data[np.repeat(start, body) + (np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body))]
    out[stop - 1] = _SPACE
    out[stop[first[1:] - 1] - 1] = _END
    code = np.zeros(max(0, len(out) - depth), dtype=np.int64)
    for k in range(depth + 1):
        code = code << 8 | out[k:k + len(code)]
    limits = np.concatenate([[0], stop[first[1:] - 1]])
    real = np.ones(len(out), dtype=bool)
    for k in range(depth):
        real[limits[:-1] + k] = False
    code = code[real[depth:]]
    return code, np.concatenate([[0], np.cumsum(np.diff(limits) - depth)])


def word_keys(w: W.Words) -> np.ndarray:
    h = w.hashes()
    return W.signed(np.where(h == _END_WORD, W.U64(1), h))


def _count(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is a training one."""
    own, n = W.counted(keys[train])
    keys = W.distinct(keys)
    out = np.zeros(len(keys), dtype=np.int64)
    out[np.searchsorted(keys, own)] = n
    return keys, out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _block_keys(depth: int):
    """Distinct words and grams of each block; rows come sorted by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {_WORD: [], _GRAM: []}

        def close() -> Iterator[pa.RecordBatch]:
            for kind, own in parts.items():
                if own:
                    keys, n = _merge(own)
                    for i in range(0, len(keys), 1 << 18):
                        k = keys[i:i + (1 << 18)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), now, np.int64)),
                             pa.array(k), pa.array(n[i:i + (1 << 18)])], names=["kind", "block", "key", "n"])
                    own.clear()
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if now is not None and blocks[a] != now:
                    yield from close()
                now = int(blocks[a])
                for rows, data, offsets in W.chunks(batch.slice(a, b - a), "text"):
                    w = W.Words(W.LOWER[data], offsets, W.NON_SPACE)
                    train = ~rows.column("held_out").to_numpy(zero_copy_only=False)
                    ends = np.full(len(train), _END_WORD, dtype=np.int64)
                    parts[_WORD].append(_count(np.concatenate([word_keys(w), ends]),
                                               np.concatenate([train[w.doc()], train])))
                    code, limits = canonical(w, depth)
                    parts[_GRAM].append(_count(code, np.repeat(train, np.diff(limits))))
                for kind in parts:  # what is held stays near the distinct keys of the block
                    if len(parts[kind]) > 4:
                        parts[kind] = [_merge(parts[kind])]
        if now is not None:
            yield from close()
    return run


# -- the tree ------------------------------------------------------------------

def _lgamma(x: Column) -> Column:
    """log Gamma for x >= 1/2: Stirling's series at x + 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    below = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _log_kt(a: Column, b: Column) -> Column:
    """log of the KT probability of any order of a zeros and b ones."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise(
        _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1.0))


def _parent(depth: int) -> Column:
    """Node key with the oldest of ``depth`` context bytes taken away."""
    return F.col("node").bitwiseAND((1 << (8 * depth)) - 1)


def _np_lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    below = sum(np.log(x + k) for k in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _np_log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a + b == 0, 0.0,
                    _np_lgamma(a + 0.5) + _np_lgamma(b + 0.5) - math.log(math.pi) - _np_lgamma(a + b + 1.0))


def _subtrees(keys: np.ndarray, n: np.ndarray, depth: int, split: int, j: int):
    """Levels ``depth``..``split`` of the nodes with ``j`` bits, as (node, a, b,
    kt, pw, place of what is below: of the grams at first), and the grams' bits."""
    byte = keys & 255
    bit = byte >> (7 - j) & 1
    node, place = np.unique(keys - byte + ((byte | 256) >> (8 - j)), return_inverse=True)
    b = np.bincount(place, weights=n * bit, minlength=len(node))
    a = np.bincount(place, weights=n * (1 - bit), minlength=len(node))
    kt = _np_log_kt(a, b)
    levels = [(node, a, b, kt, kt, place)]
    for d in range(depth, split, -1):
        below, a, b, _, pw, _ = levels[-1]
        node, place = np.unique(below & ((1 << (8 * d)) - 1), return_inverse=True)
        a, b, children = (np.bincount(place, weights=x, minlength=len(node)) for x in (a, b, pw))
        kt = _np_log_kt(a, b)
        pw = np.where(a + b == 0, 0.0, np.logaddexp(kt, children) - math.log(2))
        levels.append((node, a, b, kt, pw, place))
    return levels, bit


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``tail``, in tables of about ``TASK_GRAMS`` rows that end
    where a tail ends."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tails = batch.column("tail").to_numpy()
        if rows >= TASK_GRAMS:
            last = held[-1].column("tail")[-1].as_py()
            cut = int(np.searchsorted(tails, last, side="right"))
            if cut < len(tails):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _up(depth: int, split: int):
    """The nodes of level ``split`` from the grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            keys, n = t.column("key").to_numpy(), t.column("n").to_numpy()
            for j in range(8):
                node, a, b, _, pw, _ = _subtrees(keys, n, depth, split, j)[0][-1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, a, b, pw)], names=["node", "a", "b", "pw"])
    return run


def _down(depth: int, split: int):
    """(key, score) of the grams, which come with the nodes of level ``split``
    (``rest`` is null for a gram, and ``final`` its count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            t = t.combine_chunks()
            gram = t.column("rest").is_null().to_numpy()
            key = t.column("key").to_numpy()
            final, total, rest = (t.column(c).to_numpy() for c in ("final", "sum", "rest"))
            keys, n = key[gram], final[gram]
            order = np.argsort(key[~gram])
            nodes, *above = (x[~gram][order] for x in (key, final, total, rest))
            score = np.zeros(len(keys))
            for j in range(8):
                levels, bit = _subtrees(keys, n, depth, split, j)
                at = np.searchsorted(nodes, levels[-1][0])
                f, s, r = (x[at] for x in above)
                for k in range(len(levels) - 2, -1, -1):
                    _, a, b, kt, pw, _ = levels[k]
                    up = levels[k + 1][-1]
                    f, s, r = f[up], s[up], r[up]
                    p, w, seen = (b + 0.5) / (a + b + 1.0), np.exp(kt - pw - math.log(2)), a + b > 0
                    f, s, r = (np.where(seen, s + r * p, f), np.where(seen, s + r * w * p, s),
                               np.where(seen, r * (1 - w), r))
                one = f[levels[0][-1]]
                score += np.log10(np.where(bit == 1, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(score)], names=["key", "score"])
    return run


def _by_tail(df: DataFrame, split: int) -> DataFrame:
    """Rows dealt and sorted by the last ``split`` context bytes of ``key``."""
    tail = F.shiftright("key", 8).bitwiseAND((1 << (8 * split)) - 1)
    return (df.withColumn("tail", tail).repartition(partitions(df.sparkSession), "tail")
            .sortWithinPartitions("tail"))


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, score) from (key, n): log10 probability of a gram's byte after its
    context.  Grams with n = 0 are asked for without having been seen."""
    split = min(SPLIT, depth)
    leaf = (_by_tail(grams.select("key", F.col("n").cast("double").alias("n")), split)
            .mapInArrow(_up(depth, split), "node long, a double, b double, pw double"))
    levels = [saved(leaf.withColumn("kt", _log_kt(F.col("a"), F.col("b"))), f"depth{split}")]
    for d in range(split, 0, -1):
        up = (levels[-1].select(_parent(d).alias("node"), "a", "b", "pw").groupBy("node")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("children"))
              .withColumn("kt", _log_kt(F.col("a"), F.col("b"))))
        high, low = F.greatest("kt", "children"), F.least("kt", "children")
        pw = F.when(F.col("a") + F.col("b") == 0, F.lit(0.0)).otherwise(
            high + F.log1p(F.exp(low - high)) - math.log(2))
        levels.append(saved(up.withColumn("pw", pw).drop("children"), f"depth{d - 1}"))
    down = None
    for d in range(split + 1):
        t = levels[split - d].withColumn("p", (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)) \
            .withColumn("w", F.exp(F.col("kt") - F.col("pw") - math.log(2)))
        if d == 0:
            now = t.select("node", F.col("p").alias("final"), (F.col("w") * F.col("p")).alias("sum"),
                           (1 - F.col("w")).alias("rest"))
        else:
            above = down.select(F.col("node").alias("up"), F.col("final").alias("f"), F.col("sum").alias("s"),
                                F.col("rest").alias("r"))
            joined = t.withColumn("up", _parent(d)).join(above, "up")
            seen = F.col("a") + F.col("b") > 0
            now = joined.select(
                "node", F.when(seen, F.col("s") + F.col("r") * F.col("p")).otherwise(F.col("f")).alias("final"),
                F.when(seen, F.col("s") + F.col("r") * F.col("w") * F.col("p")).otherwise(F.col("s")).alias("sum"),
                F.when(seen, F.col("r") * (1 - F.col("w"))).otherwise(F.col("r")).alias("rest"))
        down = saved(now, f"mixture{d}") if 0 < d < split else now
    none = F.lit(None).cast("double")
    both = (grams.select("key", F.col("n").cast("double").alias("final"), none.alias("sum"), none.alias("rest"))
            .unionAll(down.select(F.col("node").alias("key"), "final", "sum", "rest")))
    return _by_tail(both, split).mapInArrow(_down(depth, split), "key long, score double")


# -- scores --------------------------------------------------------------------

def _score(depth: int, all_tokens: int, distinct: int):
    bottom = all_tokens + 0.1 * (distinct + 1)

    def run(values: pa.Table, docs: pa.Table) -> pa.Table:
        kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
        order = np.lexsort((key, kind))
        kind, key, value = kind[order], key[order], value[order]
        cut = int(np.searchsorted(kind, _GRAM))
        names, counts, grams, scores = key[:cut], value[:cut], key[cut:], value[cut:]
        end = counts[np.searchsorted(names, _END_WORD)] if len(names) else 0.0
        out = []
        for batch in docs.to_batches():
            for rows, data, offsets in W.chunks(batch, "text"):
                w = W.Words(W.LOWER[data], offsets, W.NON_SPACE)
                c = counts[np.searchsorted(names, word_keys(w))] if len(w) else np.zeros(0)
                logs = np.concatenate([[0.0], np.cumsum(np.log10((c + 0.1) / bottom))])
                known = np.concatenate([[0], np.cumsum(c > 0)])
                code, limits = canonical(w, depth)
                total = np.concatenate([[0.0], np.cumsum(scores[np.searchsorted(grams, code)])])
                a, b = w.first[:-1], w.first[1:]
                out.append(pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(w.counts.astype(np.int64) + 1),
                     pa.array(known[b] - known[a] + int(end > 0)),
                     pa.array(np.full(rows.num_rows, all_tokens, np.int64)),
                     pa.array(logs[b] - logs[a] + math.log10((end + 0.1) / bottom)),
                     pa.array(total[limits[1:]] - total[limits[:-1]]), pa.array(np.diff(limits).astype(np.int64))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]))
        return pa.Table.from_batches(out, schema=out[0].schema if out else _OUT)
    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                  ("n_bytes", pa.int64())])


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte) of each row; the model learns from the rows that
    are not held out.

    ``score`` is the log10 probability of the words and the end; bits_per_byte
    the code length that it means for the ``n_bytes`` scored bytes.  A null
    text is empty: the end token alone.  A row without an id is held out;
    repeated rows count as often as they stand there.  Without training rows
    every count is 0 and each bit has probability 1/2.  Other columns are not
    read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % HELD_OUT == 0
    size = base.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first().b or 0
    blocks = -(-size // block_bytes) or 1
    base = base.select("doc_id", held.alias("held_out"), "text",
                       F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).alias("block"))
    keys = saved(base.repartition(max(blocks, partitions(spark)), "block").sortWithinPartitions("block")
                 .mapInArrow(_block_keys(depth), "kind int, block long, key long, n long"), "keys")
    words = saved(keys.where(F.col("kind") == _WORD).groupBy("key").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("all"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    grams = saved(keys.where(F.col("kind") == _GRAM).groupBy("key").agg(F.sum("n").alias("n")), "grams")
    scores = saved(gram_scores(grams, depth), "scores")
    # only the two keyed columns travel: the kind is a part of the join
    model = (words.select(F.lit(_WORD).alias("kind"), "key", F.col("n").cast("double").alias("value"))
             .unionAll(scores.select(F.lit(_GRAM).alias("kind"), "key", F.col("score").alias("value"))))
    values = keys.select("kind", "block", "key").join(model, ["kind", "key"]).select("block", "kind", "key", "value")
    out = (values.groupBy("block").cogroup(base.groupBy("block"))
           .applyInArrow(_score(depth, int(total["all"] or 0), int(total["distinct"] or 0)),
                         "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                         "base_score double, score double, n_bytes long"))
    return out.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all ``documents``."""
    from cobi.llm.common import table
    return score_documents(table(spark, sf_dir, "documents"))
