import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cobi.llm import ctw
from cobi.llm.ctw import DEPTH, score_documents
from tests.conftest import SF_SMALL, table


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows, depth=DEPTH):
    """Counts in dictionaries, the tree by recursion, one byte after the other."""
    train = [words(t) for i, t in rows if not held(i)]
    counts = Counter(x for w in train for x in [*w, None])
    total, distinct = sum(counts.values()), len(counts)
    stats = defaultdict(lambda: [0, 0])
    below = defaultdict(set)

    def steps(w):
        s = b"\n" * depth + " ".join(w).encode() + b"\n"
        for k in range(depth, len(s)):
            for j in range(8):
                yield s[k - depth:k], (256 | s[k]) >> (8 - j), s[k] >> (7 - j) & 1
    for w in train:
        for context, p, bit in steps(w):
            for d in range(depth + 1):
                stats[context[depth - d:], p][bit] += 1
                if d:
                    below[context[depth - d + 1:], p].add((context[depth - d:], p))

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weight = {}

    def pw(node):
        e = kt(*stats[node])
        if node not in below:
            weight[node] = 1.0
            return e
        c = sum(pw(x) for x in below[node])
        m = max(e, c)
        v = m + math.log(math.exp(e - m) + math.exp(c - m)) - math.log(2)
        weight[node] = math.exp(e - math.log(2) - v)
        return v
    for p in range(1, 256):
        if (b"", p) in stats:
            pw((b"", p))
    out = {}
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + .1) / (total + .1 * (distinct + 1))) for x in [*w, None])
        score = 0.0
        for context, p, bit in steps(w):
            mixed, rest, one = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                node = context[depth - d:], p
                if node not in stats:
                    break
                a, b = stats[node]
                q = (b + .5) / (a + b + 1)
                one = mixed + rest * q
                mixed, rest = mixed + rest * weight[node] * q, rest * (1 - weight[node])
            score += math.log10(one if bit else 1 - one)
        out[i, t] = (held(i), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total, base, score)
    return out


def compare(df, rows):
    want = brute(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        options = [want[r.doc_id, t] for t in texts[r.doc_id]]
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == o[:4]
                   and r.base_score == pytest.approx(o[4], rel=1e-9) and r.score == pytest.approx(o[5], rel=1e-6)
                   for o in options), (r, options)


def test_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").orderBy("doc_id").collect()]
    rows = [r for r in rows if len(r[1]) < 700][:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare(score_documents(docs, block_bytes=4000), rows)


def test_whole_table_held_out_accuracy(spark):
    out = score_documents(table(spark, "documents")).where("held_out").groupBy().sum("score", "base_score", "n_bytes").first()
    # near the unigram base even on this small table, and far from the eight bits of a raw byte
    assert out["sum(score)"] > 1.1 * out["sum(base_score)"]
    assert -out["sum(score)"] * math.log2(10) / out["sum(n_bytes)"] < 3.5
    assert table(spark, "documents").count() == score_documents(table(spark, "documents", SF_SMALL)).count()


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Ä b"), (4, "Ä b"), (None, "no id"), (6, "long " * 3000), (7, "w" * 9000),
            (8, "B  b\tä")]
    docs = spark.createDataFrame([(a, b, 1, 1.0) for a, b in rows], "doc_id long, text string, block int, score double")
    compare(score_documents(docs), rows)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(docs).count() == 0
    one = score_documents(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    assert (one.train_tokens, one.n_known) == (0, 0) and one.score == pytest.approx(24 * math.log10(0.5))


def test_fifth_byte_back_is_used(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["axxxxp", "bxxxxq"]) for _ in range(50))) for i in range(300)],
                                 "doc_id long, text string")
    out = score_documents(docs).where("held_out").groupBy().sum("score", "n_bytes").first()
    # a word is one free choice; without the fifth byte back its end would be another one
    assert -out["sum(score)"] * math.log2(10) / (out["sum(n_bytes)"] / 7) < 1.4


def test_scores_above_the_unigram_base(spark):
    out = score_documents(table(spark, "documents", "/root/testdata/sf0.1")).where("held_out").groupBy() \
        .sum("score", "base_score").first()
    assert out["sum(score)"] > 0.97 * out["sum(base_score)"]


def test_every_depth_and_task_size(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").orderBy("doc_id").limit(5).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth in (0, 2, 3, 6):
        monkeypatch.setattr(ctw, "TASK_GRAMS", 1 + 50 * depth)
        want = brute(rows, depth)
        for r in score_documents(docs, depth=depth).collect():
            assert r.score == pytest.approx(want[r.doc_id, dict(rows)[r.doc_id]][5], rel=1e-6)
