import hashlib
import random

import numpy as np
import pytest

from cobi.llm.merkle import differences, fingerprint_documents, fingerprints, leaves_of, likeness, query
from tests.conftest import SF_SMALL, table


def prints(*texts):
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return fingerprints(data, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))[0]


def brute(rows):
    """(id, text) rows in order of id -> what the contract fixes."""
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(line):
        t, nxt = t or "", line[(k + 1) % len(line)][1] or ""
        n = len(t)
        e = t[:n - n // 2] + nxt[:n // 2]
        p, q, r = prints(t, e, nxt)
        out.append((i, n, hashlib.sha256(e.encode()).hexdigest(), p, q, likeness(p, q), likeness(p, r)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    want = brute([(r.doc_id, r.text) for r in table(spark, "documents").collect()])
    assert got(query(spark, SF_SMALL)) == want
    long = [r for r in want if r[1] > 400]
    assert np.mean([r[5] for r in long]) > 0.4 > 0.1 > np.median([r[6] for r in long])
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in want)


@pytest.mark.parametrize("rows", [
    [(1, "only one row, its own next")],
    [(1, None), (2, ""), (3, " \n\n "), (5, "é" * 7), (9, "x\ny")],
    [(None, "no id"), (1, "a b"), (1, "a b"), (1, "c"), (2, "tie"), (2, None)],
    [(k, f"text {k} " * (k % 7)) for k in range(200)],
    [(1, "long " * 20000), (2, "w" * 100000), (3, "\n" * 1000)],
])
def test_rows(spark, rows):
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, range string").repartition(3)
    assert got(fingerprint_documents(docs)) == brute(rows)


def test_empty_table(spark):
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equality_and_edits():
    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(2000)]
    text = " ".join(w + ("\n" if rng.random() < 0.03 else "") for w in words)
    assert len(set(prints(text, text))) == 1
    near = text.replace(words[1000], "EDIT", 1)
    for other in (near, text + " ", text.replace(" ", "  ", 1), " " + text, text[:-1]):
        a, b = prints(text, other)
        assert a[:32] != b[:32] and 0.9 < likeness(a, b) < 1
    a, b = prints(text, near)
    (x, y), (u, v) = differences(a, b)
    assert 0 < y - x <= 4 and 0 < v - u <= 4
    assert (leaves_of(a)[:x] == leaves_of(b)[:u]).all()
    assert differences(a, a)[0][0] == differences(a, a)[0][1]
    assert prints("")[0][32:] == "" and likeness(*prints("", "x")) == 0 and likeness(*prints("", "")) == 1
