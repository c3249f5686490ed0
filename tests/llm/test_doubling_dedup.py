import hashlib
import random
import re

import pytest

from cobi.llm.doubling_dedup import levels, query, remove_repeats
from tests.conftest import SF_SMALL, table


def brute(pairs, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in pairs]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            if i is not None:
                least[s] = min(i, least.get(s, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    want = brute([(r.doc_id, r.text) for r in table(spark, "documents").collect()])
    assert got(query(spark, SF_SMALL)) == want
    assert sum(n for _, _, n, _ in want) > 0


@pytest.mark.parametrize("window", [2, 5, 13, 30, 60])
def test_other_lengths(spark, window):
    rng = random.Random(window)
    parts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 80))) for _ in range(12)]
    rows = [(i, "  ".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(docs, window=window)) == brute(rows, window)
    assert all(b <= 2 * a for a, b in zip(levels(window), levels(window)[1:], strict=False))


def test_edge_rows(spark):
    long = " ".join(f"w{k % 50}" for k in range(5000))
    p = " ".join(f"p{k}" for k in range(15))
    rows = [(5, None), (6, ""), (7, " \n\t"), (3, long), (1, long), (2, long + " end"), (None, p), (8, p), (9, p), (9, p),
            (9, "x " + p), (10, "é " + p + " z"), (11, "short text"), (12, "short text")]
    docs = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, th int, copy string")
    assert got(remove_repeats(docs)) == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
