"""Operator 12 against scores of every document, by every way through the lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cobi.llm.search import Shard, ranked_search
from tests.conftest import table

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"shard_postings": 2000, "block_terms": 60, "bits": 8}])
def test_tables_equal_brute_force(spark, limits):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = ranked_search(docs, items, **limits)
    assert rows_of(got) == want
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,; "), (4, "Ünïcode ÄÖ über"), (5, "a b c"), (5, "a b c"), (6, "A B C"),
            (None, "a b c"), (None, "zebra"), (7, "a " * 20000 + "needle"), (8, "needle a b"), (9, "x1_y2-x1 z")]
    items = [(1, "a b"), (1, "a b"), (2, None), (3, "..."), (4, "needle NEEDLE"), (None, "zebra"), (5, "Über y2"),
             (1, "another c c c"), (6, "absent words")]
    d = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], DOCS + ", n long, kind string")
    q = spark.createDataFrame([(i, t, 0, "k") for i, t in items], ITEMS + ", doc_id long, q string")
    assert rows_of(ranked_search(d, q)) == brute(docs, items)
    assert rows_of(ranked_search(d, q, top=2, shard_postings=3, block_terms=2)) == brute(docs, items, 2)
    assert ranked_search(d.limit(0), q).collect() == [] == ranked_search(d, q.limit(0)).collect()


def test_skipping_keeps_the_best(spark):
    """Short lists beside long ones, ties, and thresholds that skip runs."""
    rng = random.Random(5)
    docs = []
    for i in range(6000):
        t = [f"w{min(int(rng.expovariate(0.35)), 40)}" for _ in range(rng.randint(2, 12))]
        docs.append((i, " ".join(t)))
    docs += [(10000 + i, "w0 w1 w2") for i in range(500)]      # copies: ties go by doc_id
    items = [(k, " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 6)))) for k in range(12)] + [(99, "w0 w1 w2")]
    d, q = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    assert rows_of(ranked_search(d, q)) == brute(docs, items)


def test_most_runs_are_skipped():
    """A shard whose long list has one good place scores few of its runs."""
    n = 50_000
    size = np.full(n, 100)
    size[7] = 1
    each = np.full(n, 1)
    shard = Shard(np.arange(n), size, each, np.full(n, 42), np.ones(n, np.int64), n, int(size.sum()))
    place, score = shard.best([(42, 5)], 1)
    assert place.tolist() == [7] and score[0] > 0
    assert shard.best([(42, 5), (43, 9)], 3)[0].tolist() == [7, 0, 1]
    assert shard.best([(43, 1)], 3)[0].tolist() == []
