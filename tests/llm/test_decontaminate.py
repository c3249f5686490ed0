import hashlib
import random
import re

import pytest

from cobi.llm.decontaminate import contamination, decontaminate, query
from tests.conftest import SF_SMALL, table


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    index = {}
    for name, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            index.setdefault(tuple(w[k:k + window]), set()).add("" if name is None else str(name))
    sizes = sorted({len(s) for s in index})
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = index.get(tuple(w[k:k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_tables_equal_brute_force(spark):
    want = brute([(r.doc_id, r.text) for r in table(spark, "documents").collect()],
                 [(r.item_id, r.text) for r in table(spark, "benchmark").collect()])
    assert got(query(spark, SF_SMALL)) == want
    assert any(r[-1] for r in want)


@pytest.mark.parametrize("block_words", [30, 10**6])
def test_random_small_alphabet(spark, block_words):
    rng = random.Random(block_words)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, text(rng.randint(4, 25))) for k in range(25)]
    docs = [(k, text(rng.randint(0, 300))) for k in range(30)]
    got_ = got(contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame(items, "item_id long, text string"), block_words=block_words))
    assert got_ == brute(docs, items)


def test_edge_rows(spark):
    items = [(1, "One two; three"), (2, None), (3, "!!"), (None, "x y z w"), (1, "é ß 4"),
             (4, " ".join(f"w{k}" for k in range(30)))]
    docs = [(1, None), (2, ""), (3, "zero ONE, two three. One two"), (4, "x-y-z-w x"), (4, "x-y-z-w x"), (None, "É é ß 4"),
            (5, " ".join(f"W{k % 30}" for k in range(20000))), (6, "clean"), (7, " ".join(f"w{k}" for k in range(9)))]
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(contamination(d, b)) == brute(docs, items)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contamination(empty, b).count() == 0
    assert got(contamination(d, b.limit(0))) == brute(docs, [])


def test_cut(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(40))
    split = passage.split()
    nested = " ".join(split[:6] + split + split[6:])   # the cut joins the two halves
    rows = [(1, f"{filler}. {passage.upper()}! end", "a"), (2, passage, "b"), (3, filler, "c"), (4, None, "d"),
            (5, f"{filler} {nested} {filler}", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string")
    out = {r.doc_id: (r.text, r.n_hit) for r in decontaminate(docs, items).collect()}
    assert out == {1: (f"{filler}. ! end", "a"), 3: (filler, "c"), 4: (None, "d"), 5: (f"{filler}  {filler}", "e")}
