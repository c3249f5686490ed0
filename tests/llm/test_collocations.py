"""Operator 11 against a count of every phrase, and its sampling against itself."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cobi.llm.collocations import collocations, frequent_phrases, lowered
from tests.conftest import SF_SMALL, table

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest=5, top=2000):
    f, total = {}, Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i:i + k]))
                    f[key] = f.get(key, 0) + 1
    f = {k: n for k, n in f.items() if n >= least}
    out = {}
    for (lang, g), a in f.items():
        if len(g) < 2:
            continue
        if any(m >= a and y == lang and len(x) > len(g) and any(x[i:i + len(g)] == g for i in range(len(x)))
               for (y, x), m in f.items()):
            continue
        score, _, left, r = min((1000 * a * total[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k,
                                 f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((" ".join(g), a, left, r, total[lang], score))
    got = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        got += [(lang, i, *x) for i, x in enumerate(found[:top], 1)]
    return sorted(got)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


CASES = [
    (1, "New York is big. New York, new  york; NEW\tYORK is big!", "en"),
    (1, "New York is big. New York, new  york; NEW\tYORK is big!", "en"),   # a repeated row
    (2, None, "en"), (3, "", "en"), (4, " .\n;", None), (None, "a b a b a b a b", None),
    (5, "a b a b a b\na b c d e f g a b c d e f g", "und"), (6, "éß éß Éß éß \x1c x éß éß", "de"),
    (7, "one two three four five six " * 4, "en"), (8, "word", ""), (9, "x y x y x y x y", ""),
    (10, "lorem ipsum dolor " * 3000, "la"),
]


@pytest.mark.parametrize("fraction", [4])
def test_equal_to_counting_everything(spark, fraction):
    docs = spark.createDataFrame(CASES, SCHEMA)
    got = collocations(docs, least=3, fraction=fraction)
    assert rows_of(got) == brute(CASES, 3)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_texts_of_the_table(spark):
    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert rows_of(collocations(docs, least=8)) == brute(rows, 8)
    # one rank a language, ties by phrase
    assert rows_of(collocations(docs, least=8, top=5)) == brute(rows, 8, top=5)


def test_border_failures_lead_to_further_passes(spark):
    """Phrases that live outside the sample are found by expanding the border,
    one word a pass at most, until no failure is left."""
    docs = spark.createDataFrame([(i, "p q r s t", "en") for i in range(40)], SCHEMA)
    inside = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1000)) == 0
    assert docs.where(inside).isEmpty()
    passes = []
    found = frequent_phrases(docs, least=20, fraction=1000, passes=passes)
    assert {(r.h2 & 7, r.n) for r in found.collect()} == {(k, 40) for k in range(1, 6)}
    assert found.count() == 15 and passes == [5, 4, 3, 2, 0]
    # a full sample proposes everything: one pass, no failure
    passes = []
    assert frequent_phrases(docs, least=20, fraction=1, passes=passes).count() == 15
    assert passes == [0]


def test_a_full_bitmap_only_costs_work(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    assert rows_of(collocations(docs, least=3, bits=6)) == brute(CASES, 3)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b a b a b", "en", 9, "x", 1, 2)],
                                 SCHEMA + ", n int, phrase string, h1 int, level int")
    assert rows_of(collocations(docs, least=3)) == brute([(1, "a b a b a b", "en")], 3)
    assert collocations(docs.limit(0), least=3).collect() == []


def test_lowered_threshold():
    assert lowered(100, 4) == 10
    assert lowered(100, 1000) == 2


def test_products_beyond_64_bits(spark):
    """The scoring expression on counts of a very large corpus."""
    a, n, left, r = 4 * 10 ** 11, 9 * 10 ** 12, 7 * 10 ** 11, 5 * 10 ** 11 + 1
    df = spark.range(1).select(F.expr(
        f"(cast(1000 as decimal(4,0)) * cast({a} as decimal(15,0)) * cast({n} as decimal(16,0))) div "
        f"(cast({left} as decimal(19,0)) * cast({r} as decimal(19,0)))").alias("s"))
    assert df.first().s == 1000 * a * n // (left * r)


def test_smallest_sizes_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert collocations(docs, least=10 ** 9).collect() == []
