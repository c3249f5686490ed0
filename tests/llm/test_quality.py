import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cobi.llm import quality
from cobi.llm.quality import fit, kth_largest, query, resample, select_quality
from tests.conftest import table

SF = "/root/testdata/sf0.1"


def test_features_equal_brute_force():
    rng = random.Random(2)
    texts = ["", "The the THE cat!! | sat", "É é 12ab ... x", "A B", "AB CD ab"] + [
        " ".join(rng.choice(["aa", "Bb", "CC!", "##", "longword"]) for _ in range(30)) for _ in range(5)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    doc, bucket = quality.features(data, offsets)
    for d, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        symbols = set(re.findall(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]+", low))
        heads = {w.encode()[:5] for w in ws}
        assert (doc == d).sum() == len(set(ws)) + len(heads) + len(symbols) + 3


def test_ratios_equal_the_formula(spark):
    good = [(k, "plain words here " + "xyz"[k % 3], 1, 0) for k in range(200)]
    bad = [(1000 + k, "junkword plain", 0, 0) for k in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in good + bad], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in good + bad], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    expected = 100 * 200 / 300
    one = math.log(1 / (expected + 1))
    assert len(model.ratios) == 2 and np.allclose(model.ratios, one)   # the word and its first bytes
    out = {r.doc_id: r for r in resample(docs, model)[0].collect()}
    assert all(out[i].log_weight == pytest.approx(2 * one) and not out[i].accepted for i, *_ in bad)
    assert all(out[i].log_weight == 0 and out[i].accepted for i, *_ in good)
    kept = select_quality(docs.selectExpr("*", "1 key"), labels)
    assert kept.columns == ["doc_id", "text", "key"] and {r.doc_id for r in kept.collect()} == set(range(200))


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 5) for _ in range(3000)] + [1.0] * 500 + [-1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    order = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 3000, 3502):
        assert kth_largest(df, "x", k, most=50) == order[k - 1]


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (3, "same", "d"), (3, "same", "d"), (4, "w " * 50000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, accepted string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for rated in (labels, labels.limit(0)):
        out = resample(docs, fit(docs, rated))[0].collect()
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        assert select_quality(docs, rated).count() == 6
    assert resample(docs.limit(0), fit(docs.limit(0), labels))[0].count() == 0
    assert query(spark, "/root/testdata/sf0.001").count() == table(spark, "documents").count()


def test_toxic_words_too_rare_for_a_shortfall(spark):
    docs, rows = [], []
    for i in range(600):
        toxic = i % 60 == 0     # ten in 600: the target expects nine or ten
        docs.append((i, f"plain words here {'abc'[i % 3]}" + " slur" * toxic))
        if i < 540:
            rows.append((i, 1, int(toxic)))
    rows += [(i, 1, 1) for i in range(1000, 1040)]
    docs += [(i, "plain words here a insult") for i in range(1000, 1040)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.accepted for r in resample(docs, fit(docs, labels))[0].collect()}
    # also the one without a label (540)
    assert {i for i, ok in out.items() if not ok} == {*range(0, 600, 60), *range(1000, 1040)}


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_held_out_toxic_documents_go(spark, seed):
    docs, labels = table(spark, "documents", SF), table(spark, "labels", SF)
    train, test = labels.randomSplit([0.7, 0.3], seed)
    got = {r.doc_id: r.accepted for r in resample(docs, fit(docs, train))[0].collect()}
    kept = lambda rows: (lambda x: sum(x) / len(x))([got[r.doc_id] for r in test.where(rows).collect()])
    rates = {"good": kept("quality = 1 and toxic = 0"), "junk": kept("quality = 0"), "toxic": kept("toxic = 1")}
    assert rates["good"] > 0.99 and rates["junk"] < 0.05 and rates["toxic"] < 0.2, rates
