import random
import tracemalloc
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cobi.llm import packing
from cobi.llm.packing import best_fit, complete, lower_bound, pack, plan, query, undominated
from tests.conftest import SF_SMALL, table


@lru_cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(out, docs, size):
    """Every piece of every document, gapless sequences; returns their number."""
    want = defaultdict(int)
    for i, t in docs:
        ids = tokenizer().encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), size):
            part = np.array(ids[k:k + size], dtype="<u4")
            want[i, k // size, k, len(part), zlib.crc32(part.tobytes())] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in out:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(k[3] * n for k, n in want.items())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    n, total = check(query(spark, SF_SMALL).collect(), docs, 4096)
    assert n <= -(-total // 4096) + 1


def test_edge_rows(spark):
    texts = [None, "", " \n ", "It's 3.14!! don't", "<|endoftext|> x<|ENDOFTEXT|>", "Ünïcode é 　 日本語 ½",
             "w " * 5000, "a" * 3000, "same text", "same text"]
    rows = [(None if k == 3 else k, t, k) for k, t in enumerate(texts)] + [(8, "same text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    check(pack(docs, size=64).collect(), [(a, b) for a, b, _ in rows], 64)
    ids = {r.doc_id: r.ids for r in pack(docs, size=4096, with_ids=True).where("piece = 0").collect()}
    assert np.frombuffer(ids[5], "<u4").tolist() == tokenizer().encode(texts[5], add_special_tokens=False).ids + [1]
    assert pack(docs.limit(0)).count() == 0


def weight(fillings):
    out = defaultdict(int)
    for f, m in fillings:
        for a, k in f:
            out[a] += k * m
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plans(seed):
    rng = random.Random(seed)
    size = 100
    counts = np.zeros(size + 1, dtype=np.int64)
    for _ in range(rng.choice([5, 12, 60, 400, 3000])):
        counts[rng.randint(1, size if seed % 2 else 40)] += 1
    total = int((counts * np.arange(size + 1)).sum())
    for made in (plan(counts, size), best_fit(counts, size)):
        assert all(sum(a * k for a, k in f) <= size for f, _ in made)
        assert weight(made) == {a: int(counts[a]) for a in np.flatnonzero(counts)}
    n = sum(m for _, m in plan(counts, size))
    assert -(-total // size) <= n <= sum(m for _, m in best_fit(counts, size))


def test_branch_and_bound_beats_best_fit():
    # known case: best fit decreasing needs 4 bins, the optimum is 3
    counts = np.zeros(11, dtype=np.int64)
    for a in (6, 5, 5, 4, 3, 2, 2, 3):
        counts[a] += 1
    made, low, proven = complete(counts, 10)
    assert sum(m for _, m in made) == 3 == low and proven


def optimum(lengths, size):
    """By trying every place of every piece, largest first."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                after = list(rooms)
                after.remove(r)
                place(i + 1, [*after, r - lengths[i]])
        place(i + 1, [*rooms, size - lengths[i]])
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_small_cases_are_solved_to_the_optimum(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 20, 50, 100])
    lengths = [rng.randint(1 + size // rng.choice([3, 6, 20]), max(2, size * 2 // 3)) for _ in range(rng.randint(1, 13))]
    counts = np.bincount(lengths, minlength=size + 1)
    made, low, proven = complete(counts, size)
    n = sum(m for _, m in made)
    assert weight(made) == {a: int(counts[a]) for a in np.flatnonzero(counts)}
    assert all(sum(a * k for a, k in f) <= size for f, _ in made)
    assert n == optimum(lengths, size) and low <= n and proven


@pytest.mark.parametrize("pieces", [2_000, 300_000])
def test_large_histograms_reach_the_lower_bound(pieces):
    """Document lengths with a long tail: the whole histogram is searched, and the
    plan is proven or stands next to the bound."""
    rng = np.random.default_rng(pieces)
    lengths = np.minimum(rng.lognormal(6.3, 0.9, pieces).astype(int) + 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    made, low, _ = complete(counts, 4096, nodes=300)
    assert weight(made) == {a: int(counts[a]) for a in np.flatnonzero(counts)}
    assert sum(m for _, m in made) - low <= 1 + pieces // 100_000


def test_undominated_fillings_equal_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        counts = np.zeros(41, dtype=np.int64)
        for _ in range(rng.randint(0, 9)):
            counts[rng.randint(3, 40)] += 1
        room = rng.randint(0, 40)
        found = [tuple(f) for f in undominated(counts, room)]
        sums = {0}
        for a in range(41):
            for _ in range(counts[a]):
                sums |= {s + a for s in sums if s + a <= room}
        assert [sum(f) for f in found] == sorted(map(sum, found), reverse=True)
        assert len(set(found)) == len(found)
        assert sum(found[0]) == max(sums)      # the fullest comes first
        for f in found:
            left = counts.copy()
            for a in f:
                left[a] -= 1
            assert (left >= 0).all() and not left[:room - sum(f) + 1].any()


def test_lower_bound():
    counts = np.bincount([60] * 10 + [41] * 10, minlength=101)
    assert lower_bound(counts, 100) == 15      # no 41 fits beside a 60; two beside each other
    assert lower_bound(np.bincount([50] * 4, minlength=101), 100) == 2
    assert lower_bound(np.zeros(101, dtype=np.int64), 100) == 0


def test_search_holds_few_levels(monkeypatch):
    # a level's sums take size * lengths / 8 bytes, and there are as many levels as lengths
    rng = np.random.default_rng(3)
    size = 512
    lengths = np.minimum(size, np.exp(rng.normal(4.0, 1.0, 30000)).astype(int) + 1)
    counts = np.bincount(lengths, minlength=size + 1)
    monkeypatch.setattr(packing, "best_fit", lambda c, s: [(((1, 1),), int(c.sum()))])  # so that it searches
    tracemalloc.start()
    held = complete(counts, size, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6
    monkeypatch.setattr(packing, "LIVE", 10 ** 9)
    assert complete(counts, size, 0) == held


@pytest.mark.parametrize("seed", range(6))
def test_levels_made_again_go_on_where_they_were(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 60, 40), minlength=61)
    monkeypatch.setattr(packing, "best_fit", lambda c, s: [(((1, 1),), int(c.sum()))])
    monkeypatch.setattr(packing, "lower_bound", lambda c, s: 0)  # so that it goes back
    monkeypatch.setattr(packing, "LIVE", 10 ** 9)
    want = complete(counts, 60, 3000)
    monkeypatch.setattr(packing, "LIVE", 1)
    assert complete(counts, 60, 3000) == want
