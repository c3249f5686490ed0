import random
import re
from collections import defaultdict

from cobi.llm import verify
from cobi.llm.minmax_dedup import near_duplicates, query
from tests.conftest import SF_SMALL, table


def brute(pairs, percent=85, size=5):
    """Components by counting shared shingles of every pair that shares one."""
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else (
            {tuple(w)} if w else set())
    index, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for ids in index.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    want = brute([(r.doc_id, r.text) for r in table(spark, "documents").collect()])
    df = query(spark, SF_SMALL)
    assert got(df) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_large_group_in_small_blocks(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert got(near_duplicates(docs, block=8)) == want
    assert len({c for _, c in want.values()}) > 1


def test_family_in_many_bands_is_cut_up_once(spark, monkeypatch):
    """Near copies that mostly do not link meet in most bands: each is in tiles
    with all others once, not once a band."""
    rng, base, rows = random.Random(5), [f"w{k}" for k in range(150)], []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([2, 2, 2, 3])):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[9 * i][1] + " end") for i in range(10)]
    dealt, seen = verify._dealt, []

    def look(places):
        if "buckets" in places.columns:
            seen.append(places.count())
        return dealt(places)

    monkeypatch.setattr(verify, "_dealt", look)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert got(near_duplicates(docs, block=16)) == want
    assert 20 < len({c for _, c in want.values()}) < 160
    # 170 rows in 11 blocks, and the buckets that stay beside them
    assert seen and sum(seen) < 4 * 170 * 11


def test_buckets_of_a_hub_are_one_only_where_that_is_less(spark):
    """Of large buckets with one common member, and of such with mostly the same ones."""
    apart = [(b, n, b == 1, 4, n) for b in (1, 2, 3) for n in [0, *range(100 * b, 100 * b + 9)]]
    same = [(b, n, n == 1004 + b, 4, n) for b in (11, 12, 13) for n in range(1000, 1020) if n % 10 != b - 10]
    small = [(21, n, True, 4, n) for n in (0, 1000, 5)]
    left = spark.createDataFrame([*apart, *same, *small],
                                 "bucket long, node long, own boolean, n long, component long")
    out = verify._merged(left, 8, 10 ** 6).collect()
    kept = [tuple(r) for r in out if r.bucket < 100 and r.bucket > 0]
    assert sorted(kept) == sorted([*apart, *small])
    whole = [r for r in out if (r.bucket, r.node, r.own, r.n, r.component) not in kept]
    assert len({r.bucket for r in whole}) == 1
    assert sorted((r.node, r.own, r.n, r.component) for r in whole) == [
        (n, 1015 <= n <= 1017, 4, n) for n in range(1000, 1020)]


def test_edge_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \t\n", "c", 3), (4, "one two", "d", 4), (5, "ONE  two", None, 5),
            (6, "one", "e", 6), (None, "one two", "f", 7), (8, "q " * 3000, "g", 8), (9, "q " * 5, "h", 9),
            (10, "one two", "x", None), (10, "one two", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, rep long")
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()]
    assert sorted(out, key=str) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
        (None, 1, None, True), (8, 1, 8, True), (9, 1, 8, False), (10, 1, 4, False), (10, 1, 4, False)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


def test_near_copies_of_each_text_of_one_id(spark):
    long, short = [f"a{k}" for k in range(80)], [f"b{k}" for k in range(60)]
    rows = [(1, " ".join(long)), (1, " ".join(short)), (1, " ".join(short)), (2, " ".join([*short[:-1], "x"])),
            (3, " ".join([*long[:-1], "x"])), (4, "one two"), (5, " ".join([*short[:20], *long[:20]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == [
        (1, 56, 1, True), (1, 56, 1, True), (1, 76, 1, True), (2, 56, 1, False), (3, 76, 1, False), (4, 1, 4, True),
        (5, 36, 5, True)]
