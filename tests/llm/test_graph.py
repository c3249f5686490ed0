import random

from cobi.llm import graph, verify
from cobi.llm.graph import components


def written(monkeypatch, *modules):
    names = []
    for m in modules:
        def look(df, name, saved=m.saved):
            names.append(name)
            return saved(df, name)
        monkeypatch.setattr(m, "saved", look)
    return names


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for u, v in edges:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(199, 150 + i) for i in range(40)]
    edges += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(50)] + [(120, 170), (400, 400), (402, 401)]
    edges = [(-u, -v) if rng.random() < .3 and u > 300 else (u, v) for u, v in edges] + edges[:9] + [(v, u) for u, v in edges[:9]]
    out = components(spark.createDataFrame(edges, "u long, v long").repartition(3), "test").collect()
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in out} == want and len(out) == len(want)
    assert components(spark.createDataFrame([], "u long, v long"), "test").collect() == []


def test_stars_take_one_look(spark, monkeypatch):
    """Stars are seen as done from one table of smallest neighbours, without a round."""
    names = written(monkeypatch, graph)
    edges = [(10 * k, 10 * k + i) for k in range(5) for i in range(1, 9)]
    out = components(spark.createDataFrame([*edges, *((v, u) for u, v in edges)], "u long, v long"), "test").collect()
    assert {(r.node, r.component) for r in out} == {(x, x // 10 * 10) for e in edges for x in e}
    assert names == ["test", "stars"]


def test_centres_of_all_rounds_in_one_pass(spark, monkeypatch):
    """Each centre meets the rest of its bucket and the later centres; three tables are written, whatever the rounds."""
    names = written(monkeypatch, verify)
    rows = [(1, i, i != 0, 9, 0) for i in range(6)] + [(2, i, True, 9, 0) for i in (3, 7)] + [(3, i, False, 9, 0) for i in (1, 2)]
    rows += [(4, 20, True, 9, 0), (4, 21, True, 99, 0), (4, 22, True, 9, 8)]
    buckets = spark.createDataFrame(rows, "bucket long, node long, own boolean, n long, pos long")
    pairs, rest = verify._star_pairs(buckets, 80, 3)
    assert sorted((r.centre, r.node, r.n, r.m) for r in pairs.collect()) == [
        (1, 0, 9, 9), (1, 2, 9, 9), (1, 3, 9, 9), (1, 4, 9, 9), (1, 5, 9, 9), (2, 0, 9, 9), (2, 3, 9, 9), (2, 4, 9, 9),
        (2, 5, 9, 9), (3, 0, 9, 9), (3, 4, 9, 9), (3, 5, 9, 9), (3, 7, 9, 9)]
    assert sorted((r.bucket, r.node) for r in rest.collect()) == [(1, 0), (1, 4), (1, 5)]
    assert names == ["centres", "around", "pairs"]
