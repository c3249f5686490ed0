"""MAT4-MAT8: the DataFrame Krylov engine against dense NumPy and MLlib,
discard modes, the salted (non-broadcast) path, rank deficiency, and the
planted-block fixture with exact labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobi.operators.edges import edges_from_pairs
from cobi.operators.spectral import (RankOneGraph, _grams, edge_graphs, normalized_graph, spectral_embedding,
                                     spectral_embeddings)
from cobi.plans.runs import cluster_bipartite
from tests.conftest import SF_MID, table
from tests.mllib_engine import mllib_embedding


def dense(edges):
    pdf = edges.toPandas()
    rows = sorted(pdf.first_field.unique())
    cols = sorted(pdf.second_field.unique())
    ri = {v: i for i, v in enumerate(rows)}
    ci = {v: i for i, v in enumerate(cols)}
    a = np.zeros((len(rows), len(cols)))
    for f, p, w in pdf.itertuples(index=False):
        a[ri[f], ci[p]] += w
    d1, d2 = a.sum(1), a.sum(0)
    an = a / np.sqrt(np.outer(d1, d2))
    return an, rows, cols, d1, d2


@pytest.fixture(scope="module")
def small_graph(spark):
    return edges_from_pairs(table(spark, "lineitem"), "l_partkey", "l_suppkey").persist()


def test_singular_values_match_numpy(spark, small_graph):
    an, *_ = dense(small_graph)
    s = np.linalg.svd(an, compute_uv=False)
    res = spectral_embedding(small_graph, k=5)
    assert res.width == 3
    np.testing.assert_allclose(res.sigma, s[1:4], rtol=1e-6)
    none = spectral_embedding(small_graph, k=5, discard="none")
    np.testing.assert_allclose(none.sigma, s[:4], rtol=1e-6)
    last = spectral_embedding(small_graph, k=5, discard="last")
    np.testing.assert_allclose(last.sigma, s[:3], rtol=1e-6)
    first = spectral_embedding(small_graph, k=5, discard="first")
    np.testing.assert_allclose(first.sigma, s[1:4], rtol=1e-6)


def test_embedding_projector_matches_numpy(spark, small_graph):
    an, rows, cols, d1, d2 = dense(small_graph)
    u, s, vt = np.linalg.svd(an)
    res = spectral_embedding(small_graph, k=5)
    emb = {(r.side, r.node): r.embedding for r in res.embedding.collect()}
    z = np.array([emb[("row", v)] for v in rows])
    want = u[:, 1:4] / np.sqrt(d1)[:, None]
    # signs and rotations are free: compare projectors (in the d-weighted metric)
    pz = (z * np.sqrt(d1)[:, None])
    pw = (want * np.sqrt(d1)[:, None])
    np.testing.assert_allclose(pz @ pz.T, pw @ pw.T, atol=1e-6)


def test_salted_path_equals_broadcast_path(spark, small_graph):
    a = spectral_embedding(small_graph, k=5)
    b = spectral_embedding(small_graph, k=5, broadcast_bytes=0, min_hot_rows=1)
    np.testing.assert_allclose(a.sigma, b.sigma, rtol=1e-9)


def test_mllib_cross_check(spark, small_graph):
    s_ml, _ = mllib_embedding(small_graph, k=5)
    res = spectral_embedding(small_graph, k=5, discard="none")
    np.testing.assert_allclose(s_ml, res.sigma, rtol=1e-5)


def test_converged_at_defaults_on_a_flat_spectrum(spark):
    """part x supplier is near random: its singular values lie close together,
    and the wanted ones must be right all the same."""
    edges = edges_from_pairs(table(spark, "lineitem", SF_MID), "l_partkey", "l_suppkey")
    an, rows, cols, d1, d2 = dense(edges)
    u, s, vt = np.linalg.svd(an, full_matrices=False)
    res = spectral_embedding(edges, k=5)
    assert res.converged and max(res.residuals) <= 1e-5
    np.testing.assert_allclose(res.sigma, s[1:4], atol=1e-8)
    emb = {r.node: r.embedding for r in res.embedding.filter("side = 'row'").collect()}
    z = np.array([emb[v] for v in rows]) * np.sqrt(d1)[:, None]
    cosines = np.linalg.svd(z.T @ u[:, 1:4], compute_uv=False)
    np.testing.assert_allclose(cosines, 1, atol=1e-4)


def test_stopping_early_is_an_error_or_flagged(spark, small_graph):
    with pytest.raises(RuntimeError, match="not converged"):
        spectral_embedding(small_graph, k=5, max_iter=1)
    res = spectral_embedding(small_graph, k=5, max_iter=1, require_converged=False)
    assert not res.converged and max(res.residuals) > 1e-5


def test_small_singular_values_are_kept(spark):
    """Two blocks, each a star plus one weak independent direction: the rank is
    judged on sigma, so 1e-4 of the largest still counts."""
    e = []
    for b in "ab":
        for i in range(3):
            for j in range(3):
                e.append((f"{b}r{i}", f"{b}c{j}", 1.0 + (3e-4 if i == j else 0.0)))
    e = spark.createDataFrame(e, "first_field string, second_field string, weight double")
    an, *_ = dense(e)
    s = np.linalg.svd(an, compute_uv=False)
    res = spectral_embedding(e, k=8, width=4)
    assert s[2] < 2e-4 and res.width == 3
    np.testing.assert_allclose(res.sigma, s[1:4], atol=1e-9)


def test_rank_one_graph(spark):
    e = spark.createDataFrame([(f"r{i}", f"c{j}", 2.0) for i in range(4) for j in range(3)],
                              "first_field string, second_field string, weight double")
    with pytest.raises(RankOneGraph):
        spectral_embedding(e, k=3)


def test_rank_deficient_graph_returns_fewer_vectors(spark):
    e = spark.createDataFrame(
        [(f"a{i}", f"x{j}", 1.0) for i in range(4) for j in range(3)]
        + [(f"b{i}", f"y{j}", 1.0) for i in range(3) for j in range(5)],
        "first_field string, second_field string, weight double")
    res = spectral_embedding(e, k=8)
    assert res.width == 1
    assert abs(res.sigma[0] - 1.0) < 1e-9


def test_planted_blocks_exact_labels(spark):
    li = table(spark, "lineitem").filter("l_suppkey % 4 = l_partkey % 4")
    edges = edges_from_pairs(li, "l_partkey", "l_suppkey")
    c = cluster_bipartite(edges, 4, runs=3, width=4)
    got = c.labels.withColumn("block", F.col("node").cast("long") % 4)
    mapping = got.groupBy("block").agg(F.countDistinct("cluster_no").alias("n"),
                                       F.min("cluster_no").alias("c")).collect()
    assert all(r.n == 1 for r in mapping)
    assert len({r.c for r in mapping}) == 4


def test_hot_node_salted_path(spark):
    """One column node holds a third of all edges: the non-broadcast path
    salts it over several buckets and must give the broadcast result."""
    import random
    rnd = random.Random(3)
    edges = [(f"r{i}", "hot", 1.0) for i in range(300)]
    edges += [(f"r{i}", f"c{rnd.randint(0, 40)}", float(rnd.randint(1, 3)))
              for i in range(300) for _ in range(2)]
    e = (spark.createDataFrame(edges, "first_field string, second_field string, weight double")
         .groupBy("first_field", "second_field").agg(F.sum("weight").alias("weight")))
    from cobi.operators.skew import hot_keys
    g = normalized_graph(e)
    hot = g.nodes.filter("node = 'hot'").first().id
    assert [k for k, _ in hot_keys(g.edges, "c", 10)] == [hot]
    a = spectral_embedding(e, k=5, graph=g)
    b = spectral_embedding(e, k=5, broadcast_bytes=0, min_hot_rows=10, graph=g)
    np.testing.assert_allclose(a.sigma, b.sigma, rtol=1e-9)
    za = {(r.side, r.node): r.embedding for r in a.embedding.collect()}
    zb = {(r.side, r.node): r.embedding for r in b.embedding.collect()}
    assert za.keys() == zb.keys()
    keys = sorted(za)
    a, b = np.array([za[k] for k in keys]), np.array([zb[k] for k in keys])
    np.testing.assert_allclose(a * np.sign((a * b).sum(0)), b, atol=1e-6)   # signs are free


def test_flipped_path_matches_numpy(spark, small_graph):
    """Fewer row nodes than column nodes: the engine iterates on the
    transposed graph and must hand back the same sides."""
    from cobi.operators.matrix import transpose
    t = transpose(small_graph)
    an, rows, cols, d1, d2 = dense(t)
    assert len(rows) < len(cols)
    u, s, vt = np.linalg.svd(an)
    res = spectral_embedding(t, k=5)
    np.testing.assert_allclose(res.sigma, s[1:4], rtol=1e-6)
    emb = {(r.side, r.node): r.embedding for r in res.embedding.collect()}
    assert {k[1] for k in emb if k[0] == "row"} == set(rows)
    z = np.array([emb[("row", v)] for v in rows]) * np.sqrt(d1)[:, None]
    w = u[:, 1:4]
    np.testing.assert_allclose(z @ z.T, w @ w.T, atol=1e-6)


def test_discard_last_keeps_the_trivial_vector(spark, small_graph):
    """Q1: the reference's code drops the *last* of r triplets; at k=2 (r=2)
    what is left is the trivial vector, constant 1/sqrt(total) after scaling."""
    total = small_graph.agg(F.sum("weight")).first()[0]
    res = spectral_embedding(small_graph, k=2, discard="last")
    assert res.width == 1 and abs(res.sigma[0] - 1.0) < 1e-9
    z = [abs(r.embedding[0]) for r in res.embedding.collect()]
    np.testing.assert_allclose(z, 1 / np.sqrt(total), rtol=1e-6)
    trivial = spectral_embedding(small_graph, k=2)
    assert trivial.width == 1 and trivial.sigma[0] < 1.0 - 1e-6


def test_mllib_engine_matches_dataframe_engine(spark, small_graph):
    """MLlib with discard='last' spans the same embedding as the DataFrame
    engine with the same discard rule (compare projectors)."""
    sigma, embedding = mllib_embedding(small_graph, k=5, discard="last")
    df = spectral_embedding(small_graph, k=5, discard="last")
    np.testing.assert_allclose(sigma, df.sigma, rtol=1e-5)
    a = {(r.side, r.node): r.embedding for r in embedding.collect()}
    b = {(r.side, r.node): r.embedding for r in df.embedding.collect()}
    assert a.keys() == b.keys()
    keys = sorted(k for k in a if k[0] == "row")
    za, zb = np.array([a[k] for k in keys]), np.array([b[k] for k in keys])
    np.testing.assert_allclose(za @ np.linalg.pinv(za) @ zb, zb, atol=1e-6)


def jobs(spark, run):
    """Number of Spark jobs of a call."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    before = len(sc.statusTracker().getJobIdsForGroup("counted"))
    run()
    n = len(sc.statusTracker().getJobIdsForGroup("counted")) - before
    sc.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_gram_matrices_are_one_job_whatever_the_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 7))
    rows = [(i % 3, i, float(r[0]), r[1:4].tolist(), r[4:].tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "pair int, id long, t double, k array<double>, z array<double>")
    spark.conf.set("spark.sql.shuffle.partitions", "64")     # merged in several tasks
    try:
        got, counts = {}, set()
        for n in (1, 40):
            part = df.repartition(n).persist()
            part.count()
            counts.add(jobs(spark, lambda: got.update(_grams(part))))    # noqa: B023
            part.unpersist()
            for p in range(3):
                np.testing.assert_allclose(got[p], x[p::3].T @ x[p::3], atol=1e-9)
        assert len(counts) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_graphs_together_equal_graphs_alone(spark):
    """Graphs of different shapes in one iteration, one of them of rank one; the
    number of jobs is that of the slowest graph."""
    rng = np.random.default_rng(2)
    shapes = [(30, 12), (9, 40), (25, 25), (3, 4), (4, 3)]
    edges = []
    for p, (m, n) in enumerate(shapes):
        for i in range(m):
            for j in range(n):
                w = 1.0 if p == 4 else float(rng.integers(0, 4) * (rng.random() < 0.6))
                if w or i == j or i % n == j or j % m == i:
                    edges.append((p, f"r{i}", f"c{j}", w or 1.0))
    df = spark.createDataFrame(edges, "pair int, first_field string, second_field string, weight double")
    emb, found = spectral_embeddings(edge_graphs(df), 5)
    assert sorted(found) == [0, 1, 2, 3]                     # 4 has rank one
    vectors = {}
    for r in emb.collect():
        vectors.setdefault(r.pair, {})[r.side, r.node] = r.embedding
    for p in found:
        an, rows, cols, d1, _ = dense(df.where(f"pair = {p}").drop("pair"))
        u, s, _ = np.linalg.svd(an)
        assert found[p].converged
        np.testing.assert_allclose(found[p].sigma, s[1:1 + found[p].width], atol=1e-7)
        z = np.array([vectors[p]["row", v] for v in rows]) * np.sqrt(d1)[:, None]
        w = u[:, 1:1 + found[p].width]
        np.testing.assert_allclose(np.linalg.svd(z.T @ w, compute_uv=False), 1, atol=1e-4)
    alone = max(jobs(spark, lambda: spectral_embeddings(edge_graphs(df.where(f"pair = {p}")), 5))   # noqa: B023
                for p in found)
    assert jobs(spark, lambda: spectral_embeddings(edge_graphs(df), 5)) <= alone + 6


def test_packed_pass_is_both_half_steps(spark, monkeypatch):
    """Pieces of whole row nodes give An and An^T An, and one pass shuffles no row nodes."""
    from cobi.operators import spectral
    monkeypatch.setattr(spectral, "PIECE_EDGES", 7)
    rng = np.random.default_rng(5)
    rows = [(p, f"a{i}", f"b{j}", float(rng.integers(1, 9))) for p, m, n in ((0, 30, 6), (1, 5, 20), (2, 4, 4))
            for i in range(m) for j in range(n) if (i + j) % 3 or i == j]
    g = spectral.edge_graphs(spark.createDataFrame(rows, "pair int, first_field string, second_field string, weight double"))
    block = g.nodes.where("small").select("id", (F.xxhash64("id") % 100 / 10.0).alias("f0"), F.col("t").alias("f1"))
    for active in ([0, 1, 2], [1]):
        own = block.join(g.nodes.where(F.col("pair").isin(active)).select("id"), "id")
        step = dict(broadcast_bytes=64 << 20, min_hot_rows=100_000)
        plain = dict(broadcast_bytes=0, min_hot_rows=100_000)
        big = {r.id: (r.f0, r.f1) for r in g.half(own, False, 2, active, **plain).collect()}
        got = {r.id: (r.f0, r.f1) for r in g.half(own, False, 2, active, **step).collect()}
        assert got.keys() == big.keys() and all(np.allclose(got[i], big[i]) for i in big)
        small = {r.id: (r.f0, r.f1) for r in g.normal(own, 2, active, **plain).collect()}
        fused = g.normal(own, 2, active, **step)
        got = {r.id: (r.f0, r.f1) for r in fused.collect()}
        assert got.keys() == small.keys() and all(np.allclose(got[i], small[i]) for i in small)
        assert fused._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    g.release()


def test_packing_is_one_shuffle_without_joins(spark, monkeypatch):
    """One shuffle by row node numbers, sums, normalises and packs; nodes and ids are
    whole and the same when the pieces are made again, and no edge is joined."""
    from cobi.operators import spectral
    monkeypatch.setattr(spectral, "PIECE_EDGES", 16)
    monkeypatch.setattr(spectral, "PACK_EDGES", 40)
    monkeypatch.setattr(spectral, "SLICE", 4)
    rng = np.random.default_rng(8)
    rows = [(p, f"x{rng.integers(m)}", f"x{rng.integers(n)}", float(rng.integers(1, 9)))      # edges may repeat
            for p, m, n in ((0, 60, 9), (3, 7, 50), (5, 20, 20)) for _ in range(400)]
    df = spark.createDataFrame(rows, "pair int, first_field string, second_field string, weight double")
    g = edge_graphs(df)
    plan = g.pieces._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Sort " not in plan and "Window" not in plan
    want = {}
    for p, f, s, w in rows:
        for key in ((p, "row", f), (p, "column", s)):
            want[key] = want.get(key, 0.0) + w
    nodes = g.nodes.collect()
    assert {(r.pair, r.side, r.node): r.d for r in nodes} == want and len({r.id for r in nodes}) == len(nodes) == len(want)
    assert [g.sizes[p].m for p in (0, 3)] == [len([k for k in want if k[0] == p and k[1] == "row"]) for p in (0, 3)]
    ids = {(r.pair, r.node): r.id for r in nodes if not r.small}
    emb, found = spectral_embeddings(g, 5)
    assert g._edges is None and not g.pieces.is_cached
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        again = g.pieces.select("pair", F.inline("nodes")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.pair, r.node): r.id for r in again} == ids
    vectors = {(r.pair, r.side, r.node): r.embedding for r in emb.collect()}
    assert vectors.keys() == want.keys()
    for p in found:
        an, names, _, d1, _ = dense(df.where(f"pair = {p}").drop("pair"))
        u, s, _ = np.linalg.svd(an)
        np.testing.assert_allclose(found[p].sigma, s[1:4], atol=1e-7)
        z = np.array([vectors[p, "row", v] for v in names]) * np.sqrt(d1)[:, None]
        np.testing.assert_allclose(np.linalg.svd(z.T @ u[:, 1:4], compute_uv=False), 1, atol=1e-4)


def test_large_smaller_sides_are_not_sent_to_tasks(spark, small_graph, monkeypatch):
    """Beyond ``PACK_BYTES`` the nodes are numbered by grouping and the steps shuffle edges."""
    from cobi.operators import spectral
    want = spectral_embedding(small_graph, k=5)
    monkeypatch.setattr(spectral, "PACK_BYTES", 0)
    g = normalized_graph(small_graph)
    res = spectral_embedding(None, k=5, graph=g)
    assert g.pieces is None and g.order is None
    np.testing.assert_allclose(res.sigma, want.sigma, rtol=1e-9)
    assert res.embedding.count() == want.embedding.count()
