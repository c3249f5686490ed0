"""E2E2: the factorised record graph equals the brute-force record pairs."""

from collections import Counter

from cobi.operators.records import build_record_graph, filtered_count, record_graph_size
from tests.conftest import table


def test_record_graph_matches_pairs(spark):
    c, s = table(spark, "customer"), table(spark, "supplier")
    g = build_record_graph(c, s, "c_nationkey", "s_nationkey", ["c_custkey"], ["s_suppkey"])
    cust = sorted((r.c_custkey, r.c_nationkey) for r in c.collect() if r.c_nationkey > 0)
    supp = sorted((r.s_suppkey, r.s_nationkey) for r in s.collect() if r.s_nationkey > 0)
    a_nodes = {f"{i}_{v}": v for i, (_, v) in enumerate(cust)}
    b_nodes = {f"{i}_{v}": v for i, (_, v) in enumerate(supp)}
    pairs = [(na, nb) for na, va in a_nodes.items() for nb, vb in b_nodes.items() if va == vb]
    deg_a, deg_b = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
    got = {(r.side, r.node): r.degree for r in g.nodes().collect()}
    want = {("row", n): float(d) for n, d in deg_a.items()}
    want.update({("column", n): float(d) for n, d in deg_b.items()})
    assert got == want
    size = record_graph_size(g).first()
    assert size.n_edges == len(pairs)
    assert size.n_rows == len(deg_a) and size.n_cols == len(deg_b)


def test_record_graph_with_a_hot_value(spark):
    """A value held by most records; blocks come from counts alone."""
    a = spark.createDataFrame([(i, 1 if i % 10 else 2) for i in range(1, 301)], "ka long, v long")
    b = spark.createDataFrame([(i, 1 if i % 3 else 2) for i in range(1, 31)], "kb long, v long")
    g = build_record_graph(a, b, "v", "v", ["ka"], ["kb"])
    assert record_graph_size(g).first().n_edges == 270 * 20 + 30 * 10
    assert "rangepartitioning" not in g.blocks._jdf.queryExecution().executedPlan().toString()
    degrees = Counter((r.side, r.value, r.degree) for r in g.nodes().collect())
    assert degrees == {("row", "1", 20.0): 270, ("row", "2", 10.0): 30, ("column", "1", 270.0): 20, ("column", "2", 30.0): 10}
    assert filtered_count(a, "V").first().n_rows == 300


def test_factorised_embedding_equals_the_edge_list(spark):
    """The operator on two incidence tables against the materialised pairs; also
    with sums that move by shuffles and values cut into parts."""
    import numpy as np

    from cobi.operators.records import factorised
    from cobi.operators.spectral import spectral_embedding
    from cobi.plans.runs import cluster_bipartite

    a = spark.createDataFrame([(i, 1 + i % 3 if i < 80 else 9) for i in range(90)], "ka long, v long")
    b = spark.createDataFrame([(i, 1 + i % 3) for i in range(20)] + [(50, -4), (51, 77)], "kb long, v long")
    g = build_record_graph(a, b, "v", "v", ["ka"], ["kb"])
    nodes = g.nodes()
    rows, cols = nodes.where("side = 'row'"), nodes.where("side = 'column'")
    pairs = (rows.select(rows.node.alias("first_field"), "value").join(
        cols.select(cols.node.alias("second_field"), "value"), "value")
        .selectExpr("first_field", "second_field", "1.0d AS weight"))
    want = spectral_embedding(pairs, 3, width=3)
    vectors = lambda r: np.array([x.embedding for x in r.embedding.orderBy("side", "node").collect()])
    w = vectors(want)
    for options in ({}, {"broadcast_bytes": 0}):
        got = spectral_embedding(None, 3, width=3, graph=factorised(g, part_rows=7), **options)
        np.testing.assert_allclose(got.sigma, want.sigma, atol=1e-9)
        np.testing.assert_allclose(got.sigma, [1, 1], atol=1e-9)      # one for each block but the trivial one
        z = vectors(got)
        # sigma repeats, so the vectors are free up to a rotation
        np.testing.assert_allclose(z @ z.T, w @ w.T, atol=1e-8)
    labels = cluster_bipartite(None, 3, width=3, graph=factorised(g)).labels.collect()
    assert len(labels) == 80 + 20
    assert len({(r.node.split("_")[1], r.cluster_no) for r in labels}) == 3
