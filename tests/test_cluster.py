"""CLU1-CLU3, AGG11, Q13."""

from cobi.operators.cluster import canonical_labels, kmeans_labels, recomputed_cost
from tests.conftest import rows


def test_canonical_numbering(spark):
    pred = spark.createDataFrame([("row", "b", 7), ("row", "c", 2), ("column", "z", 7),
                                  ("row", "a", 2)], "side string, node string, prediction int")
    got = rows(canonical_labels(pred))
    # cluster 7's first member is ('column','z') < ('row','a') of cluster 2
    assert got == [("column", "z", 0), ("row", "a", 1), ("row", "b", 0), ("row", "c", 1)]


def test_kmeans_cost(spark):
    pts = [("row", f"r{i}", [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(20)]
    emb = spark.createDataFrame(pts, "side string, node string, embedding array<double>")
    res = kmeans_labels(emb, 2, runs=2)
    sizes = sorted(r["count"] for r in res.labels.groupBy("cluster_no").count().collect())
    assert sizes == [10, 10]
    chk = recomputed_cost(res).first()
    assert chk.n_points == 20
    assert abs(chk.cost - res.cost) <= 1e-3 * max(res.cost, 1e-9)
