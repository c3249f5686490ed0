"""CLU1: all runs in shared passes, against Spark ML's fits and brute force."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cobi.operators.cluster import fit_embeddings, kmeans_labels, recomputed_cost
from cobi.operators.spectral import spectral_embedding
from cobi.plans.catalog import noisy_blocks
from tests.conftest import SF_SMALL
from tests.test_spectral import jobs

SCHEMA = "pair int, side string, node string, embedding array<double>"


def blobs(pair, k, n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, width)) * 20
    return [(pair, "row", f"n{i}", (centres[i % k] + rng.normal(size=width) * spread).tolist()) for i in range(n)]


def test_cost_is_at_most_that_of_the_best_single_fit(spark):
    emb = spectral_embedding(noisy_blocks(spark, SF_SMALL), 4, width=4).embedding.persist()
    ours = kmeans_labels(emb, 4, runs=10)
    points = emb.select(array_to_vector("embedding").alias("features"))
    best = min(KMeans(k=4, seed=s, maxIter=300).fit(points).summary.trainingCost for s in range(10))
    assert ours.cost <= best * (1 + 1e-6) and min(ours.costs) == ours.cost and len(ours.costs) == 10
    check = recomputed_cost(ours).first()
    assert check.cost == pytest.approx(ours.cost, rel=1e-9) and check.n_points == emb.count()
    emb.unpersist()


def test_point_sets_of_different_widths_together(spark):
    rows = blobs(0, 3, 90, 2, 1) + blobs(1, 5, 200, 6, 2) + [(2, "row", f"s{i}", [1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pred, fits = fit_embeddings(df, [0, 1, 2], 5)
    got = {(r.pair, r.node): r.prediction for r in pred.collect()}
    assert len(got) == len(rows)
    for pair, k, n in ((1, 5, 200),):
        for i in range(n):
            assert got[pair, f"n{i}"] == got[pair, f"n{i % k}"]
        assert len({got[pair, f"n{i}"] for i in range(k)}) == k
    assert fits[2].cost == 0 and len(fits[2].centres) == 1       # one distinct point, one centre
    x = np.array([e for p, _, _, e in rows if p == 1])
    d = ((x[:, None] - fits[1].centres[None]) ** 2).sum(2)
    assert d.min(1).sum() == pytest.approx(fits[1].cost)
    # nothing stays cached, and the layout does not matter
    again, more = fit_embeddings(df.coalesce(1), [0, 1, 2], 5)
    assert more[1].cost == pytest.approx(fits[1].cost) and more[0].run == fits[0].run
    assert not df.storageLevel.useMemory


def test_passes_serve_all_runs_and_sets(spark):
    few = spark.createDataFrame(blobs(0, 3, 60, 2, 1), SCHEMA)
    many = spark.createDataFrame(sum((blobs(p, 3, 60, 2, 1) for p in range(6)), []), SCHEMA)
    one = jobs(spark, lambda: fit_embeddings(few, [0], 3, runs=1))
    all_ = jobs(spark, lambda: fit_embeddings(many, list(range(6)), 3, runs=10))
    assert all_ <= one + 12          # the slowest run may need more steps; not 60 times as many jobs


def test_fewer_points_than_clusters_and_no_points(spark):
    df = spark.createDataFrame([("row", "a", [0.0]), ("row", "b", [1.0]), ("column", "c", [1.0])],
                               "side string, node string, embedding array<double>")
    res = kmeans_labels(df, 5)
    assert {r.node: r.cluster_no for r in res.labels.collect()} == {"c": 0, "a": 1, "b": 0} and res.cost == 0
    with pytest.raises(ValueError):
        kmeans_labels(df.where(F.lit(False)), 2)
