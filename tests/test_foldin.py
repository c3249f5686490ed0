"""CLU2 + SNK9: a saved model places nodes that were not in its graph."""

import subprocess
import sys

from pyspark.sql import functions as F

from cobi.operators.foldin import load_model, model_of
from cobi.plans.catalog import noisy_blocks
from cobi.plans.runs import cluster_bipartite
from tests.conftest import ROOT, SF_SMALL


def test_known_nodes_come_back_where_they_are(spark, tmp_out):
    edges = noisy_blocks(spark, SF_SMALL)
    model = model_of(cluster_bipartite(edges, 4, width=4))
    for side in ("row", "column"):
        placed = {r.node: r for r in model.place(edges, side).collect()}
        known = {r.node: r for r in model.nodes.where(F.col("side") == side).collect()}
        assert placed.keys() == known.keys()
        for n, r in placed.items():
            assert r.cluster_no == known[n].cluster_no
            assert max(abs(a - b) for a, b in zip(r.embedding, known[n].embedding, strict=True)) < 1e-5


def test_held_out_nodes_get_their_block_in_a_second_session(spark, tmp_out):
    edges = noisy_blocks(spark, SF_SMALL)
    out = F.col("first_field").cast("long") % 5 == 0
    model = model_of(cluster_bipartite(edges.where(~out), 4, width=4))
    model.save(tmp_out + "/m")
    block = {int(r.node) % 4: r.cluster_no for r in model.nodes.collect()}
    assert sorted(block.values()) == [0, 1, 2, 3]
    edges.where(out).unionByName(spark.createDataFrame([("new", "unknown", 1.0)], edges.schema)).write.parquet(tmp_out + "/e")
    script = ("import sys; from pyspark.sql import SparkSession; from cobi.operators.foldin import load_model\n"
              "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
              "m = load_model(s, sys.argv[1] + '/m'); assert m.k == 4\n"
              "m.place(s.read.parquet(sys.argv[1] + '/e')).write.parquet(sys.argv[1] + '/placed')")
    subprocess.run([sys.executable, "-c", script, tmp_out], cwd=ROOT, check=True, capture_output=True, timeout=300)
    placed = spark.read.parquet(tmp_out + "/placed").collect()
    assert {r.node for r in placed} == {r.first_field for r in edges.where(out).collect()}     # "new" has no known edge
    assert all(r.cluster_no == block[int(r.node) % 4] for r in placed)
    assert load_model(spark, tmp_out + "/m").sigma == model.sigma
