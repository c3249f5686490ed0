"""A saved co-clustering model and its use on new edges (SNK9, CLU2).

With z = D^-1/2 (u, v) the embedding and An v = sigma u, a row node with edges
to known columns has

    z_row = 1 / (sigma d_row) * sum over columns of weight * z_column,

and the same with the sides swapped.  So nodes that were not in the graph are
placed by one join with the other side's saved vectors and one grouped sum, and
labelled by the nearest centre; nothing is decomposed again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobi.operators.cluster import predict
from cobi.sources.publish import current, publish


@dataclass
class CoclusterModel:
    """``nodes``: (side, node, embedding, cluster_no); ``sigma``: the singular
    values of the embedding's columns; ``centres``: by cluster number."""

    nodes: DataFrame
    sigma: list[float]
    centres: list[list[float]]

    @property
    def k(self) -> int:
        return len(self.centres)

    def save(self, path: str) -> str:
        """SNK9: a folder with the nodes and the numbers; saving again replaces
        the model as a whole."""
        spark = self.nodes.sparkSession

        def write(folder: str) -> None:
            self.nodes.write.parquet(f"{folder}/nodes")
            spark.createDataFrame([(self.sigma, self.centres)], _NUMBERS).coalesce(1).write.parquet(f"{folder}/numbers")
        return publish(spark, path, write)

    def place(self, edges: DataFrame, side: str = "row") -> DataFrame:
        """(node, known, embedding, cluster_no) of every node of ``side`` in
        ``edges`` that has an edge to a known node of the other side; ``known``
        is the weight of such edges.  Others cannot be placed and are left out."""
        own, other = ("first_field", "second_field") if side == "row" else ("second_field", "first_field")
        far = self.nodes.where(F.col("side") != side).select(F.col("node").alias(other), "embedding")
        sums = [F.sum(F.col("weight") * F.col("embedding")[j]).alias(f"f{j}") for j in range(len(self.sigma))]
        found = edges.join(far, other).groupBy(F.col(own).alias("node")).agg(F.sum("weight").alias("known"), *sums)
        z = F.array(*[F.col(f"f{j}") / (F.col("known") * F.lit(s)) for j, s in enumerate(self.sigma)])
        centres = edges.sparkSession.createDataFrame([(0, self.centres)], "pair int, centres array<array<double>>")
        placed = found.select(F.lit(0).alias("pair"), "node", "known", z.alias("embedding"))
        return predict(placed, centres).select("node", "known", "embedding", F.col("prediction").alias("cluster_no"))


_NUMBERS = "sigma array<double>, centres array<array<double>>"


def model_of(clustering) -> CoclusterModel:
    """The model of a finished clustering (``cluster_bipartite``).  Its centres
    stand in the order of the canonical cluster numbers: k rows say which is which."""
    points = clustering.kmeans.points.select("side", "node", "embedding", "prediction")
    nodes = points.join(clustering.labels, ["side", "node"])
    order = {r.cluster_no: r.prediction for r in nodes.select("cluster_no", "prediction").distinct().collect()}
    centres = clustering.kmeans.model.centres
    return CoclusterModel(nodes.drop("prediction"), clustering.spectral.sigma,
                          [centres[order[c]] for c in sorted(order)])


def load_model(spark: SparkSession, path: str) -> CoclusterModel:
    """The model saved in ``path``, by this or another session."""
    folder = current(spark, path)
    numbers = spark.read.parquet(f"{folder}/numbers").first()
    return CoclusterModel(spark.read.parquet(f"{folder}/nodes"), list(numbers.sigma), [list(c) for c in numbers.centres])
