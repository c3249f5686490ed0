"""End-to-end operators: cluster one edge list (E2E6), run one pair from a
pair list (E2E4), write its field pairs (E2E5) with the reference's options and
defaults (E2E7)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobi.operators.cluster import (ClusterResult, canonical_labels, fit_embeddings, kmeans_labels,
                                    points_partitions)
from cobi.operators.kmeans import Fit
from cobi.operators.spectral import (Graphs, SpectralResult, Spectrum, edge_graphs, spectral_embedding,
                                     spectral_embeddings)
from cobi.operators.sweep import sweep_edges
from cobi.session import ensure_checkpoint_dir
from cobi.sources import sinks
from cobi.sources.describe import collect_field_names, read_description, string_fields, string_fields_of
from cobi.sources.pairs import select_pair
from cobi.sources.publish import publish
from cobi.sources.tables import TableResolver

# E2E7 defaults (fixed values of the reference's command line): clusters,
# row cap, pair number.  The row cap is off here unless asked for.
DEFAULT_CLUSTERS = 5
REFERENCE_ROW_CAP = 100_000
DEFAULT_PAIR_NO = 1


@dataclass
class Clustering:
    labels: DataFrame             # (side, node, cluster_no)
    spectral: SpectralResult
    kmeans: ClusterResult


def cluster_bipartite(edges: DataFrame | None, k: int = DEFAULT_CLUSTERS, *, runs: int = 10,
                      max_iter: int = 300, seed: int = 0, discard: str = "trivial",
                      width: int | None = None, graph: Graphs | None = None, **spectral_options) -> Clustering:
    """E2E6: edge list (or another form of the graph) -> labels of row and column
    nodes.

    Raises on an empty graph (Q9) instead of returning nothing, and on one of
    rank 1 (``RankOneGraph``), which has no second singular vector.
    """
    spec = spectral_embedding(edges, k, discard=discard, width=width, seed=seed, graph=graph, **spectral_options)
    km = kmeans_labels(spec.embedding, k, runs=runs, max_iter=max_iter, seed=seed,
                       num_partitions=points_partitions(spec.n_nodes, spec.width))
    return Clustering(km.labels, spec, km)


@dataclass
class GraphClusters:
    labels: DataFrame             # (pair, side, node, cluster_no) of every graph
    embeddings: DataFrame | None  # (pair, side, node, embedding)
    spectra: dict[int, Spectrum]  # of the graphs that have one
    fits: dict[int, Fit]


def cluster_graphs(graphs: Graphs, k: int = DEFAULT_CLUSTERS, *, runs: int = 10, max_iter: int = 300,
                   seed: int = 0, **spectral_options) -> GraphClusters:
    """E2E6 for many graphs in one iteration: one decomposition and one k-means
    serve them all, so the number of jobs does not grow with their number.  A
    graph of rank 1 has nothing to tell its nodes apart: all are in cluster 0."""
    nodes = graphs.nodes.select("pair", "side", "node")
    emb, spectra = spectral_embeddings(graphs, k, seed=seed, **spectral_options)
    if not spectra:
        return GraphClusters(nodes.withColumn("cluster_no", F.lit(0)), None, {}, {})
    pred, fits = fit_embeddings(emb, list(spectra), k, runs=runs, max_iter=max_iter, seed=seed)
    labels = canonical_labels(pred, by=("pair",))
    flat = nodes.where(~F.col("pair").isin(list(spectra))).withColumn("cluster_no", F.lit(0))
    return GraphClusters(labels.unionByName(flat), emb, spectra, fits)


def pair_fields(spark: SparkSession, resolver: TableResolver, table: str, df: DataFrame) -> list[str]:
    """String fields of a table, the key column too if it is one: from its
    description file when the resolver names one (FLT5 on type names), else
    from the schema."""
    path = resolver.desc_path(table)
    if path:
        return collect_field_names(string_fields(read_description(spark, path)))
    return string_fields_of(df)


def _chosen(pairs: DataFrame, pair_no: int):
    """The pair's row: metadata, so it is read on the driver."""
    rows = select_pair(pairs, pair_no).collect()
    if not rows:
        raise ValueError(f"pair list has no line {pair_no}")
    return rows[0]


def run_pair(spark: SparkSession, pairs: DataFrame, resolver: TableResolver,
             pair_no: int = DEFAULT_PAIR_NO, **options) -> DataFrame:
    """E2E4 + E2E3: pick line ``pair_no`` of a pair list and sweep all string
    field pairs of its two tables in one job (``limit_a``, ``limit_b``: LIM1)."""
    p = _chosen(pairs, pair_no)
    a = resolver.table(spark, p["table_a"])
    b = resolver.table(spark, p["table_b"])
    fa = pair_fields(spark, resolver, p["table_a"], a)
    fb = pair_fields(spark, resolver, p["table_b"], b)
    return sweep_edges(a, b, p["column_a"], p["column_b"], fa, fb, **options)


def write_pair(root: str, pair_no: int, table_a: str, column_a: str, table_b: str, column_b: str, *,
               edgelist: DataFrame, labels: DataFrame | None = None, embedding: DataFrame | None = None) -> str:
    """E2E5: write one field pair's edge list, and its labels and embedding when
    clustered, under the reference's directory layout, replacing earlier output
    of the same pair as a whole (SNK8)."""
    out = sinks.pair_dir(root, pair_no, table_a, column_a, table_b, column_b)

    def write(folder: str) -> None:
        sinks.write_edges(edgelist, f"{folder}/edgelist")
        if labels is not None:
            sinks.write_labels(labels, f"{folder}/labels_row", "row")
            sinks.write_labels(labels, f"{folder}/labels_column", "column")
        if embedding is not None:
            sinks.write_embedding(embedding, f"{folder}/embedding")
    publish(edgelist.sparkSession, out, write)
    return out


@dataclass
class Sweep:
    """A sweep's edges with a number for each field pair (metadata: one entry
    per column pair)."""

    edges: DataFrame                       # (pair, first_field, second_field, weight)
    columns: dict[int, tuple[str, str]]    # pair -> (column_a, column_b)

    def named(self, df: DataFrame) -> DataFrame:
        """Field names in place of the number."""
        names = df.sparkSession.createDataFrame([(p, a, b) for p, (a, b) in self.columns.items()],
                                                "pair int, column_a string, column_b string")
        rest = [c for c in df.columns if c != "pair"]
        return df.join(F.broadcast(names), "pair").select("column_a", "column_b", *rest)


def numbered_sweep(sweep: DataFrame, pairs: list[tuple[str, str]] | None = None) -> Sweep:
    """The sweep, written once to the shared folder with its pairs numbered."""
    spark = sweep.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/sweep-{uuid.uuid4().hex}"
    sinks.write_sweep(sweep, path, mode="errorifexists")
    laid_out = spark.read.schema(sweep.schema).parquet(path)
    if pairs is None:
        pairs = sorted((r.column_a, r.column_b) for r in
                       laid_out.select("column_a", "column_b").distinct().collect())
    columns = dict(enumerate(pairs))
    numbers = spark.createDataFrame([(p, a, b) for p, (a, b) in columns.items()],
                                    "pair int, column_a string, column_b string")
    edges = laid_out.join(F.broadcast(numbers), ["column_a", "column_b"]).select(
        "pair", "first_field", "second_field", "weight")
    return Sweep(edges, columns)


def run_pair_to_files(spark: SparkSession, pairs: DataFrame, resolver: TableResolver, root: str,
                      pair_no: int = DEFAULT_PAIR_NO, *, k: int | None = None, runs: int = 10,
                      limit_a: int | None = None, limit_b: int | None = None) -> list[str]:
    """The reference's live run in one call (E2E3-E2E5, E2E7, SNK1, SNK8): the
    chosen pair's sweep, one directory per field pair with its edge list as
    TSV, heaviest edge first; with ``k`` also its labels and embedding, all field
    pairs clustered at once.  Each directory is published as a whole
    (``cobi.sources.publish``).  Returns the directories."""
    p = _chosen(pairs, pair_no)
    sweep = numbered_sweep(run_pair(spark, pairs, resolver, pair_no, limit_a=limit_a, limit_b=limit_b))
    found = cluster_graphs(edge_graphs(sweep.edges), k, runs=runs) if k is not None and sweep.columns else None
    labels = found.labels.checkpoint(eager=True) if found else None
    out = []
    for n, (ca, cb) in sweep.columns.items():
        own = lambda df: df.where(F.col("pair") == n).drop("pair")  # noqa: E731, B023
        parts = {"edgelist": own(sweep.edges)}
        if labels is not None and n in found.spectra:   # one cluster holds every node of a graph of rank 1
            parts |= {"labels": own(labels), "embedding": own(found.embeddings)}
        out.append(write_pair(root, pair_no, p["table_a"], ca, p["table_b"], cb, **parts))
    return out


def cluster_sweep(sweep: DataFrame, k: int = DEFAULT_CLUSTERS,
                  pairs: list[tuple[str, str]] | None = None, **options) -> DataFrame:
    """E2E3 + E2E6: cluster the edge lists of all (or the requested) field pairs
    of a sweep together -> (column_a, column_b, side, node, cluster_no)."""
    numbered = numbered_sweep(sweep, pairs)
    if not numbered.columns:
        return sweep.sparkSession.createDataFrame([], "column_a string, column_b string, side string, "
                                                      "node string, cluster_no int")
    return numbered.named(cluster_graphs(edge_graphs(numbered.edges), k, **options).labels)


def pair_count(sweep: DataFrame) -> DataFrame:
    """AGG10: the number of field pairs of a sweep that have edges, and of edges
    -> (n_pairs, n_edges)."""
    sizes = sweep.groupBy("column_a", "column_b").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"))
