"""Truncated SVD of degree-normalised adjacency matrices and the joint embedding
of both sides (MAT5-MAT8, SET1), for one graph or for many at once.

Engine: block Krylov iteration with thick restarts, written with DataFrame
joins and aggregates.

* ``Graphs`` holds An = D1^-1/2 A D2^-1/2 of each graph, told apart by ``pair``.
  Node ids are unique over all of them, so the graphs together are one
  block-diagonal matrix and a half step  X -> An X  (or An^T X) serves them all.
  ``EdgeGraphs`` keeps An as an edge list: a half step is one join with the
  factor block and one grouped sum.  The factor side is broadcast when its size
  -- node count x columns x 8 bytes, counted before the loop -- is under
  ``broadcast_bytes``; otherwise the edges are stored once hash-partitioned by
  (node, salt), hot nodes spread over salt buckets (``cobi.operators.skew``), and
  only the node-sized factor block is shuffled into that layout each step.  When
  the smaller side's block is under ``broadcast_bytes``, a step is one pass instead:
  the edges are packed once into pieces of whole row nodes, a task takes its pieces
  through An and An^T in one go, and only its sum for the smaller side is shuffled.
  Packing is one shuffle of the edges, which numbers the row nodes and normalises too.
  (``cobi.operators.records`` has a factorised form for the record graph.)
* The iteration runs on each graph's smaller side.  The basis K and its image
  Z = An^T An K are one row per node, (pair, id, t, k array, z array),
  checkpointed after every step.  Each step applies the matrix to the part of the
  newest image that is orthogonal to K.
* Inner products are one job a step for all graphs: summed inside each
  partition, merged in about sqrt(P) tasks, and only those sums, p x p matrices
  per graph, reach the driver (p <= ``basis`` blocks).
* Rayleigh-Ritz on K after each step gives a graph's singular values, and from Z
  the residual ||An^T u - sigma v|| of every triplet.  A graph leaves the
  iteration when its wanted ones are below ``tol`` or its basis is invariant;
  ``max_iter`` only guards against a run without end, and reaching it is an error
  unless the caller asks for the unconverged result.
* When a basis is full it shrinks to its best Ritz vectors and goes on.
* Exact deflation: the leading singular triplet is known, sigma = 1,
  u0 = sqrt(d_row / total), v0 = sqrt(d_col / total).  The column ``t`` holds v0
  and every block is projected off it.  This is what "discard the first
  singular vector" means and it stays right when sigma = 1 repeats
  (disconnected graphs).
* A triplet counts when sigma > ``rank_tol``, where the largest sigma of An is 1,
  so a low-rank matrix yields fewer vectors (Q15).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.functions.vectors import embedding_width, scale
from cobi.operators.skew import hot_keys
from cobi.session import ensure_checkpoint_dir, written

DISCARD_MODES = ("trivial", "none", "first", "last")
PIECE_EDGES = 1 << 19           # edges packed into one row
PACK_EDGES = 1 << 21            # edges packed at a time
PARTITION_EDGES = 1 << 23       # edges packed into one partition
PACK_BYTES = 64 << 20           # smaller sides up to this size (names, 64 bytes a node) are sent to the packing tasks
SLICE = 1 << 13                 # nodes of the smaller side whose sums travel as one row
_PIECES = ("pair int, r binary, degree binary, c binary, w binary, "
           "nodes array<struct<node: string, id: bigint, d: double>>")
_SALT = "_cobi_salt"
_BUCKETS = "_cobi_buckets"


class RankOneGraph(ValueError):
    """The graph has no singular vector beside the trivial one."""


@dataclass(frozen=True)
class GraphSize:
    m: int             # row nodes
    n: int             # column nodes
    total: float       # sum of the weights

    @property
    def flip(self) -> bool:
        """The rows are the smaller side, which the iteration runs on."""
        return self.m < self.n

    @property
    def small(self) -> int:
        return min(self.m, self.n)


class Graphs:
    """Normalised matrices of one or more graphs.

    ``nodes``: (pair, side, node, id, d, t, small): d the degree, t = sqrt(d /
    total), small whether the node is on its graph's smaller side; ids are unique
    over all graphs and sides.  ``sizes``: a GraphSize for each pair.
    """

    nodes: DataFrame
    sizes: dict[int, GraphSize]

    def half(self, block: DataFrame, to_small: bool, b: int, active: list[int], *,
             broadcast_bytes: int, min_hot_rows: int) -> DataFrame:
        """An^T X (``to_small``) or An X, of the active graphs; blocks are
        (id, f0..f{b-1})."""
        raise NotImplementedError

    def normal(self, block: DataFrame, b: int, active: list[int], **step) -> DataFrame:
        """An^T An X of the active graphs, X on their smaller sides."""
        return self.half(self.half(block, False, b, active, **step), True, b, active, **step)

    def small_nodes(self) -> DataFrame:
        return self.nodes.where("small")

    def factor_rows(self, to_small: bool) -> int:
        return sum(max(s.m, s.n) if to_small else s.small for s in self.sizes.values())

    def release(self) -> None:
        """Unpersist what half steps have cached."""


@dataclass
class EdgeGraphs(Graphs):
    """Weighted edges ``table`` (pair, first_field, second_field, weight), written once.

    ``pieces`` is An packed for passes (see ``_pack``), unless the smaller sides are
    too large to be sent to every task: (pair, r, degree, c, w, nodes)."""

    table: DataFrame
    nodes: DataFrame
    sizes: dict[int, GraphSize]
    n_edges: int = 0
    small: DataFrame | None = None
    pieces: DataFrame | None = None
    order: SmallOrder | None = None
    _layouts: dict = field(default_factory=dict)
    _edges: DataFrame | None = None

    def release(self) -> None:
        for layout in self._layouts.values():
            layout[0].unpersist()
        self._layouts.clear()
        if self.pieces is not None:
            self.pieces.unpersist()

    def small_nodes(self) -> DataFrame:
        return self.nodes.where("small") if self.small is None else self.small

    @property
    def edges(self) -> DataFrame:
        """An as rows (pair, r, c, w) of ids, c on the smaller side; made when a
        half step has to shuffle edges."""
        if self._edges is None:
            both = self.table
            for col, side in (("first_field", "row"), ("second_field", "column")):
                own = self.nodes.where(F.col("side") == side).select(
                    "pair", F.col("node").alias(col), F.col("id").alias(side), F.col("d").alias(f"{side}_d"))
                both = both.join(own, ["pair", col])
            flip = F.col("pair").isin([p for p, s in self.sizes.items() if s.flip])
            self._edges = both.select(
                "pair", F.when(flip, F.col("column")).otherwise(F.col("row")).alias("r"),
                F.when(flip, F.col("row")).otherwise(F.col("column")).alias("c"),
                (F.col("weight") / F.sqrt(F.col("row_d") * F.col("column_d"))).alias("w")).checkpoint(eager=True)
        return self._edges

    def _only(self, df: DataFrame, active: list[int]) -> DataFrame:
        return df if len(active) == len(self.sizes) else df.where(F.col("pair").isin(active))

    def _one_pass(self, b: int, broadcast_bytes: int) -> bool:
        return self.pieces is not None and self.factor_rows(False) * (b + 2) * 8 <= broadcast_bytes

    def normal(self, block, b, active, *, broadcast_bytes, min_hot_rows):
        if not self._one_pass(b, broadcast_bytes):
            return super().normal(block, b, active, broadcast_bytes=broadcast_bytes, min_hot_rows=min_hot_rows)
        # both half steps in one pass: what meets in a row node never leaves its task,
        # and the tasks' sums travel as slices of columns, not as rows
        spark = self.nodes.sparkSession
        parts = self._passed(block, b, active, back=True)
        own = spark.sparkContext.broadcast((self.order.ids, np.isin(self.order.pairs, active)))
        count = min(_partitions(spark), -(-len(self.order.ids) // SLICE))
        return parts.repartition(count, "slice").mapInArrow(_summed(own, b), _block_schema(b))

    def _passed(self, block: DataFrame, b: int, active: list[int], back: bool) -> DataFrame:
        """The factor block, bounded by ``broadcast_bytes``, through the packed edges."""
        if not self.pieces.is_cached:
            self.pieces.persist(StorageLevel.MEMORY_AND_DISK)
        rows = block.toArrow()
        at = self.order.places(rows.column("id").to_numpy())
        x = np.zeros((b, len(self.order.ids)))
        for j in range(b):
            x[j, at] = rows.column(f"f{j}").to_numpy()
        shared = self.nodes.sparkSession.sparkContext.broadcast(x)
        pieces = self._only(self.pieces.select("pair", "r", "degree", "c", "w"), active)
        return pieces.mapInArrow(_through(shared, back), "slice int, part binary" if back else _block_schema(b))

    def half(self, block, to_small, b, active, *, broadcast_bytes, min_hot_rows):
        if not to_small and self._one_pass(b, broadcast_bytes):
            return self._passed(block, b, active, back=False)
        src, dst = ("r", "c") if to_small else ("c", "r")
        cols = [f"f{j}" for j in range(b)]
        fac = block.select(F.col("id").alias(src), *cols)
        if self.factor_rows(to_small) * (b + 2) * 8 <= broadcast_bytes:
            joined = self._only(self.edges, active).join(F.broadcast(fac), src)
        else:
            edges, hot_df, p, keys = self._salted_layout(src, min_hot_rows)
            if hot_df is not None:
                fac = (fac.join(hot_df, src, "left")
                       .withColumn(_SALT, F.explode(
                           F.when(F.col(_BUCKETS).isNull(), F.array(F.lit(0)))
                           .otherwise(F.sequence(F.lit(0), F.col(_BUCKETS) - 1))))
                       .drop(_BUCKETS))
            # Same hash layout as the cached edges: only the factor block moves.
            fac = fac.repartition(p, *keys).hint("shuffle_hash")
            joined = self._only(edges, active).join(fac, keys)
        return joined.groupBy(F.col(dst).alias("id")).agg(*[F.expr(f"sum(w * {c}) AS {c}") for c in cols])

    def _salted_layout(self, src: str, min_hot_rows: int):
        """Edges hash-partitioned by (src node, salt) with hot src nodes spread
        over salt buckets; built once per side and reused by every iteration."""
        if src in self._layouts:
            return self._layouts[src]
        spark = self.table.sparkSession
        p = _partitions(spark)
        hot = hot_keys(self.edges, src, min_hot_rows, p)
        other = "c" if src == "r" else "r"
        if hot:
            hot_df = F.broadcast(spark.createDataFrame(hot, f"{src} long, {_BUCKETS} int"))
            salted = (self.edges.join(hot_df, src, "left")
                      .withColumn(_SALT, F.when(F.col(_BUCKETS).isNull(), F.lit(0))
                                  .otherwise(F.pmod(F.xxhash64(other), F.col(_BUCKETS)).cast("int")))
                      .drop(_BUCKETS))
            keys = [src, _SALT]
        else:
            # No hot node: partition by the node alone (a constant salt would be
            # folded out of the join keys and force a re-shuffle of the edges).
            hot_df = None
            salted = self.edges
            keys = [src]
        layout = (salted.repartition(p, *keys).persist(StorageLevel.MEMORY_AND_DISK), hot_df, p, keys)
        self._layouts[src] = layout
        return layout


def _block_schema(b: int) -> str:
    return ", ".join(["id long", *[f"f{j} double" for j in range(b)]])


@dataclass(frozen=True)
class SmallOrder:
    """The nodes of the smaller sides, numbered by graph and id: ``pairs``, ``ids``,
    degrees ``d`` and ``names`` in that order."""

    pairs: np.ndarray
    ids: np.ndarray
    d: np.ndarray
    names: pa.Array

    def places(self, ids: np.ndarray) -> np.ndarray:
        at = np.argsort(self.ids, kind="stable")
        return at[np.searchsorted(self.ids, ids, sorter=at)]


def _small_order(small: DataFrame) -> SmallOrder:
    rows = small.select("pair", "id", "d", "node").toArrow().combine_chunks()
    pairs, ids, d = (rows.column(c).to_numpy() for c in ("pair", "id", "d"))
    at = np.lexsort((ids, pairs))
    return SmallOrder(pairs[at], ids[at], d[at], rows.column("node").combine_chunks().take(pa.array(at)))


def _pack(shared):
    """The edges (part, pair, r, c, weight) of all row nodes of a partition, ``part`` its
    number, as pieces of whole row nodes of one graph and about ``PIECE_EDGES`` edges:
    ids of the row nodes, their numbers of edges, places of c in the order of the
    smaller sides, normalised weights, and the row nodes (node, id, d).  Ids go by
    part, pair and name: they are the same when a partition is read again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small_pairs, small_d, small_names = shared.value

        def places(pair: int, names: pa.ChunkedArray) -> np.ndarray:
            lo, hi = np.searchsorted(small_pairs, [pair, pair + 1])
            return lo + pc.index_in(names, value_set=small_names.slice(lo, hi - lo)).to_numpy()

        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        part = held[0].column("part")[0].as_py()
        held.clear()
        pair, w = (rows.column(x).to_numpy() for x in ("pair", "weight"))
        row, other = rows.column("r").combine_chunks().dictionary_encode(), rows.column("c")
        del rows
        by_name = np.asarray(pc.sort_indices(row.dictionary))
        rank = np.empty(len(by_name), dtype=np.int64)
        rank[by_name] = np.arange(len(by_name))
        if (pair == pair[0]).all():
            pairs, of, c = pair[:1], 0, places(int(pair[0]), other)
        else:
            pairs, of = np.unique(pair, return_inverse=True)
            c = np.empty(len(pair), dtype=np.int64)
            for i, p in enumerate(pairs.tolist()):
                own = np.flatnonzero(of == i)
                c[own] = places(p, other.take(pa.array(own)))
        key = of * len(by_name) + rank[row.indices.to_numpy()]
        at = np.argsort(key * len(small_d) + c)
        key, c, w = key[at], c[at].astype(np.int32), w[at]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        own, degree = key[first], np.diff(np.append(first, len(key))).astype(np.int32)
        ids = ((part << 33) + np.arange(len(first))) * 2
        d = np.add.reduceat(w, first)
        with np.errstate(invalid="ignore", divide="ignore"):    # the caller looks for degrees that are not positive
            w = w / np.sqrt(np.repeat(d, degree) * small_d[c])
        names, own = row.dictionary.take(pa.array(by_name[own % len(by_name)])), own // len(by_name)
        cuts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (first[1:] // PIECE_EDGES != first[:-1] // PIECE_EDGES)))
        for lo, hi in zip(cuts, [*cuts[1:], len(first)], strict=True):
            a, z = first[lo], first[hi] if hi < len(first) else len(key)
            nodes = pa.StructArray.from_arrays([names.slice(lo, hi - lo), pa.array(ids[lo:hi]), pa.array(d[lo:hi])],
                                               names=["node", "id", "d"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(pairs[own[lo]])], pa.int32()),
                 *[pa.array([y.tobytes()], pa.binary()) for y in (ids[lo:hi], degree[lo:hi], c[a:z], w[a:z])],
                 pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), nodes)],
                names=["pair", "r", "degree", "c", "w", "nodes"])
    return run


def _through(shared, back: bool):
    """Rows (id, f0..) of An X, or (``back``) each task's part of An^T An X as slices
    (slice, part) of the smaller side, for the columns one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        names = ["id", *[f"f{j}" for j in range(len(x))]]
        out = np.zeros(x.shape) if back else None
        met = np.zeros(-(-x.shape[1] // SLICE), dtype=bool)
        for batch in batches:
            for piece in zip(*[batch.column(k) for k in ("r", "degree", "c", "w")], strict=True):
                r, degree, c, w = (np.frombuffer(y.as_buffer(), t) for y, t in
                                   zip(piece, ("<i8", "<i4", "<i4", "<f8"), strict=True))
                first, lo, hi = np.cumsum(degree) - degree, int(c.min()), int(c.max()) + 1
                c = c.astype(np.int64) - lo
                if not back:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r), *[pa.array(np.add.reduceat(f[lo:hi].take(c) * w, first)) for f in x]], names)
                    continue
                row = np.repeat(np.arange(len(r)), degree)
                met[lo // SLICE:-(-hi // SLICE)] = True
                for f, to in zip(x, out, strict=True):
                    to[lo:hi] += np.bincount(c, weights=np.add.reduceat(f[lo:hi].take(c) * w, first).take(row) * w)
        for s in np.flatnonzero(met):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(s)], pa.int32()), pa.array([out[:, s * SLICE:(s + 1) * SLICE].tobytes()], pa.binary())],
                names=["slice", "part"])
    return run


def _summed(shared, b: int):
    """Rows (id, f0..) of the sums of all tasks' slices, of the nodes that are asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                part = np.frombuffer(part.as_buffer(), "<f8")
                if s in sums:
                    sums[s] += part
                else:
                    sums[s] = part.copy()
        for s, part in sums.items():
            lo, part = s * SLICE, part.reshape(b, -1)
            at = np.flatnonzero(own[lo:lo + SLICE])
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + at]), *[pa.array(z[at]) for z in part]],
                                             names=["id", *[f"f{j}" for j in range(b)]])
    return run


def _shapes(table: DataFrame) -> tuple[list[int], int]:
    """The graphs whose rows are the smaller side, and the number of edges.  Sides of
    clearly different size are told apart by estimates, the others are counted."""
    sides = ("first_field", "second_field")
    found = table.groupBy("pair").agg(F.count(F.lit(1)).alias("e"),
                                      *[F.approx_count_distinct(c, 0.02).alias(c) for c in sides]).collect()
    counts = {r["pair"]: (r[sides[0]], r[sides[1]]) for r in found}
    close = [p for p, (m, n) in counts.items() if abs(m - n) <= 0.2 * max(m, n)]
    if close:
        exact = table.where(F.col("pair").isin(close)).groupBy("pair").agg(
            *[F.count_distinct(c).alias(c) for c in sides]).collect()
        counts.update({r["pair"]: (r[sides[0]], r[sides[1]]) for r in exact})
    return [p for p, (m, n) in counts.items() if m < n], sum(int(r["e"]) for r in found)


def edge_graphs(edges: DataFrame) -> EdgeGraphs:
    """Degrees, totals and the packed matrices of (pair int, first_field,
    second_field, weight).  The edges are written once; then the smaller sides are
    counted, and one shuffle by row node numbers, counts, normalises and packs.  Only
    metadata (one row per graph) and the smaller sides, if they are under
    ``PACK_BYTES``, reach the driver."""
    spark = edges.sparkSession
    table = written(edges.select("pair", "first_field", "second_field", F.col("weight").cast("double").alias("weight")),
                    "graph")
    flipped, n_edges = _shapes(table)
    if not n_edges:
        raise ValueError("the graph has no edges; nothing to decompose (FLT9)")
    flip = F.col("pair").isin(flipped)
    turned = table.select("pair", F.when(flip, F.col("second_field")).otherwise(F.col("first_field")).alias("r"),
                          F.when(flip, F.col("first_field")).otherwise(F.col("second_field")).alias("c"), "weight")

    def counted(nodes: DataFrame) -> dict:
        stats = nodes.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total"), F.min("d").alias("min_d"),
                                          F.sum(F.length("node")).alias("chars")).collect()
        if any(r["min_d"] is None or not r["min_d"] > 0 for r in stats):
            raise ValueError("edge weights must be positive: a node has degree <= 0")
        return {r["pair"]: r for r in stats}

    def grouped(col: str, parity: int) -> DataFrame:
        return (turned.groupBy("pair", F.col(col).alias("node")).agg(F.sum("weight").alias("d"))
                .withColumn("id", F.monotonically_increasing_id() * 2 + parity).checkpoint(eager=True))

    small = grouped("c", 1)
    few = counted(small)
    pieces = order = None
    if sum(r["n"] * 64 + (r["chars"] or 0) for r in few.values()) <= PACK_BYTES:
        order = _small_order(small)
        # a task packs partitions of at most about PACK_EDGES edges one after another
        tasks = max(spark.sparkContext.defaultParallelism, -(-n_edges // PARTITION_EDGES))
        dealt = turned.where("r is not null and c is not null").repartition(tasks * -(-n_edges // (tasks * PACK_EDGES)), "pair", "r")
        known = spark.sparkContext.broadcast((order.pairs, order.d, order.names))
        pieces = (dealt.select(F.spark_partition_id().alias("part"), "pair", "r", "c", "weight")
                  .mapInArrow(_pack(known), _PIECES).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK))
        large = pieces.select("pair", F.inline("nodes")).checkpoint(eager=True)
    else:
        large = grouped("r", 0)
    many = counted(large)
    sizes = {p: GraphSize(*[int(x[p]["n"]) for x in ((few, many) if p in flipped else (many, few))], float(few[p]["total"]))
             for p in few}
    sided = lambda nodes, rows: nodes.select("pair", F.when(rows, "row").otherwise("column").alias("side"), "node", "id", "d")
    small, large = with_scale(sided(small, flip), sizes), with_scale(sided(large, ~flip), sizes)
    return EdgeGraphs(table, large.unionByName(small), sizes, n_edges, small, pieces, order)


def with_scale(nodes: DataFrame, sizes: dict[int, GraphSize]) -> DataFrame:
    """Adds t = sqrt(d / total) and ``small`` to (pair, side, node, id, d)."""
    total = F.create_map(*[F.lit(x) for p, s in sizes.items() for x in (p, s.total)])
    flip = F.col("pair").isin([p for p, s in sizes.items() if s.flip])
    return nodes.select("pair", "side", "node", "id", "d",
                        F.sqrt(F.col("d") / F.element_at(total, F.col("pair"))).alias("t"),
                        (flip == (F.col("side") == "row")).alias("small"))


def normalized_graph(edges: DataFrame) -> EdgeGraphs:
    """The normalised matrix of one edge list."""
    return edge_graphs(edges.withColumn("pair", F.lit(0)))


@dataclass
class Spectrum:
    sigma: list[float]        # singular values kept, descending
    residuals: list[float]    # ||An^T u - sigma v|| of each
    iterations: int
    converged: bool

    @property
    def width(self) -> int:
        return len(self.sigma)


@dataclass
class SpectralResult:
    embedding: DataFrame      # (side, node, embedding array<double>)
    sigma: list[float]        # singular values kept, descending
    iterations: int
    width: int
    n_nodes: int = 0          # m + n
    residuals: list[float] = field(default_factory=list)  # ||An^T u - sigma v|| of each
    converged: bool = True


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- the basis: one row (pair, id, t, k, z) per node of the smaller side ---------

def _by_pair(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    pairs = batch.column("pair").to_numpy(zero_copy_only=False)
    if not len(pairs):
        return
    if (pairs == pairs[0]).all():
        yield int(pairs[0]), batch
        return
    order = np.argsort(pairs, kind="stable")
    limits = np.flatnonzero(np.diff(pairs[order], prepend=pairs[order[0]] - 1))
    for lo, hi in zip(limits, [*limits[1:], len(order)], strict=True):
        yield int(pairs[order[lo]]), batch.take(pa.array(order[lo:hi]))


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    """[t, k..., z...] of the rows of one graph as a matrix."""
    parts = [batch.column("t").to_numpy(zero_copy_only=False)[:, None]]
    for name in ("k", "z"):
        values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
        parts.append(values.reshape(batch.num_rows, -1))
    return np.concatenate(parts, axis=1)


def _matrices(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([g.ravel() for g in sums.values()], pa.list_(pa.float64()))],
        names=["pair", "g"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for pair, g in zip(batch.column("pair").to_pylist(), batch.column("g"), strict=True):
            g = g.values.to_numpy()
            sums[pair] = sums[pair] + g if pair in sums else g.copy()
    if sums:
        yield _matrices(sums)


def _grams(basis: DataFrame) -> dict[int, np.ndarray]:
    """Inner products of t, K and Z of each graph, in one job: sums of each
    partition, merged in about sqrt(P) tasks."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for pair, rows in _by_pair(batch):
                x = _arrays(rows)
                g = x.T @ x
                sums[pair] = sums[pair] + g if pair in sums else g
        if sums:
            yield _matrices(sums)

    schema = "pair int, g array<double>"
    rows = basis.select("pair", "t", "k", "z").mapInArrow(partial, schema)
    merge = math.isqrt(_partitions(basis.sparkSession))
    if merge > 4:
        rows = rows.repartition(merge).mapInArrow(_merged, schema)
    out: dict[int, np.ndarray] = {}
    for pair, g in zip(*rows.toArrow().to_pydict().values(), strict=True):
        g = np.array(g).reshape(math.isqrt(len(g)), -1)
        out[pair] = out[pair] + g if pair in out else g
    return out


def _combined(basis: DataFrame, plan: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(pair, id, t, k @ keep, z @ keep, f) with f = [t, k, z] @ new, where
    ``plan`` has (keep, new) of each graph."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, rows in _by_pair(batch):
                keep, new = plan[pair]
                x, p = _arrays(rows), keep.shape[0]
                none = np.zeros((len(x), 0))
                out = [x[:, 1:1 + p] @ keep if keep.size else none,
                       x[:, 1 + p:] @ keep if keep.size else none, x @ new]
                lists = [pa.ListArray.from_arrays(
                    pa.array((np.arange(len(x) + 1) * y.shape[1]).astype(np.int32)),
                    pa.array(np.ascontiguousarray(y).ravel())) for y in out]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("pair"), rows.column("id"), rows.column("t"), *lists],
                    names=["pair", "id", "t", "k", "z", "f"])

    return basis.mapInArrow(run, "pair int, id long, t double, k array<double>, z array<double>, f array<double>")


def _whitened(gram: np.ndarray, floor: float) -> np.ndarray:
    """Columns that make a basis with this Gram matrix orthonormal; directions
    whose squared norm is at most ``floor`` are left out."""
    lam, vecs = np.linalg.eigh((gram + gram.T) / 2.0)
    good = lam > floor
    return vecs[:, good] / np.sqrt(lam[good])


class _Iteration:
    """The driver's part of one graph: small matrices only."""

    def __init__(self, wanted: int, oversample: int, dimension: int, deflate: bool, basis: int):
        self.wanted, self.dimension, self.deflate, self.basis = wanted, dimension, deflate, basis
        self.b = max(0, min(wanted + oversample, dimension))
        self.p, self.b_new, self.steps = 0, 0, 0
        self.done = self.exhausted = False

    def start(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The start block (k, with z = k) without its part along t, orthonormal."""
        p = self.b
        new = np.zeros((1 + p, p))
        new[1:] = np.eye(p)
        if self.deflate:
            new[0] = -gram[0, 1:1 + p]
        white = _whitened(new.T @ gram[:1 + p, :1 + p] @ new, 1e-12)
        self.b_new = white.shape[1]
        return np.zeros((p, 0)), np.concatenate([new @ white, np.zeros((p, self.b_new))])

    def step(self, gram: np.ndarray, tol: float, rank_tol: float) -> None:
        """Rayleigh-Ritz on the basis with its newest block."""
        self.steps += 1
        self.p += self.b_new
        p, self.gram = self.p, gram
        T, K, Z = 0, slice(1, 1 + p), slice(1 + p, 1 + 2 * p)
        if self.deflate:
            # images lose what rounding left along t
            shift = np.eye(1 + 2 * p)
            shift[T, Z] = -gram[T, Z]
            gram_d = shift.T @ gram @ shift
        else:
            gram_d = gram
        kk, kz, zz = gram_d[K, K], gram_d[K, Z], gram_d[Z, Z]
        self.white = _whitened(kk, 1e-10)
        theta, s = np.linalg.eigh(self.white.T @ ((kz + kz.T) / 2.0) @ self.white)
        order = np.argsort(theta)[::-1]
        theta, self.coeff = np.clip(theta[order], 0.0, None), self.white @ s[:, order]
        c = self.coeff
        square = (np.einsum("ij,ik,kj->j", c, zz, c) - 2 * theta * np.einsum("ij,ik,kj->j", c, kz, c) + theta ** 2)
        self.sigma = np.sqrt(theta)
        self.residual = np.sqrt(np.clip(square, 0.0, None)) / np.maximum(self.sigma, 1e-300)
        real = self.sigma[:self.wanted] > rank_tol
        # a triplet with sigma near zero is the end of the spectrum
        self.done = (len(self.sigma) >= min(self.wanted, self.dimension)
                     and bool(np.all(self.residual[:self.wanted][real] <= tol)))
        # directions of the newest image that the basis does not hold
        last = np.zeros((1 + 2 * p, self.b_new))
        last[1 + p + p - self.b_new:, :] = np.eye(self.b_new)
        if self.deflate:
            last[T] = -gram[T, 1 + p + p - self.b_new:]
        last[K] -= self.white @ (self.white.T @ (gram[K] @ last))
        extend = _whitened(last.T @ gram @ last, 1e-22)
        self.last, self.extend = last, extend[:, ::-1][:, :max(0, self.dimension - p)]
        self.exhausted = self.extend.shape[1] == 0

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        keep = np.eye(self.p)
        if self.p + self.extend.shape[1] > self.basis * self.b:
            keep = self.coeff[:, :max(2 * self.b, self.p // 3)]
        new = self.last @ self.extend
        self.b_new, self.p = self.extend.shape[1], keep.shape[1]
        return keep, new

    def chosen(self, discard: str, r: int, rank_tol: float) -> list[int]:
        most = min(self.wanted if self.deflate else r, len(self.sigma))
        sel = [i for i in range(most) if self.sigma[i] > rank_tol]
        return {"first": sel[1:], "last": sel[:-1]}.get(discard, sel)

    def vectors(self, sel: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The right vectors, and these over sigma (An takes them to the left ones)."""
        new = np.zeros((1 + 2 * self.p, len(sel)))
        new[1:1 + self.p] = self.coeff[:, sel]
        if self.deflate:
            new[0] = -(self.gram[0, 1:1 + self.p] @ self.coeff[:, sel])
        return np.zeros((self.p, 0)), np.concatenate([new, new / self.sigma[sel]], axis=1)


def _start(init: DataFrame, widths: dict[int, int], seed: int) -> DataFrame:
    """Start blocks from a hash of (node, column, seed): the same values
    whatever the partitioning."""
    cols = []
    for j in range(max(widths.values())):
        h = F.xxhash64(F.col("node"), F.lit(j), F.lit(seed))
        cols.append(F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30) - 0.5)
    width = F.create_map(*[F.lit(x) for p, b in widths.items() for x in (p, b)])
    block = F.slice(F.array(*cols), F.lit(1), F.element_at(width, F.col("pair")))
    return init.select("pair", "id", "t", block.alias("k"), block.alias("z"))


def _columns(b: int) -> list:
    return [F.coalesce(F.get("f", F.lit(j)), F.lit(0.0)).alias(f"f{j}") for j in range(b)]


def spectral_embeddings(graphs: Graphs, k: int = 5, *, discard: str = "trivial", width: int | None = None,
                        oversample: int = 4, basis: int = 10, max_iter: int = 400, tol: float = 1e-5,
                        seed: int = 0, rank_tol: float = 1e-6, broadcast_bytes: int = 64 << 20,
                        min_hot_rows: int = 100_000, require_converged: bool = True
                        ) -> tuple[DataFrame | None, dict[int, Spectrum]]:
    """MAT6-MAT8 + SET1 for every graph at once: (pair, side, node, embedding)
    and the spectrum of each graph that has one.  The number of jobs depends on
    the slowest graph, not on how many there are; a graph of rank one (after the
    discard rule) is left out of both.  See ``spectral_embedding``.
    """
    if discard not in DISCARD_MODES:
        raise ValueError(f"discard must be one of {DISCARD_MODES}")
    ensure_checkpoint_dir(graphs.nodes.sparkSession)
    r = width or embedding_width(k)
    deflate = discard == "trivial"
    wanted = r - 1 if deflate else r
    states = {p: _Iteration(wanted, oversample, s.small - 1 if deflate else s.small, deflate, basis)
              for p, s in graphs.sizes.items()}
    active = [p for p, s in states.items() if s.b > 0]
    if not active:
        graphs.release()
        return None, {}
    step = dict(broadcast_bytes=broadcast_bytes, min_hot_rows=min_hot_rows)

    def only(df: DataFrame, pairs: list[int], every: int) -> DataFrame:
        return df if len(pairs) == every else df.where(F.col("pair").isin(pairs))

    init = only(graphs.small_nodes(), active, len(graphs.sizes))
    frame = _start(init, {p: states[p].b for p in active}, seed)
    plan = {p: states[p].start(g) for p, g in _grams(frame).items()}
    found, parts, it = {}, [], 0
    while active:
        it += 1
        state = _combined(frame, plan)
        b = max(states[p].b_new for p in active)
        image = graphs.normal(state.select("id", *_columns(b)), b, active, **step)
        image = image.select("id", F.array(*[f"f{j}" for j in range(b)]).alias("y"))
        frame = (state.join(image, "id").select(
            "pair", "id", "t", F.concat("k", "f").alias("k"),
            F.concat("z", F.slice("y", F.lit(1), F.size("f"))).alias("z")).checkpoint(eager=True))
        grams = _grams(frame)
        for p in active:
            states[p].step(grams[p], tol, rank_tol)
        ended = [p for p in active if states[p].done or states[p].exhausted or it >= max_iter]
        late = [p for p in ended if not (states[p].done or states[p].exhausted)]
        if late and require_converged:
            worst = states[late[0]]
            raise RuntimeError(f"the decomposition has not converged after {it} steps: residuals "
                               f"{worst.residual[:wanted].tolist()} are over {tol}; raise max_iter or tol")
        chosen = {p: states[p].chosen(discard, r, rank_tol) for p in ended}
        real = [p for p in ended if chosen[p]]
        for p in real:
            s = states[p]
            found[p] = Spectrum([float(s.sigma[i]) for i in chosen[p]], [float(s.residual[i]) for i in chosen[p]],
                                it, p not in late)
        if real:
            parts.append(_combined(only(frame, real, len(active)), {p: states[p].vectors(chosen[p]) for p in real})
                         .select("pair", "id", "f"))
        if ended:
            frame = only(frame, [p for p in active if p not in ended], len(active))
            active = [p for p in active if p not in ended]
        plan = {p: states[p].extended() for p in active}

    if not found:
        graphs.release()
        return None, {}
    # at most one part for each step at which a graph ended
    V = parts[0]
    for part in parts[1:]:
        V = V.unionAll(part)
    V = V.checkpoint(eager=True)
    w = max(s.width for s in found.values())
    half = F.size("f") / 2
    right = V.select("id", *[F.when(half > j, F.get("f", (half + j).cast("int"))).otherwise(0.0).alias(f"f{j}")
                             for j in range(w)])
    U = graphs.half(right, False, w, list(found), **step).checkpoint(eager=True)
    vectors = (V.select("id", F.slice("f", F.lit(1), half.cast("int")).alias("x"))
               .unionByName(U.select("id", F.array(*[f"f{j}" for j in range(w)]).alias("x"))))
    widths = F.create_map(*[F.lit(x) for p, s in found.items() for x in (p, s.width)])
    # scaled by d^-1/2 and stacked, rows over columns (SET1)
    scaled = scale(F.slice("x", F.lit(1), F.element_at(widths, F.col("pair"))), 1 / F.sqrt("d"))
    emb = (vectors.join(only(graphs.nodes, list(found), len(graphs.sizes)), "id")
           .select("pair", "side", "node", scaled.alias("embedding")))
    # the result reads checkpointed blocks, never the cached edges
    graphs.release()
    return emb, found


def spectral_embedding(edges: DataFrame | None, k: int = 5, *, graph: Graphs | None = None,
                       **options) -> SpectralResult:
    """MAT6-MAT8 + SET1: joint embedding of row and column nodes of one graph.

    ``width`` is the number of singular triplets requested, r = 1 + ceil(log2 k)
    by default (MAT5).  ``discard`` picks which one is not used:

    * ``'trivial'`` (default): the known leading triplet is deflated exactly and
      r - 1 vectors are computed;
    * ``'first'`` / ``'last'``: r vectors without deflation, drop the largest /
      the smallest (the latter is what the reference's code does, Q1);
    * ``'none'``: r vectors without deflation, all kept.

    ``basis`` is the number of blocks (wanted + ``oversample`` vectors each) the
    basis holds before it restarts.
    """
    graph = graph or normalized_graph(edges)
    emb, found = spectral_embeddings(graph, k, **options)
    if not found:
        raise RankOneGraph("the graph has rank 1 after the discard rule; no embedding to compute")
    (s,), (size,) = found.values(), graph.sizes.values()
    return SpectralResult(emb.select("side", "node", "embedding"), s.sigma, s.iterations, s.width,
                          size.m + size.n, s.residuals, s.converged)
