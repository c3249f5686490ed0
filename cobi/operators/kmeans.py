"""Lloyd's k-means for many runs, and many point sets, over shared passes (CLU1).

The reference asks for the best of ten runs.  Here all runs of all point sets
(``pair``) go through the data together: one pass assigns every point to the
nearest centre of each run and sums the clusters, and the driver moves the
centres.  The first centres come from k-means|| (two rounds of oversampling,
then weighted k-means++ on the few candidates), also in shared passes.  A run
that has settled leaves the passes.

A pass is one job: sums of each partition, merged in about sqrt(P) tasks.  The
driver holds centres and cluster sums, runs x k x width numbers a point set.
Random draws are hashes of the point, the run and the round, so that results do
not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U64 = np.uint64
_CELLS = 1 << 21    # distances held at a time
_SUMS = "pair int, run int, g array<double>"
_PICKS = "pair int, run int, h long, x array<double>"


@dataclass
class Fit:
    centres: np.ndarray    # (clusters, width)
    cost: float            # sum of squared distances to these centres
    run: int
    steps: int
    costs: list[float]     # of every run


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A second hash of 64-bit hashes."""
    x = x ^ _U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def _uniform(h: np.ndarray, seed: int, run: int, round_: int) -> np.ndarray:
    return (_mix(h, (seed << 20) + run * 64 + round_) >> _U64(11)).astype(np.float64) / float(1 << 53)


def _points(batch: pa.RecordBatch, pairs) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(pair, hashes, vectors) of the rows of the given point sets."""
    own = batch.column("pair").to_numpy(zero_copy_only=False)
    order = np.argsort(own, kind="stable")
    limits = np.flatnonzero(np.diff(own[order], prepend=-1 if not len(own) else own[order[0]] - 1))
    for lo, hi in zip(limits, [*limits[1:], len(order)], strict=True):
        if int(own[order[lo]]) in pairs:
            rows = batch.take(pa.array(order[lo:hi]))
            x = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            yield int(own[order[lo]]), rows.column("h").to_numpy(zero_copy_only=False).view(_U64), x


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest of the centres."""
    label, dist = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    step = max(1, _CELLS // max(1, centres.size))
    for at in range(0, len(x), step):
        d = ((x[at:at + step, None, :] - centres[None]) ** 2).sum(axis=2)
        label[at:at + step] = d.argmin(axis=1)
        dist[at:at + step] = d.min(axis=1)
    return label, dist


def _rows(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in sums], pa.int32()), pa.array([r for _, r in sums], pa.int32()),
         pa.array([g.ravel() for g in sums.values()], pa.list_(pa.float64()))], names=["pair", "run", "g"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for batch in batches:
        for p, r, g in zip(batch.column("pair").to_pylist(), batch.column("run").to_pylist(), batch.column("g"), strict=True):
            g = g.values.to_numpy()
            sums[p, r] = sums[p, r] + g if (p, r) in sums else g.copy()
    if sums:
        yield _rows(sums)


def _pass(points: DataFrame, centres: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """For each (pair, run): (clusters, width + 2) of the sums, the number and
    the cost of the points nearest to each centre; one job."""
    runs: dict[int, list[int]] = {}
    for p, r in centres:
        runs.setdefault(p, []).append(r)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for p, _, x in _points(batch, runs):
                for r in runs[p]:
                    c = centres[p, r]
                    label, dist = _nearest(x, c)
                    cells = np.stack([np.bincount(label, weights=w, minlength=len(c))
                                      for w in (*x.T, np.ones(len(x)), dist)], axis=1)
                    sums[p, r] = sums[p, r] + cells if (p, r) in sums else cells
        if sums:
            yield _rows(sums)

    rows = points.select("pair", "h", "embedding").mapInArrow(partial, _SUMS)
    merge = math.isqrt(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if merge > 4:
        rows = rows.repartition(merge).mapInArrow(_merged, _SUMS)
    out: dict = {}
    for p, r, g in zip(*rows.toArrow().to_pydict().values(), strict=True):
        g = np.array(g).reshape(len(centres[p, r]), -1)
        out[p, r] = out[p, r] + g if (p, r) in out else g
    return out


def _picked(points: DataFrame, pick) -> dict[tuple[int, int], np.ndarray]:
    """The points that ``pick`` (pair, h, x) -> [(run, indexes)] takes of each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, h, x in _points(batch, pick.pairs):
                for r, at in pick(p, h, x):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * len(at), pa.int32()), pa.array([r] * len(at), pa.int32()),
                         pa.array(h[at].view(np.int64)), pa.array(list(x[at]), pa.list_(pa.float64()))],
                        names=["pair", "run", "h", "x"])
    out: dict = {}
    for row in points.select("pair", "h", "embedding").mapInArrow(run, _PICKS).collect():
        out.setdefault((row.pair, row.run), []).append((row.h, row.x))
    return {key: np.array([x for _, x in sorted(found, key=lambda f: f[0])]) for key, found in out.items()}


def _first_picks(points: DataFrame, pairs: list[int], runs: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """The point with the smallest draw of each run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for p, h, x in _points(batch, set(pairs)):
                for r in range(runs):
                    u = _mix(h, (seed << 20) + r * 64)
                    i = int(u.argmin())
                    if (p, r) not in best or u[i] < best[p, r][0]:
                        best[p, r] = u[i], x[i]
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in best], pa.int32()), pa.array([r for _, r in best], pa.int32()),
                 pa.array([int(np.int64(u >> _U64(1))) for u, _ in best.values()], pa.int64()),
                 pa.array([x for _, x in best.values()], pa.list_(pa.float64()))], names=["pair", "run", "h", "x"])
    out: dict = {}
    # one row for each partition and run
    for row in points.select("pair", "h", "embedding").mapInArrow(run, _PICKS).collect():
        key = row.pair, row.run
        if key not in out or (row.h, row.x) < out[key]:
            out[key] = row.h, row.x
    return {key: np.array([x]) for key, (_, x) in out.items()}


class _Oversample:
    """k-means||: points far from the candidates so far, each by its own draw."""

    def __init__(self, centres: dict, cost: dict, k: int, seed: int, round_: int):
        self.centres, self.cost, self.k, self.seed, self.round = centres, cost, k, seed, round_
        self.pairs = {p for p, _ in centres}

    def __call__(self, pair, h, x):
        for (p, r), c in self.centres.items():
            if p == pair and self.cost[p, r] > 0:
                _, dist = _nearest(x, c)
                at = np.flatnonzero(_uniform(h, self.seed, r, self.round) < 2 * self.k * dist / self.cost[p, r])
                if len(at):
                    yield r, at


def _plus_plus(found: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ and 30 Lloyd steps on the candidates: the first centres."""
    if len(found) <= k:
        return found
    chosen = [int(rng.choice(len(found), p=weight / weight.sum()))]
    dist = ((found - found[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (weight * dist).sum() > 0:
        chosen.append(int(rng.choice(len(found), p=weight * dist / (weight * dist).sum())))
        dist = np.minimum(dist, ((found - found[chosen[-1]]) ** 2).sum(axis=1))
    c = found[chosen].copy()
    for _ in range(30):
        label, _ = _nearest(found, c)
        total = np.bincount(label, weights=weight, minlength=len(c))
        full = total > 0
        for j in range(found.shape[1]):
            c[full, j] = np.bincount(label, weights=weight * found[:, j], minlength=len(c))[full] / total[full]
    return c


def fit_runs(points: DataFrame, pairs: list[int], k: int, *, runs: int = 10, max_iter: int = 300, seed: int = 0,
             tol: float = 1e-4, init_steps: int = 2) -> dict[int, Fit]:
    """Best of ``runs`` fits of each point set of ``points`` (pair int, h long: a
    hash of the point, embedding array<double>: of one length in a point set)."""
    centres = _first_picks(points, pairs, runs, seed)
    for s in range(1, init_steps + 1):
        cost = {key: float(g[:, -1].sum()) for key, g in _pass(points, centres).items()}
        more = _picked(points, _Oversample(centres, cost, k, seed, s))
        centres = {key: np.concatenate([c, more[key]]) if key in more else c for key, c in centres.items()}
    centres = {key: np.unique(c, axis=0) for key, c in centres.items()}
    weights = _pass(points, centres)
    centres = {(p, r): _plus_plus(c, np.maximum(weights[p, r][:, -2], 1e-300), k, np.random.default_rng([seed, p, r]))
               for (p, r), c in sorted(centres.items())}

    done: dict[tuple[int, int], tuple[float, int]] = {}
    step = 0
    while len(done) < len(centres):
        step += 1
        for key, g in _pass(points, {key: c for key, c in centres.items() if key not in done}).items():
            old, count = centres[key], g[:, -2]
            new = np.where(count[:, None] > 0, g[:, :-2] / np.maximum(count, 1)[:, None], old)
            if ((new - old) ** 2).sum(axis=1).max() <= tol * tol or step > max_iter:
                done[key] = float(g[:, -1].sum()), step      # the cost is that of the centres it was measured with
            else:
                centres[key] = new
    out = {}
    for p in {p for p, _ in centres}:
        costs = [done[p, r][0] for r in range(runs)]
        r = min(range(runs), key=lambda r: (costs[r], r))
        out[p] = Fit(centres[p, r], costs[r], r, done[p, r][1], costs)
    return out
