"""From candidate buckets to confirmed links, without a list of all pairs.

A bucket says that its members may be linked to each other.  Only what can still
matter is compared on full sets:

1. *Stars.*  The three smallest members of a bucket are paired with all others of
   it, and leave it.  A large group of near copies becomes one component here for
   three comparisons a member, and buckets of up to four are done.
2. *Tiles.*  Of the other buckets those are open that still hold several
   components.  Of more than one block, those around a common member are one where
   that takes fewer rows: a family of near copies is in many buckets with mostly the
   same members, and is cut up once.  Buckets are cut into blocks, the members of
   one large component in blocks of their own, and each pair of blocks is a tile,
   but for two blocks of the same component.  A tile gives a spanning forest of its
   links.

Before sets are sent anywhere, exact bounds drop what cannot be linked: the sizes
alone, the place of a common value in the global order (``pos``: with a value at
the places i and j as their first common one, two sets share at most
min(n - i, m - j) values), and the counts of their values in cells.  So sets
travel almost only where links are.

Stars and blocks hold at most about ``block`` sets, so no group is held whole
in a task; hot members are spread over tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobi.llm.common import partitions, saved
from cobi.llm.graph import components
from cobi.llm.shingles import folded

BLOCK = 128
BLOCK_VALUES = 1_000_000

_LINKS = "u long, v long"


def overlaps(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Intersection sizes of all sets of a tile, from the values that several share."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    doc, column = doc[keep], (np.cumsum(shared) - 1)[column[keep]]
    both = np.zeros((n, n), dtype=np.float64)
    total, step = int(shared.sum()), 4096
    for at in range(0, total, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        x = np.zeros((n, min(step, total - at)), dtype=np.float32)
        x[doc[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T  # counts of at most 4,096 are exact in float32
    return both


def forest(linked: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the groups of a tile's sets; ``linked`` is a matrix."""
    _, start = np.unique(group, return_inverse=True)
    root = list(range(int(start.max()) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        x, y = find(int(start[i])), find(int(start[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """Rows of a sorted stream, one batch slice of one tile at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tiles = batch.column("tile").to_numpy()
        lists = batch.column("shingles")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        rest = {c: batch.column(c).to_numpy() for c in ("role", "node", "component")}
        for i, tile in enumerate(tiles.tolist()):
            yield tile, {**{c: int(x[i]) for c, x in rest.items()}, "set": values[at[i]:at[i + 1]]}


def _links(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _stars(percent: int):
    """The first row of a tile is compared with each that follows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, centre, us, vs = None, None, [], []
        for name, row in _grouped(batches):
            if name != tile or row["role"] == 0:
                tile, centre = name, {**row, "set": np.sort(row["set"])}
                continue
            mine, other = centre["set"], row["set"]
            at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
            both = int((mine[at] == other).sum())
            if 100 * both >= percent * (len(mine) + len(other) - both) and centre["node"] != row["node"]:
                us.append(centre["node"])
                vs.append(row["node"])
            if len(us) > 10000:
                yield _links(us, vs)
                us, vs = [], []
        yield _links(us, vs)
    return run


def _tiles(percent: int):
    """All sets of a tile with role 0 and 1 across, or with each other if all have role 0.
    A link is given as that of the two components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, us, vs = None, [], [], []

        def close():
            if len(held) < 2:
                return
            sets = [r["set"] for r in held]
            first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            size = np.diff(first)
            both = overlaps(np.concatenate(sets), first)
            linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
            group = np.array([r["component"] for r in held])
            role = np.array([r["role"] for r in held])
            if role.any():
                linked &= role[:, None] < role[None, :]
            linked = np.triu(linked | linked.T, 1) & (group[:, None] != group[None, :])
            for i, j in forest(linked, group):
                us.append(held[i]["component"])
                vs.append(held[j]["component"])

        for name, row in _grouped(batches):
            if name != tile:
                close()
                tile, held = name, []
                if len(us) > 10000:
                    yield _links(us, vs)
                    us, vs = [], []
            held.append({**row, "set": row["set"].copy()})
        close()
        yield _links(us, vs)
    return run


def _allowed(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    most = np.minimum(a, b).sum(axis=-1)
    return 100 * most >= percent * (n + m - most)


def _likely_pairs(percent: int):
    """The pairs whose cells allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("cells").to_pylist(), batch.column("other").to_pylist()
            width = np.array([min(len(x), len(y)) if x and y else 0 for x, y in zip(a, b, strict=True)], dtype=np.int64)
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            keep = width == 0
            for w in np.unique(width[~keep]).tolist():
                at = np.flatnonzero(width == w)
                keep[at] = _allowed(folded([a[i] for i in at], w), folded([b[i] for i in at], w), n[at], m[at], percent)
            yield batch.select(["centre", "node"]).filter(pa.array(keep))
    return run


def _allowed_matrix(cells: list[bytes | None], n: np.ndarray, percent: int, asked: np.ndarray) -> np.ndarray:
    """Which of the ``asked`` pairs of a tile (a symmetric matrix) their cells allow,
    compared in the coarser cells of the two."""
    width = np.array([len(c) if c else 0 for c in cells], dtype=np.int64)
    fits = asked.copy()
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width >= w)
        x = folded([cells[i] for i in at.tolist()], w)
        for i in np.flatnonzero(width[at] == w).tolist():
            other = np.flatnonzero(asked[at[i], at])
            if len(other):
                row = _allowed(x[i], x[other], n[at[i]], n[at[other]], percent)
                fits[at[i], at[other]] = row
                fits[at[other], at[i]] = row
    return fits


def _met_before(rows: pa.RecordBatch) -> np.ndarray:
    """Which pairs of a tile share an open bucket of a smaller number: these meet there."""
    bucket, column = rows.column("bucket")[0].as_py(), rows.column("buckets")
    values, limits = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    row = np.repeat(np.arange(rows.num_rows), np.diff(limits))
    values = values[limits[0]:limits[-1]]
    row, values = row[values < bucket], values[values < bucket]
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count[at] > 1     # of the others no pair can share one
    row, at = row[several], (np.cumsum(count > 1) - 1)[at[several]]
    total = int((count > 1).sum())
    both = np.zeros((rows.num_rows, rows.num_rows), dtype=np.float32)
    for lo in range(0, total, 4096):
        own = (at >= lo) & (at < lo + 4096)
        x = np.zeros((rows.num_rows, min(4096, total - lo)), dtype=np.float32)
        x[row[own], at[own] - lo] = 1
        both += x @ x.T
    return both > 0


def _likely_members(percent: int):
    """The rows (tile, role, node, component) of tiles that have a partner in
    another component which their cells allow, and which they do not meet in an
    earlier bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def close():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            n, role, group = (rows.column(c).to_numpy() for c in ("n", "role", "component"))
            # two sets share the smaller one at most
            fits = ((group[:, None] != group[None, :])
                    & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])))
            if role.any():
                fits &= role[:, None] != role[None, :]
            for step in (lambda rows, n, fits: ~_met_before(rows),
                         lambda rows, n, fits: _allowed_matrix(rows.column("cells").to_pylist(), n, percent, fits)):
                keep = fits.any(axis=1)
                if not keep.any():
                    break
                rows, n, fits = rows.filter(pa.array(keep)), n[keep], fits[np.ix_(keep, keep)]
                fits &= step(rows, n, fits)
            return rows.filter(pa.array(fits.any(axis=1))).select(["tile", "role", "node", "component"])

        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            limits = np.flatnonzero(np.append(True, tiles[1:] != tiles[:-1])) if len(tiles) else []
            for lo, hi in zip(limits, [*limits[1:], len(tiles)], strict=True):
                if tiles[lo] != tile:
                    if held:
                        yield close()
                    tile, held = tiles[lo], []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close()
    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile", "role", "node")


def _compared(places: DataFrame, run, name: str) -> DataFrame:
    """Links found by ``run`` in tiles; places is (tile, role, node, component, shingles)."""
    return saved(_dealt(places).mapInArrow(run, _LINKS), name)


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, own, n, component) of the buckets that hold several
    components; components only grow, so the others are settled."""
    now = saved(buckets.join(labels, "node", "left").select(
        "bucket", "node", "own", "n", F.coalesce("component", "node").alias("component")), "labelled")
    several = saved(now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                              F.max("own").alias("any"))
                    .where("lo != hi and any").select("bucket"), "several")
    return saved(now.join(several, "bucket"), "open")


def _weight(block: int, block_values: int):
    """Of a row: a large set counts for several."""
    return F.ceil(F.col("n") * F.lit(block / block_values))


def _merged(left: DataFrame, block: int, block_values: int) -> DataFrame:
    """``left`` with large buckets around a common member put together.

    A bucket of more than one block goes to its member that is in most such
    buckets, its hub.  The buckets of a hub become one with all their members, so
    that each pair of a bucket still meets, if the members times the blocks of that
    one are fewer than theirs apart."""
    rows, blocks = F.count("*"), F.ceil(F.sum(_weight(block, block_values)) / block)
    large = saved(left.groupBy("bucket").agg(blocks.alias("blocks")).where("blocks > 1").select("bucket"), "large")
    if large.isEmpty():
        return left
    wide = saved(left.join(large, "bucket", "left_semi"), "wide")
    each = F.count("*").over(Window.partitionBy("node"))
    hubs = saved(wide.withColumn("each", each).groupBy("bucket").agg(
        F.max_by("node", F.struct("each", -F.col("node"))).alias("hub"), (rows * blocks).alias("apart")), "hubs")
    around = saved(wide.join(hubs.select("bucket", "hub"), "bucket").groupBy("hub", "node").agg(
        F.max("own").alias("own"), F.first("n").alias("n"), F.first("component").alias("component")), "families")
    fewer = saved(around.groupBy("hub").agg((rows * blocks).alias("whole"))
                  .join(hubs.groupBy("hub").agg(F.sum("apart").alias("apart")), "hub")
                  .where("whole < apart").select("hub"), "fewer")
    gone = saved(hubs.join(fewer, "hub", "left_semi").select("bucket"), "gone")
    whole = around.join(fewer, "hub", "left_semi").withColumn("bucket", F.xxhash64(F.lit("hub"), "hub")).drop("hub")
    return saved(left.join(gone, "bucket", "left_anti").unionByName(whole), "open")


def _star_pairs(buckets: DataFrame, percent: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(centre, node, n, m) to compare, and the buckets without their centres, the
    ``rounds`` smallest own nodes of each.  A centre is paired with all but the
    centres before it."""
    # Spark keeps the first rows of a bucket before the shuffle already
    first = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
    centres = saved(buckets.where("own").withColumn("r", first).where(F.col("r") <= rounds).groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct(F.col("node").alias("centre"), F.col("n").alias("m"),
                                             F.col("pos").alias("at")))).alias("centres")), "centres")
    # place: of a centre, from 1; 0 of the others
    around = saved(buckets.join(centres, "bucket")
                   .withColumn("place", F.array_position("centres.centre", F.col("node"))), "around")
    found = around.select("node", "n", "pos", "place", F.posexplode("centres").alias("before", "c")).select(
        "node", "n", "pos", "place", "before", "c.*").where("place = 0 or before + 1 < place")
    # what the sizes and places allow: 100 * overlap >= percent * (n + m - overlap)
    most = "least(n - pos, m - at)"
    pairs = (found.where(f"{100 + percent} * {most} >= {percent} * (n + m)")
             .groupBy("centre", "node").agg(F.first("n").alias("n"), F.first("m").alias("m")))
    return saved(pairs, "pairs"), around.where("place = 0").select("bucket", "node", "own", "n", "pos")


def confirmed_links(buckets: DataFrame, cells: DataFrame, with_sets: Callable[[DataFrame], DataFrame], percent: int, *,
                    rounds: int = 3, block: int = BLOCK, block_values: int = BLOCK_VALUES,
                    done: dict | None = None) -> DataFrame:
    """(u, v) that join just the nodes linked, directly or over others, by pairs of ``buckets``.

    buckets: (bucket long, node long, own boolean, n long, pos long), a written
    table without repeated rows; n is the size of the node's set.  A pair of a
    bucket counts if one of its two is ``own``, and ``pos`` holds if no earlier
    value of the two sets is common to them (0 where there is no order).  cells:
    (node, cells binary) of all nodes.  ``with_sets`` adds the column shingles
    (array<long>) to a table of nodes; a row may come several times.  Two sets are linked when 100 *
    |intersection| >= percent * |union|.  ``done`` collects the number of pairs and
    tiles compared.
    """
    pairs, rest = _star_pairs(buckets, percent, rounds)
    near = (pairs.join(cells.hint("merge"), "node")
            .join(cells.select(F.col("node").alias("centre"), F.col("cells").alias("other")).hint("merge"), "centre"))
    pairs = saved(near.mapInArrow(_likely_pairs(percent), "centre long, node long"), "likely")
    if done is not None:
        done["stars"] = pairs.count()
    spread = saved(pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts")), "spread")
    tile = F.xxhash64("centre", "part")
    none = F.lit(-1).cast("long").alias("component")
    members = pairs.join(spread, "centre").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).select(
        tile.alias("tile"), F.lit(1).alias("role"), "node", none)
    centres = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        tile.alias("tile"), F.lit(0).alias("role"), F.col("centre").alias("node"), none)
    links = _compared(with_sets(saved(members.unionByName(centres), "places")), _stars(percent), "stars")

    # from here on a component is a star around its smallest node, and tiles join those
    labels = components(links, "stars")
    links = labels.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    left = _open(rest, labels)
    if left.isEmpty():
        return links
    left = _merged(left, block, block_values)
    listed = saved(left.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
                   .join(cells.hint("merge"), "node"), "listed")
    # a row takes along only the buckets in which a pair of its tile can have met before
    places = _blocks(left, block, block_values, done).join(listed, "node").select(
        "tile", "bucket", "role", "node", "component", "n", "cells",
        F.filter("buckets", lambda other: other < F.col("bucket")).alias("buckets"))
    places = saved(_dealt(places).mapInArrow(_likely_members(percent), "tile long, role int, node long, component long"),
                   "members")
    if places.isEmpty():
        return links
    return links.unionAll(_compared(with_sets(places), _tiles(percent), "tiles"))


def _blocks(left: DataFrame, block: int, block_values: int, done: dict | None) -> DataFrame:
    """The tiles of the buckets that are left: (tile, bucket, role, node, component, n)."""
    rows = left.withColumn("w", _weight(block, block_values))
    share = rows.groupBy("bucket", "component").agg(F.sum("w").alias("s"))
    share = saved(share.select("bucket", "component", F.when(F.col("s") * 2 > block, F.ceil(F.col("s") / block))
                               .otherwise(0).alias("pieces"), "s"), "shares")
    mixed = saved(share.groupBy("bucket").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("pieces") == 0, F.col("s"))) / block)).alias("mixed")), "mixed")
    pure = F.col("pieces") > 0
    placed = (rows.join(share.select("bucket", "component", "pieces"), ["bucket", "component"]).join(mixed, "bucket")
              .select("bucket", "node", "component", "own", "n",
                      F.when(pure, F.col("component")).otherwise(-1).alias("of"),
                      F.when(pure, F.pmod(F.xxhash64("node"), "pieces"))
                      .otherwise(F.pmod(F.xxhash64("component"), "mixed")).alias("piece")))
    placed = saved(placed, "placed")
    cells = saved(placed.groupBy("bucket", "of", "piece").agg(F.max("own").alias("own")), "blocks")
    x = cells.select("bucket", F.struct("of", "piece").alias("a"), F.col("own").alias("own_a"))
    y = cells.select("bucket", F.struct("of", "piece").alias("b"), F.col("own").alias("own_b"))
    # pairs of blocks, of the bounded size of a block: not of members
    tiles = x.join(y, "bucket").where("a <= b and (own_a or own_b) and (a.of != b.of or a.of = -1)")
    tiles = saved(tiles.select("bucket", "a", "b", F.xxhash64("bucket", "a", "b").alias("tile")), "tiles")
    if done is not None:
        done["tiles"] = done.get("tiles", 0) + tiles.count()
    side = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(f"{c}.of").alias("of"), F.col(f"{c}.piece").alias("piece"))
    both = F.when(F.col("a") == F.col("b"), F.array(side(0, "a"))).otherwise(F.array(side(0, "a"), side(1, "b")))
    sides = saved(tiles.select("bucket", "tile", F.explode(both).alias("s")).select("bucket", "tile", "s.*"), "sides")
    return placed.join(sides, ["bucket", "of", "piece"]).select(
        "tile", "bucket", "role", "node", "component", "n")
