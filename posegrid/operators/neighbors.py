"""Exact nearest-neighbour joins on grid-cell keys.

The strategies share one contract. Every result is exact, ties go to the lowest destination id,
and no task ever sees all pairs of a dense region:

* ``gated`` search with cells as wide as the gate: the destination is copied to its 27 neighbour
  cells once and the join is an equi-join.  Used when a counted limit on points per cell holds.
* the single closest point without a gate, or in cells that are too full, comes from the packed tree
  of ``packed``, whose nodes hold equally many points whatever their density.
* several neighbours in too full cells come from a ``descent`` over cells halved level by level: a
  source cell keeps only the destination cells that can still hold one of its k nearest points.

Identical destination points are collapsed first, so a pile of copies counts once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import packed
from .skew import hot_keys, salted_join

XYZ = ("x", "y", "z")
CELL = ("cx", "cy", "cz")
LEAF_POINTS = 64
GATED_POINTS = 256
MAX_LEVEL = 40
RANK_BITS = 14  # 27 cells of at most GATED_POINTS points
START_CELL_PAIRS = 200_000
SMALL_INDEX = 20_000  # destinations whose 27 copies may be broadcast


@dataclass(frozen=True)
class Grid:
    """Cell sizes of a search: ``size`` at level 0, halved ``levels`` times; and the destinations, where they were counted."""

    size: float
    levels: int
    gated: bool
    points: int | None = None

    def width(self, level: int) -> float:
        return self.size / (1 << level)


def _cells(h: float, names=CELL) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(h)).alias(c) for a, c in zip(XYZ, names)]


def _occupancy(points: DataFrame, keys, h: float) -> tuple[int, int]:
    """Points in the fullest cell, and in all."""
    top, every = points.groupBy(*keys, *_cells(h)).count().agg(F.max("count"), F.sum("count")).first()
    return top or 0, every or 0


def _densest(points: DataFrame, keys, h: float) -> int:
    return _occupancy(points, keys, h)[0]


def _distinct_points(dst: DataFrame, keys, k: int) -> DataFrame:
    """Copies of one position collapse to the k lowest ids (one id when k is 1)."""
    if k == 1:
        return dst.groupBy(*keys, *XYZ).agg(F.min("dst_id").alias("dst_id"))
    w = Window.partitionBy(*keys, *XYZ).orderBy("dst_id")
    return dst.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def plan_grid(src: DataFrame, dst: DataFrame, keys=(), radius: float | None = None, k: int = 1, leaf: int | None = None) -> Grid:
    """Choose the strategy from counted cell occupancy.

    Runs a few small aggregation jobs; only single numbers come back to the driver.
    """
    keys = list(keys)
    leaf = leaf or max(LEAF_POINTS, 2 * k)
    spots = dst.select(*keys, *XYZ).distinct()
    if radius is not None:
        densest, points = _occupancy(spots, keys, radius)
        if densest <= GATED_POINTS:
            return Grid(radius, 0, True, points)
        size = radius
        level = 1
    else:
        ext = F.greatest(*[F.max(F.abs(F.col(a))) for a in XYZ])
        n, extent = spots.agg(F.count(F.lit(1)), ext).first()
        other = src.agg(ext).first()[0]
        extent = max(extent or 0.0, other or 0.0, 1e-9)
        size = 2.0 ** math.ceil(math.log2(extent * 1.0000001))
        level = max(0, math.ceil(math.log2(max(n / leaf, 1.0)) / 3.0))
    while level < MAX_LEVEL and _densest(spots, keys, size / (1 << level)) > leaf:
        level += 1
    return Grid(size, level, False)


def _gap2(level_h: float, prefix_a: str, prefix_b: str, far: bool) -> Column:
    total = None
    for c in CELL:
        d = F.abs(F.col(prefix_a + c) - F.col(prefix_b + c)).cast("double")
        g = (d + 1.0) if far else F.greatest(d - 1.0, F.lit(0.0))
        total = g * g if total is None else total + g * g
    return total * F.lit(level_h * level_h)


def _reach2(h: float) -> Column:
    """Furthest any point of the source cell can be from the destination cell's member point."""
    total = None
    for a, c in zip(XYZ, CELL):
        lo = F.col("s" + c).cast("double") * h
        r = F.col("_rep." + a)
        g = F.greatest(F.abs(r - lo), F.abs(lo + h - r))
        total = g * g if total is None else total + g * g
    return total


def _prune(cand: DataFrame, keys, h: float, k: int, radius: float | None) -> DataFrame:
    """Keep destination cells that can hold one of the k nearest points of some source in the cell."""
    src_cell = keys + ["s" + c for c in CELL]
    far = _reach2(h) if k == 1 else _gap2(h, "s", "d", True)
    c = cand.withColumn("_near", _gap2(h, "s", "d", False)).withColumn("_far", far)
    if radius is not None:
        c = c.filter(F.col("_near") <= radius * radius * (1 + 1e-12))
    if k == 1:
        bound = F.min("_far").over(Window.partitionBy(*src_cell))
    else:
        run = Window.partitionBy(*src_cell).orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)
        c = c.withColumn("_cum", F.sum("_n").over(run))
        bound = F.coalesce(
            F.min(F.when(F.col("_cum") >= k, F.col("_far"))).over(Window.partitionBy(*src_cell)), F.lit(float("inf"))
        )
    return c.withColumn("_bound", bound).filter(F.col("_near") <= F.col("_bound") * (1 + 1e-12))


def _level_cells(points: DataFrame, keys, h: float, levels: int, name: str) -> DataFrame:
    """Occupied cells of every level with point count and one member point, from one pass."""
    leaf = points.groupBy(*keys, *_cells(h)).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*XYZ)).alias("_rep"))
    up = leaf.withColumn("_lev", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select(
        *keys, "_lev", *[F.expr(f"shiftright({c}, {levels} - _lev)").alias(c) for c in CELL], "_n", "_rep"
    )
    cells = up.groupBy(*keys, "_lev", *CELL).agg(F.sum("_n").alias("_n"), F.min("_rep").alias("_rep"))
    return materialize(cells, name)


def _start_level(src_cells: DataFrame, dst_cells: DataFrame, keys) -> int:
    """Deepest level at which all cell pairs within the keys together stay under the limit."""
    per = [t.groupBy(*keys, "_lev").agg(F.count(F.lit(1)).alias(n)) for t, n in ((src_cells, "_a"), (dst_cells, "_b"))]
    sizes = per[0].join(per[1], [*keys, "_lev"]).groupBy("_lev").agg(F.sum(F.col("_a") * F.col("_b")).alias("pairs")).collect()
    return max([r["_lev"] for r in sizes if r["pairs"] <= START_CELL_PAIRS] + [0])


def _candidate_cells(src: DataFrame, dst: DataFrame, keys, grid: Grid, k: int, radius: float | None) -> DataFrame:
    """(keys, source cell, destination cell, sources in the cell) at the leaf level."""
    h = grid.width(grid.levels)
    src_cells = _level_cells(src, keys, h, grid.levels, "src_cells")
    dst_cells = _level_cells(dst, keys, h, grid.levels, "dst_cells")

    def at(level: int, cells: DataFrame, side: str) -> DataFrame:
        extra = ["_n", "_rep"] if side == "d" else [F.col("_n").alias("_sn")]
        return cells.filter(F.col("_lev") == level).select(*keys, *[F.col(c).alias(side + c) for c in CELL], *extra)

    start = 0 if radius is not None else _start_level(src_cells, dst_cells, keys)
    s0, d0 = at(start, src_cells, "s"), at(start, dst_cells, "d")
    if radius is not None:
        around = F.array(*[F.lit(float(o)).cast("long") for o in (-1, 0, 1)])
        near = s0
        for c in CELL:
            near = near.withColumn("_o", F.explode(around)).withColumn("d" + c, F.col("s" + c) + F.col("_o")).drop("_o")
        cand = near.join(d0, keys + ["d" + c for c in CELL])
    else:
        # Level 0 is as wide as the data (at most two cells per axis and key on either side); a
        # deeper start is taken only where the counted number of cell pairs stays small.
        cand = s0.withColumn("_one", F.lit(1)).join(d0.withColumn("_one", F.lit(1)), keys + ["_one"]).drop("_one")
    cand = _prune(cand, keys, grid.width(start), k, radius)
    for level in range(start + 1, grid.levels + 1):
        half = [F.shiftright(F.col("d" + c), 1).alias("p" + c) for c in CELL]
        kids_d = at(level, dst_cells, "d").select(*keys, *half, *["d" + c for c in CELL], "_n", "_rep")
        half = [F.shiftright(F.col("s" + c), 1).alias("q" + c) for c in CELL]
        kids_s = at(level, src_cells, "s").select(*keys, *half, *["s" + c for c in CELL], "_sn")
        parents = cand.select(*keys, *[F.col("s" + c).alias("q" + c) for c in CELL], *[F.col("d" + c).alias("p" + c) for c in CELL])
        cand = (
            parents.join(kids_s, keys + ["q" + c for c in CELL])
            .join(kids_d, keys + ["p" + c for c in CELL])
            .select(*keys, *["s" + c for c in CELL], *["d" + c for c in CELL], "_n", "_rep", "_sn")
        )
        cand = _prune(cand, keys, grid.width(level), k, radius)
        if (level - start) % 4 == 0 and level < grid.levels:
            cand = materialize(cand.select(*keys, *["s" + c for c in CELL], *["d" + c for c in CELL], "_n", "_rep", "_sn"), "cells")
    return materialize(cand.select(*keys, *["s" + c for c in CELL], *["d" + c for c in CELL], "_rep", "_sn"), "cells")


def _box_gap2(h: float):
    """Squared distance from the source point to a cell of the candidate array."""

    def f(cell) -> Column:
        total = None
        for a, c in zip(XYZ, CELL):
            lo = cell["d" + c].cast("double") * h
            g = F.greatest(lo - F.col("s" + a), F.col("s" + a) - (lo + h), F.lit(0.0))
            total = g * g if total is None else total + g * g
        return total

    return f


def _member_distance2(cell) -> Column:
    total = None
    for a in XYZ:
        g = cell["_rep"][a] - F.col("s" + a)
        total = g * g if total is None else total + g * g
    return total


def _d2() -> Column:
    parts = [F.col("s" + a) - F.col("d" + a) for a in XYZ]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def spread_destination(dst: DataFrame, keys, h: float) -> DataFrame:
    """Destination copied to the 27 cells it can be reached from."""
    around = F.array(*[F.lit(o).cast("long") for o in (-1, 0, 1)])
    out = dst.select(*keys, "dst_id", *[F.col(a).alias("d" + a) for a in XYZ], *_cells(h))
    for c in CELL:
        out = out.withColumn("_o", F.explode(around)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
    return out


def index_destination(dst: DataFrame, keys, grid: Grid) -> DataFrame:
    """The probe-ready form of a destination for gated search; worth caching when probed often.

    ``rank`` orders the points of a cell by id; the grid plan has counted that it stays small.
    """
    keys = list(keys)
    spread = spread_destination(_distinct_points(dst, keys, 1), keys, grid.size)
    w = Window.partitionBy(*keys, *CELL).orderBy("dst_id")
    return spread.withColumn("rank", F.row_number().over(w))


def _probe(src: DataFrame, keys, h: float, names=CELL) -> DataFrame:
    return src.select(*keys, "src_id", *[F.col(a).alias("s" + a) for a in XYZ], *_cells(h, names))


def probe_index(src: DataFrame, index: DataFrame, keys, grid: Grid, radius: float, inclusive: bool = False) -> DataFrame:
    """Closest destination per source from a gated index: one equi-join and a grouping on the
    join's own partitioning.

    Distance and rank are packed into one long (48 bits of the squared distance relative to the
    gate, then the rank), so the minimum is unique and every aggregation buffer is a plain number:
    pairs flow from the join straight into the hash aggregation and are never sorted or stored.

    The planner knows the files that an index was read from, not its copies, and would broadcast millions of them through the driver;
    only an index counted as small is left to it.
    """
    keys = list(keys)
    if grid.points is None or grid.points > SMALL_INDEX:
        index = index.hint("merge")
    pairs = _probe(src, keys, grid.size).join(index, keys + list(CELL))
    pairs = pairs.withColumn("d2", _d2()).filter(F.col("d2") <= radius * radius)
    order = F.floor(F.col("d2") * (float(1 << 48) / (radius * radius))) * (1 << RANK_BITS) + F.col("rank")
    pairs = pairs.withColumn("_o", order)
    best = pairs.groupBy(*keys, *CELL, "src_id", "sx", "sy", "sz").agg(
        F.min_by("dst_id", "_o").alias("dst_id"), *[F.min_by("d" + a, "_o").alias("d" + a) for a in XYZ]
    )
    out = best.withColumn("d2", _d2()).select(*keys, "src_id", "dst_id", "d2", "dx", "dy", "dz")
    return out.filter(_gate(radius, inclusive))


def _leaf_probe(src: DataFrame, dst: DataFrame, keys, grid: Grid, k: int, radius: float | None):
    """Sources exploded to the leaf cells that can hold their neighbours, and hot leaf cells."""
    h = grid.width(grid.levels)
    cand = _candidate_cells(src, dst, keys, grid, k, radius)
    s_key, d_key = keys + ["s" + c for c in CELL], ["d" + c for c in CELL]
    by_src = cand.groupBy(*s_key).agg(F.collect_list(F.struct(*d_key, "_rep")).alias("_cells"))
    hot_src = hot_keys(cand.groupBy(*s_key).agg(F.max("_sn").alias("count")), s_key)
    refs = cand.groupBy(*keys, *[F.col(d).alias(c) for d, c in zip(d_key, CELL)]).agg(F.sum("_sn").alias("count"))
    hot_dst = hot_keys(refs, keys + list(CELL))
    probe = salted_join(_probe(src, keys, h, ["s" + c for c in CELL]), by_src, s_key, [F.col("src_id")], hot_src)
    cells = F.col("_cells")
    near = _box_gap2(h)
    if k == 1:
        probe = probe.withColumn("_far", F.array_min(F.transform(cells, _member_distance2)) * (1 + 1e-12))
        cells = F.filter(cells, lambda c: near(c) <= F.col("_far"))
    if radius is not None:
        cells = F.filter(cells, lambda c: near(c) <= radius * radius * (1 + 1e-12))
    probe = probe.withColumn("_c", F.explode(cells)).select(
        *keys, "src_id", *["s" + a for a in XYZ], *[F.col(f"_c.d{c}").alias(c) for c in CELL]
    )
    # The join multiplies rows, so its partition count must not shrink with the input bytes.
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return probe.repartition(parts, *keys, *CELL), hot_dst


def _leaves(dst: DataFrame, keys, h: float) -> DataFrame:
    return dst.select(*keys, "dst_id", *[F.col(a).alias("d" + a) for a in XYZ], *_cells(h))


def _pairs(src: DataFrame, dst: DataFrame, keys, grid: Grid, k: int, radius: float | None) -> DataFrame:
    """Candidate (source, destination) pairs that contain every true neighbour."""
    if grid.gated:
        return _probe(src, keys, grid.size).join(spread_destination(dst, keys, grid.size), keys + list(CELL)).drop(*CELL)
    probe, hot = _leaf_probe(src, dst, keys, grid, k, radius)
    leaves = _leaves(dst, keys, grid.width(grid.levels))
    return salted_join(probe, leaves, keys + list(CELL), [F.col("src_id")], hot).drop(*CELL)


def _gate(radius: float | None, inclusive: bool) -> Column:
    if radius is None:
        return F.lit(True)
    return F.col("d2") <= radius * radius if inclusive else F.sqrt("d2") < radius


def nearest(src: DataFrame, dst: DataFrame, keys=(), radius: float | None = None, inclusive: bool = False, grid: Grid | None = None) -> DataFrame:
    """Closest destination of every source within the same keys.

    ``src`` has ``keys, src_id, x, y, z`` and ``dst`` has ``keys, dst_id, x, y, z``; the result has
    ``keys, src_id, dst_id, d2, dx, dy, dz``. With a radius, sources without a hit are absent.
    """
    keys = list(keys)
    grid = grid or (plan_grid(src, dst, keys, radius) if radius is not None else None)
    if grid is not None and grid.gated:
        return probe_index(src, index_destination(dst, keys, grid), keys, grid, radius, inclusive)
    return packed.nearest(src, dst, keys, radius).filter(_gate(radius, inclusive))


def neighborhoods(src: DataFrame, dst: DataFrame, radius: float | None, max_nn: int, keys=(), inclusive: bool = True, grid: Grid | None = None) -> DataFrame:
    """Up to ``max_nn`` nearest destinations of every source within ``radius``, closest first."""
    keys = list(keys)
    spots = _distinct_points(dst, keys, max_nn)
    grid = grid or plan_grid(src, dst, keys, radius, max_nn)
    pairs = _pairs(src, spots, keys, grid, max_nn, radius).withColumn("d2", _d2()).filter(_gate(radius, inclusive))
    w = Window.partitionBy(*keys, "src_id").orderBy("d2", "dst_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_nn).drop("sx", "sy", "sz")


TILE = 1 << 23  # distances held at a time


def _least(own, other, d2, n):
    """For each of ``n`` owners the partner at the least distance, the first one of several: its index and distance."""
    order = np.lexsort((other, d2, own))
    first = order[np.r_[True, np.diff(own[order]) != 0]]
    at, best = np.zeros(n, np.int64), np.full(n, np.inf)
    at[own[first]], best[own[first]] = other[first], d2[first]
    return at, best


def nearest_rows(u, v):
    """Index and squared distance of the nearest row of ``v`` for each row of ``u``, and of ``u`` for each of ``v``; ties go to the first row.

    Distances are sums of squared differences in double precision. A matrix product in single precision says how far rows are apart up to
    its rounding error; only pairs within that of a minimum are measured. Rows that it can't tell apart are all measured.
    """
    a, b = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", v, v)
    top = a.max() + b.max()
    slack = (4.0 * u.shape[1] + 64.0) * np.finfo(np.float32).eps * top + 1e-30
    rough = bool(np.isfinite(top) and top < 1e30)  # squares of longer rows leave single precision
    one = np.ones((len(v), 1))
    right = np.hstack([v, b[:, None], one]).astype(np.float32).T if rough else None
    rows, cols, away, ceiling = [], [], [], np.full(len(v), np.inf)
    step = max(1, TILE // len(v))
    for lo in range(0, len(u), step):
        p = u[lo : lo + step]
        near = None
        if rough:
            left = np.hstack([-2.0 * p, np.ones((len(p), 1)), a[lo : lo + step, None]]).astype(np.float32)
            d = left @ right
            ceiling = np.minimum(ceiling, d.min(0))
            # in single precision a bound may round down: the slack covers twice the error
            near = np.flatnonzero((d <= (d.min(1) + slack)[:, None]) | (d <= ceiling + slack))
        if near is None or len(near) > 16 * (len(p) + len(v)):
            d = np.empty((len(p), len(v)))
            for i in range(len(p)):
                gap = v - p[i]
                d[i] = np.einsum("ij,ij->i", gap, gap)
            i, j = d.argmin(1), d.argmin(0)
            own, other = np.r_[np.arange(len(p)), j], np.r_[i, np.arange(len(v))]
            exact = d[own, other]
        else:
            own, other = np.divmod(near, len(v))
            exact = np.empty(len(own))
            for k in range(0, len(own), 1 << 15):
                gap = v[other[k : k + (1 << 15)]] - p[own[k : k + (1 << 15)]]
                exact[k : k + (1 << 15)] = np.einsum("ij,ij->i", gap, gap)
        rows.append(own + lo), cols.append(other), away.append(exact)
    own, other, exact = np.concatenate(rows), np.concatenate(cols), np.concatenate(away)
    return _least(own, other, exact, len(u)), _least(other, own, exact, len(v))


def mutual_nearest_features(a: DataFrame, b: DataFrame, keys=(), rows_per_block: int = 8192) -> DataFrame:
    """Pairs that are each other's nearest vector: ``keys, a_id, b_id, d2``.

    High-dimensional vectors do not prune on grids, so both tables are cut into blocks; block pairs are spread over the cluster and each
    yields only its per-row minima, never its pairs (see ``nearest_rows``). Of equal vectors only the one with the lowest id can be
    anybody's nearest, so only that one takes part.
    """
    import pandas as pd

    keys = list(keys)

    def blocks(df: DataFrame, side: str) -> DataFrame:
        df = df.groupBy(*keys, "vec").agg(F.min(f"{side}_id").alias(f"{side}_id"))
        df = materialize(df, "vectors")
        n = max(1, -(-df.count() // rows_per_block))
        return df.select(*keys, f"{side}_id", F.col("vec").alias(f"{side}_vec")).withColumn(
            f"{side}_blk", F.pmod(F.xxhash64(f"{side}_id"), F.lit(n)).cast("int")
        )

    ab, bb = blocks(a, "a"), blocks(b, "b")
    na = ab.agg(F.max("a_blk")).first()[0] or 0
    nb = bb.agg(F.max("b_blk")).first()[0] or 0
    left = ab.withColumn("b_blk", F.explode(F.sequence(F.lit(0), F.lit(nb))))
    right = bb.withColumn("a_blk", F.explode(F.sequence(F.lit(0), F.lit(na))))
    group = keys + ["a_blk", "b_blk"]
    key_types = ", ".join(f"`{k}` {a.schema[k].dataType.simpleString()}" for k in keys)
    head = f"{key_types}, " if keys else ""

    def minima(key, x, y):
        if not len(x) or not len(y):
            return pd.DataFrame({**{k: [] for k in keys}, "side": [], "own": [], "other": [], "d2": []})
        x, y = x.sort_values("a_id"), y.sort_values("b_id")
        u, v = np.array(x["a_vec"].tolist(), dtype=float), np.array(y["b_vec"].tolist(), dtype=float)
        (j, near), (i, back) = nearest_rows(u, v)
        out = pd.concat(
            [
                pd.DataFrame({"side": 0, "own": x["a_id"].to_numpy(), "other": y["b_id"].to_numpy()[j], "d2": near}),
                pd.DataFrame({"side": 1, "own": y["b_id"].to_numpy(), "other": x["a_id"].to_numpy()[i], "d2": back}),
            ]
        )
        for n, k in enumerate(keys):
            out[k] = key[n]
        return out[[*keys, "side", "own", "other", "d2"]]

    parts = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
        minima, f"{head}side int, own long, other long, d2 double"
    )
    best = parts.groupBy(*keys, "side", "own").agg(
        F.min_by(F.struct("other", "d2"), F.struct("d2", "other")).alias("_b")
    )
    best = materialize(best, "minima")  # read for each direction
    fwd = best.filter("side = 0").select(*keys, F.col("own").alias("a_id"), F.col("_b.other").alias("b_id"), F.col("_b.d2").alias("d2"))
    bwd = best.filter("side = 1").select(*keys, F.col("own").alias("b_id"), F.col("_b.other").alias("a_id"))
    return fwd.join(bwd, keys + ["a_id", "b_id"])
