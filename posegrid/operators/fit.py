"""Closed-form fits and direction votes; per group only sums leave the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import linalg
from ..functions import rand
from .ordered import percentiles
from .skew import small_table

AX = ("x", "y", "z")


def weighted_moments(pairs: DataFrame, keys, weight: Column | None = None) -> DataFrame:
    """Weighted means and centred second moments of point pairs ``sx..sz -> dx..dz``.

    Two passes: the means first, then sums about them, so large coordinates do not cancel.
    Columns: n, w, ms*, md*, c<d><s> (nine, destination x source), vs.
    """
    keys = list(keys)
    p = pairs.withColumn("_w", F.lit(1.0) if weight is None else weight)
    w = F.col("_w")
    means = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("w"),
        *[F.sum(w * F.col(s + a)).alias(f"m{s}{a}") for s in "sd" for a in AX],
    )
    total = F.col("w") + 1e-12
    means = means.select(*keys, "n", "w", *[(F.col(f"m{s}{a}") / total).alias(f"m{s}{a}") for s in "sd" for a in AX])
    m = p.join(small_table(means), keys)
    wn = w / total
    sc = {a: F.col("s" + a) - F.col("ms" + a) for a in AX}
    dc = {a: F.col("d" + a) - F.col("md" + a) for a in AX}
    sums = m.groupBy(*keys).agg(
        *[F.sum(wn * dc[a] * sc[b]).alias(f"c{a}{b}") for a in AX for b in AX],
        F.sum(wn * (sc["x"] * sc["x"] + sc["y"] * sc["y"] + sc["z"] * sc["z"])).alias("vs"),
    )
    return means.join(sums, keys)


def solve_similarity(moments: DataFrame, with_scaling: bool = True, least: int = 3) -> DataFrame:
    """Rotation, scale and translation from the moments; groups under ``least`` pairs get NULL."""
    cov = F.array(*[F.col(f"c{a}{b}") for a in AX for b in AX])
    m = moments.withColumn("_r", F.when(F.col("n") >= least, linalg.best_rotation(cov)))
    rot = [[F.col("_r")[3 * i + j] for j in range(3)] for i in range(3)]
    s = F.col("_r")[9] / (F.col("vs") + 1e-12) if with_scaling else F.when(F.col("_r").isNotNull(), 1.0)
    m = m.withColumn("scale", s)
    scaled = [[x * F.col("scale") for x in row] for row in rot]
    t = g.sub(g.vec("mdx", "mdy", "mdz"), g.mat_vec(scaled, g.vec("msx", "msy", "msz")))
    return m.withColumns(
        {f"m{i}{j}": scaled[i][j] for i in range(3) for j in range(3)} | {f"t{i}": t[i] for i in range(3)}
    ).drop("_r")


def umeyama(pairs: DataFrame, keys, weight: Column | None = None, with_scaling: bool = True, least: int = 3) -> DataFrame:
    cols = list(keys) + ["n", "w", "scale"] + [f"m{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    return solve_similarity(weighted_moments(pairs, keys, weight), with_scaling, least).select(*cols)


def scale_translation(moments: DataFrame, with_scaling: bool = True) -> DataFrame:
    """Scale and translation when the rotation is already applied to the source; no Python."""
    num = F.col("cxx") + F.col("cyy") + F.col("czz")
    s = num / (F.col("vs") + 1e-12) if with_scaling else F.lit(1.0)
    m = moments.withColumn("scale", s)
    return m.withColumns({f"t{i}": F.col("md" + a) - F.col("scale") * F.col("ms" + a) for i, a in enumerate(AX)})


# -- directions -----------------------------------------------------------------------------


def direction_counts(cloud: DataFrame, keys) -> DataFrame:
    """Distinct unit normals with counts: copies are counted once before any voting."""
    n = g.unit(g.vec("nx", "ny", "nz"))
    u = cloud.select(*keys, n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"))
    return u.groupBy(*keys, "nx", "ny", "nz").agg(F.count(F.lit(1)).alias("n"))


def draw_hypotheses(cloud: DataFrame, keys, iters: int, order: Column) -> DataFrame:
    """``iters`` normals per key, the lowest by ``order``, which must tell rows apart, not normals; numbered from 0 in that order."""
    n = g.unit(g.vec("nx", "ny", "nz"))
    rows = cloud.select(*keys, order.alias("_o"), n[0].alias("hx"), n[1].alias("hy"), n[2].alias("hz"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("_o", "hx", "hy", "hz")
    # a plain limit on the row number, so that tasks cut their own rows before the shuffle
    return rows.withColumn("h", F.row_number().over(w)).filter(F.col("h") <= iters).withColumn("h", F.col("h") - 1).drop("_o")


def weighted_hypotheses(normals: DataFrame, keys, iters: int) -> DataFrame:
    """``iters`` distinct normals per key (all, if fewer), drawn with chances in proportion to their counts ``n``.

    Each normal has one exponential draw of rate ``n`` and the lowest win, so copies raise a chance and never fill several slots.
    """
    draw = -F.log(F.greatest(rand.uniform("nx", "ny", "nz"), F.lit(1e-300))) / F.col("n")
    named = normals.select(*keys, draw.alias("_d"), F.col("nx").alias("hx"), F.col("ny").alias("hy"), F.col("nz").alias("hz"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("_d", "hx", "hy", "hz")
    return named.withColumn("h", F.row_number().over(w)).filter(F.col("h") <= iters).withColumn("h", F.col("h") - 1).drop("_d")


def axis_votes(normals: DataFrame, hypotheses: DataFrame, keys, thresh_deg: float) -> DataFrame:
    """Inliers per hypothesis. The hypotheses per key are at most the iteration count, and the
    counts combine inside the joining stage, so the shuffle carries one row per hypothesis."""
    keys = list(keys)
    cos_t = math.cos(math.radians(thresh_deg))
    d = F.abs(g.dot(g.vec("nx", "ny", "nz"), g.vec("hx", "hy", "hz")))
    return (
        normals.join(small_table(hypotheses), keys)
        .groupBy(*keys, "h", "hx", "hy", "hz")
        .agg(F.sum(F.when(d > cos_t, F.col("n")).otherwise(0)).alias("inliers"))
    )


def robust_axis(cloud: DataFrame, keys, thresh_deg: float = 5.0, iters: int = 1000, order: Column | None = None) -> DataFrame:
    """Dominant sign-free axis per key: best voted hypothesis, then the principal axis of its inliers."""
    keys = list(keys)
    normals = direction_counts(cloud, keys)
    hyp = weighted_hypotheses(normals, keys, iters) if order is None else draw_hypotheses(cloud, keys, iters, order)
    votes = axis_votes(normals, hyp, keys, thresh_deg)
    best = votes.groupBy(*keys).agg(F.max_by(F.struct("hx", "hy", "hz"), F.struct("inliers", -F.col("h"))).alias("b")).select(*keys, "b.*")
    cos_t = math.cos(math.radians(thresh_deg))
    inl = normals.join(small_table(best), keys).filter(F.abs(g.dot(g.vec("nx", "ny", "nz"), g.vec("hx", "hy", "hz"))) > cos_t)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = inl.groupBy(*keys).agg(*[F.sum(F.col("n") * F.col("n" + a) * F.col("n" + b)).alias(a + b) for a, b in pairs], F.sum("n").alias("inliers"))
    v = linalg.largest_eigenvector(*[F.col(a + b) for a, b in pairs])
    return sums.withColumn("_v", v).select(*keys, *[F.col("_v")[i].alias(c) for i, c in enumerate(("ax", "ay", "az"))], "inliers")


def gravity_axis(cloud: DataFrame, keys, thresh_deg: float = 5.0, iters: int = 1000, order: Column | None = None) -> DataFrame:
    """Upward axis from floor (3) and ceiling (5) normals, oriented so the ceiling is above.

    Keys without floor and ceiling points are absent from the result; ``physical_registration`` gives their runs a row and a status.
    """
    keys = list(keys)
    flat = cloud.filter(F.col("label").isin(3, 5))
    axis = robust_axis(flat, keys, thresh_deg, iters, order)
    p, a = g.vec("x", "y", "z"), g.vec("ax", "ay", "az")
    floor = F.col("label") == 3
    heights = flat.join(small_table(axis), keys).groupBy(*keys).agg(
        F.avg(F.when(~floor, g.dot(p, a))).alias("ceil_h"), F.avg(F.when(floor, g.dot(p, a))).alias("floor_h"),
        F.avg(F.when(floor, g.dot(g.vec("nx", "ny", "nz"), a))).alias("floor_n"),
    )
    flip = F.when(F.col("ceil_h").isNotNull() & F.col("floor_h").isNotNull(), F.col("ceil_h") < F.col("floor_h")).when(
        F.col("floor_h").isNotNull(), F.col("floor_n") < 0
    ).otherwise(False)
    sign = F.when(flip, -1.0).otherwise(1.0)
    return axis.join(heights, keys).select(*keys, *[(F.col(c) * sign).alias(c) for c in ("ax", "ay", "az")])


def yaw_direction(cloud: DataFrame, up: DataFrame, keys, bins: int = 360) -> DataFrame:
    """Manhattan yaw: wall-normal angles modulo 90 degrees, first fullest bin, bin centre.

    ``up`` has one row ``ax, ay, az`` per key. Adds ``bin, votes`` and the direction ``wx, wy, wz``.
    """
    keys = list(keys)
    a = g.vec("ax", "ay", "az")
    n = g.vec("nx", "ny", "nz")
    walls = cloud.filter(F.col("label") == 1).join(small_table(up), keys)
    flat = g.sub(n, g.scale(a, g.dot(n, a)))
    e1, e2 = g.horizontal_basis(a)
    width = math.pi / 2 / bins
    ang = F.pmod(F.atan2(g.dot(g.unit(flat), e2), g.dot(g.unit(flat), e1)), F.lit(math.pi / 2))
    votes = (
        walls.filter(g.norm(flat) > 0.3)
        .select(*keys, F.least(F.floor(ang / width), F.lit(bins - 1)).cast("long").alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    top = votes.groupBy(*keys).agg(F.max(F.struct("votes", -F.col("bin"))).alias("b")).select(*keys, (-F.col("b.col2")).alias("bin"), F.col("b.votes").alias("votes"))
    phi = F.col("bin") * width + width / 2
    out = up.join(top, keys)
    w = g.unit(g.add(g.scale(e1, F.cos(phi)), g.scale(e2, F.sin(phi))))
    return out.withColumns({"wx": w[0], "wy": w[1], "wz": w[2]})


def canonical_frame(yaw: DataFrame, keys) -> DataFrame:
    """Rows (wall-x, wall-y, up) of the canonical rotation as ``k00..k22``."""
    rows = g.canonical_rows(g.vec("ax", "ay", "az"), g.vec("wx", "wy", "wz"))
    return yaw.select(*keys, *g.named(rows, "k"))


def yaw_candidates(src_frame: DataFrame, dst_frame: DataFrame, keys, dst_keys=None) -> DataFrame:
    """The four rotations that align the frames, ``candidate`` 0..3 (0 is the primary)."""
    keys = list(keys)
    s = src_frame.select(*keys, *[F.col(f"k{i}{j}").alias(f"a{i}{j}") for i in range(3) for j in range(3)])
    both = s.join(dst_frame, list(dst_keys or keys)).withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(3))))
    quarter = g.rot_z(F.col("candidate") * (math.pi / 2))
    r = g.mat_mul(g.mat_mul(g.transpose(g.mat("k")), quarter), g.mat("a"))
    return both.select(*keys, "candidate", *g.named(r, "r"))


# -- structural seeds -------------------------------------------------------------------------


def axis_spans(cloud: DataFrame, frame: DataFrame, keys, rows_per_block: int | None = None, cloud_keys=None) -> DataFrame:
    """Robust centre and extent along wall-x, wall-y (walls) and up (floor and ceiling).

    ``frame`` has ``k00..k22`` per key; it may hold several frames per cloud, which is then keyed by
    ``cloud_keys``. Axes with fewer than ten points are NULL.
    """
    keys = list(keys)
    p = g.vec("x", "y", "z")
    m = g.mat("k")
    wall, flat = F.col("label") == 1, F.col("label").isin(3, 5)
    joined = cloud.filter(F.col("label").isin(1, 3, 5)).join(small_table(frame), list(cloud_keys or keys))
    long = joined.select(
        *keys,
        F.explode(
            F.when(wall, F.array(*[F.struct(F.lit(i).alias("axis"), g.dot(m[i], p).alias("proj")) for i in (0, 1)]))
            .when(flat, F.array(F.struct(F.lit(2).alias("axis"), g.dot(m[2], p).alias("proj"))))
        ).alias("e"),
    ).select(*keys, "e.*")
    kw = {} if rows_per_block is None else {"rows_per_block": rows_per_block}
    spans = percentiles(long, keys + ["axis"], "proj", {"lo": 0.02, "hi": 0.98}, **kw)
    counts = long.groupBy(*keys, "axis").agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= 10
    return spans.join(counts, keys + ["axis"]).select(
        *keys, "axis", "n", F.when(ok, 0.5 * (F.col("lo") + F.col("hi"))).alias("centre"), F.when(ok, F.col("hi") - F.col("lo")).alias("extent")
    )


def struct_centroid(cloud: DataFrame, keys, structural=(1, 3, 5)) -> DataFrame:
    """Mean of the structural points, or of all points where there are none."""
    inside = F.col("label").isin(list(structural))
    return cloud.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(inside, F.col(a))), F.avg(a)).alias("c" + a) for a in AX])


def plane_seed(src_spans: DataFrame, dst_spans: DataFrame, src_c: DataFrame, dst_c: DataFrame, frame: DataFrame, keys, dst_keys=None) -> DataFrame:
    """Scale from extent ratios, translation from centroids overwritten per axis by span centres.

    ``frame`` holds the destination axes; spans and centroids of the source are in that frame.
    """
    keys = list(keys)
    dst_keys = list(dst_keys or keys)
    s = src_spans.select(*keys, "axis", F.col("centre").alias("sc"), F.col("extent").alias("se"))
    d = dst_spans.select(*dst_keys, "axis", F.col("centre").alias("dc"), F.col("extent").alias("de"))
    both = s.join(d, dst_keys + ["axis"])
    ratio = F.when((F.col("se") > 0.5) & (F.col("de") > 0.5), F.col("de") / F.col("se"))
    per = both.groupBy(*keys).agg(
        F.coalesce(F.least(F.greatest(F.median(ratio), F.lit(0.3)), F.lit(3.0)), F.lit(1.0)).alias("scale"),
        *[F.max(F.when(F.col("axis") == i, F.col(c))).alias(f"{c}{i}") for i in range(3) for c in ("sc", "dc")],
    )
    base = (
        src_c.select(*keys, *[F.col("c" + a).alias("s" + a) for a in AX])
        .join(dst_c.select(*dst_keys, *[F.col("c" + a).alias("d" + a) for a in AX]), dst_keys)
        .join(frame, dst_keys)
        .join(per, keys, "left")
        .withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    )
    m = g.mat("k")
    t = g.sub(g.vec("dx", "dy", "dz"), g.scale(g.vec("sx", "sy", "sz"), F.col("scale")))
    base = base.withColumns({f"t{i}": t[i] for i in range(3)})
    for i in range(3):
        e, cur = m[i], [F.col(f"t{k}") for k in range(3)]
        move = F.col(f"dc{i}") - F.col("scale") * F.col(f"sc{i}") - g.dot(cur, e)
        base = base.withColumns({f"t{k}": cur[k] + F.coalesce(move, F.lit(0.0)) * e[k] for k in range(3)})
    return base.select(*keys, "scale", "t0", "t1", "t2")
