"""Labelled point clouds: counts, label work, down-sampling, normals, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as L
from ..functions import linalg
from . import neighbors as nn
from .skew import small_table


def class_counts(cloud: DataFrame, class_dim: DataFrame, keys=()) -> DataFrame:
    """Points per class with the class name; classes without points are absent."""
    counts = cloud.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(class_dim.select("label", "name"), "label", "left")


def color_counts(colors: DataFrame, class_names: DataFrame | None = None) -> DataFrame:
    """Distinct colours with counts; only the distinct ones are classified against the palette."""
    c = colors.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("idx", L.nearest_color(F.col("r"), F.col("g"), F.col("b"), L.PALETTE52, "l1"))
    c = c.withColumn("class_id", L.palette_class(F.col("idx")))
    if class_names is None:
        return c
    return c.join(class_names, "class_id", "left").withColumn("name", F.coalesce("name", F.lit("?")))


def discover_labels(pixels: DataFrame, column: str) -> DataFrame:
    """Distinct raw labels in ascending order with a dense index; the distinct set is tiny."""
    values = pixels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    all_values = values.agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("raw"), "n"))).alias("a"))
    return all_values.select(F.posexplode("a").alias("idx", "v")).select("idx", "v.raw", "v.n")


def color_to_label(colors: DataFrame) -> DataFrame:
    """Nearest six-class colour. Sources whose largest channel is at most 1 are taken as 0..1."""
    top = colors.agg(F.greatest(F.max("r"), F.max("g"), F.max("b"))).first()[0]
    k = 255.0 if top is not None and top <= 1.0 + 1e-6 else 1.0
    return colors.withColumn("label", L.nearest_color(F.col("r") * k, F.col("g") * k, F.col("b") * k))


def subset(cloud: DataFrame, labels, strict: bool = False) -> DataFrame:
    """Keep the named classes; strict mode raises when nothing is left."""
    ids = [L.NAME_TO_ID[x] if isinstance(x, str) else int(x) for x in labels]
    out = cloud.filter(F.col("label").isin(ids))
    if strict and out.isEmpty():
        raise ValueError(f"no points of classes {ids}")
    return out


def common_classes(a: DataFrame, b: DataFrame, match=None, keys=()) -> DataFrame:
    cols = [*keys, "label"]
    out = a.select(*cols).distinct().intersect(b.select(*cols).distinct())
    return out if match is None else out.filter(F.col("label").isin(list(match)))


def transform_cloud(cloud: DataFrame, rot_scale: g.Mat, trans: g.Vec, with_normals: bool = True) -> DataFrame:
    """Points by the full similarity, normals by its rotation only."""
    p = g.apply_sim3(rot_scale, trans, g.vec("x", "y", "z"))
    out = {"x": p[0], "y": p[1], "z": p[2]}
    if with_normals and "nx" in cloud.columns:
        n = g.mat_vec(g.sim3_rotation(rot_scale), g.vec("nx", "ny", "nz"))
        out |= {"nx": n[0], "ny": n[1], "nz": n[2]}
    return cloud.withColumns(out)


def voxel_downsample(cloud: DataFrame, size: float, keys=(), per_class: bool = True) -> DataFrame:
    """Mean position (and unit mean normal) per occupied voxel; the lattice starts half a voxel
    below each class's minimum. Both aggregations combine before the shuffle."""
    group = [*keys, "label"] if per_class else list(keys)
    if not group:
        cloud, group = cloud.withColumn("_all", F.lit(0)), ["_all"]
    low = cloud.groupBy(*group).agg(*[F.min(a).alias("_" + a) for a in nn.XYZ])
    v = cloud.join(small_table(low), group)
    cells = [F.floor((F.col(a) - (F.col("_" + a) - size / 2)) / size).alias("v" + a) for a in nn.XYZ]
    has_normals = "nx" in cloud.columns
    aggs = [F.avg(a).alias(a) for a in nn.XYZ] + [F.count(F.lit(1)).alias("n")]
    if has_normals:
        aggs += [F.avg(a).alias(a) for a in ("nx", "ny", "nz")]
    out = v.groupBy(*group, *cells).agg(*aggs)
    if has_normals:
        length = g.norm(g.vec("nx", "ny", "nz"))
        out = out.withColumns({a: F.try_divide(F.col(a), length) for a in ("nx", "ny", "nz")})
    return out.drop("_all")


def neighborhood_covariance(cloud: DataFrame, radius: float | None, max_nn: int, keys=()) -> DataFrame:
    """Six covariance entries of each point's neighbourhood."""
    keys = list(keys)
    src = cloud.select(*keys, F.col("point_id").alias("src_id"), *nn.XYZ)
    dst = cloud.select(*keys, F.col("point_id").alias("dst_id"), *nn.XYZ)
    hood = nn.neighborhoods(src, dst, radius, max_nn, keys)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return hood.groupBy(*keys, "src_id").agg(
        *[F.covar_pop("d" + a, "d" + b).alias(f"c{a}{b}") for a, b in pairs], F.count(F.lit(1)).alias("n")
    )


def estimate_normals(cloud: DataFrame, radius: float, max_nn: int, keys=()) -> DataFrame:
    """Normals by local principal axes where missing; up to sign. Fewer than 3 neighbours give +z."""
    keys = list(keys)
    cov = neighborhood_covariance(cloud, radius, max_nn, keys)
    v = linalg.smallest_eigenvector(*[F.col("c" + ab) for ab in ("xx", "xy", "xz", "yy", "yz", "zz")])
    made = cov.withColumn("_v", F.when(F.col("n") >= 3, v).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))).select(
        *keys, F.col("src_id").alias("point_id"), *[F.col("_v")[i].alias(a) for i, a in enumerate(("nx", "ny", "nz"))]
    )
    return cloud.drop("nx", "ny", "nz").join(made, keys + ["point_id"], "left")


def _sides(a: DataFrame, b: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    return (
        a.select(*keys, F.col("point_id").alias("src_id"), *nn.XYZ),
        b.select(*keys, F.col("point_id").alias("dst_id"), *nn.XYZ),
    )


def cloud_distances(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """Distance of every point of ``a`` to the closest point of ``b``."""
    s, d = _sides(a, b, list(keys))
    return nn.nearest(s, d, keys).select(*keys, F.col("src_id").alias("point_id"), F.col("dst_id").alias("nearest_id"), F.sqrt("d2").alias("dist"))


def chamfer(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """Half the sum of the two mean nearest distances."""
    keys = list(keys)
    ab = cloud_distances(a, b, keys).withColumn("_dir", F.lit(0))
    ba = cloud_distances(b, a, keys).withColumn("_dir", F.lit(1))
    both = ab.unionByName(ba).groupBy(*keys).agg(
        F.avg(F.when(F.col("_dir") == 0, F.col("dist"))).alias("d_ab"), F.avg(F.when(F.col("_dir") == 1, F.col("dist"))).alias("d_ba")
    )
    return both.withColumn("chamfer", (F.col("d_ab") + F.col("d_ba")) / 2)


def reconstruction_scores(rec: DataFrame, gt: DataFrame, keys=(), threshold: float = 0.05) -> DataFrame:
    """Accuracy and completion in cm, completion ratio in percent (strict threshold)."""
    keys = list(keys)
    to_gt = cloud_distances(rec, gt, keys).select(*keys, F.col("dist").alias("acc"), F.lit(None).cast("double").alias("comp"))
    to_rec = cloud_distances(gt, rec, keys).select(*keys, F.lit(None).cast("double").alias("acc"), F.col("dist").alias("comp"))
    hit = F.when(F.col("comp").isNotNull(), (F.col("comp") < threshold).cast("double"))
    return to_gt.unionByName(to_rec).groupBy(*keys).agg(
        (F.avg("acc") * 100).alias("accuracy_cm"), (F.avg("comp") * 100).alias("completion_cm"), (F.avg(hit) * 100).alias("completion_ratio_pct")
    )


def class_inlier_ratio(src: DataFrame, dst: DataFrame, threshold: float, keys=(), grid: nn.Grid | None = None) -> DataFrame:
    """Share of source points of common classes with a same-class point strictly within reach.

    Only a gated search is needed: points without a hit count in the denominator alone.
    """
    keys = list(keys)
    by = keys + ["label"]
    shared = src.join(small_table(common_classes(src, dst, keys=keys)), by, "left_semi")
    s, d = _sides(shared, dst, by)
    zero = F.lit(0).cast("long")
    hits = nn.nearest(s, d, by, threshold, grid=grid).groupBy(*keys).agg(zero.alias("total"), F.count(F.lit(1)).alias("inliers"))
    total = shared.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), zero.alias("inliers"))
    out = total.unionByName(hits).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("inliers").alias("inliers"))
    return out.withColumn("ratio", F.col("inliers") / F.greatest(F.col("total"), F.lit(1)))


def scene_bound(points: DataFrame, keys=(), directions=None, factor: float = 1.02) -> DataFrame:
    """Axis box and support values per direction, enlarged by ``factor`` about the centre.

    A point lies inside when it satisfies every half-space, a superset of the convex hull.
    """
    keys = list(keys)
    directions = directions or SUPPORT_DIRECTIONS
    aggs = [f(a).alias(n + a) for a in nn.XYZ for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    p = g.vec("x", "y", "z")
    aggs += [F.max(g.dot([F.lit(float(c)) for c in d], p)).alias(f"s{i}") for i, d in enumerate(directions)]
    b = points.groupBy(*keys).agg(*aggs)
    centre = [(F.col("lo_" + a) + F.col("hi_" + a)) / 2 for a in nn.XYZ]
    grown = {}
    for i, d in enumerate(directions):
        c = g.dot([F.lit(float(x)) for x in d], centre)
        grown[f"s{i}"] = c + (F.col(f"s{i}") - c) * factor
    for a, c in zip(nn.XYZ, centre):
        grown["lo_" + a] = c + (F.col("lo_" + a) - c) * factor
        grown["hi_" + a] = c + (F.col("hi_" + a) - c) * factor
    return b.select(*keys, *[v.alias(k) for k, v in grown.items()])


# The 13 axes of a cube's faces, edges and corners, in both senses.
SUPPORT_DIRECTIONS = [
    (x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)
]


def within_bound(p: g.Vec, directions=None) -> Column:
    out = F.lit(True)
    for i, d in enumerate(directions or SUPPORT_DIRECTIONS):
        out = out & (g.dot([F.lit(float(c)) for c in d], p) <= F.col(f"s{i}"))
    return out


def best_per_key(df: DataFrame, keys, order: Column, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
