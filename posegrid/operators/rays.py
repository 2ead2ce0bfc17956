"""Ray samples: spacing, compositing, importance sampling and losses."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rand
from ..session import materialize
from .ordered import lag_by_index, percentiles, prefix_sum
from .skew import ROWS_PER_TASK, small_table


def jitter_bounds(samples: DataFrame, keys=("ray_id",), index: str = "k", block: int = 1 << 18) -> DataFrame:
    """Interval of each sample between the midpoints to its neighbours, ends clamped."""
    s = lag_by_index(samples, keys, index, {"_lo": ("z", 1), "_hi": ("z", -1)}, block)
    lower = F.coalesce(0.5 * (F.col("z") + F.col("_lo")), F.col("z"))
    upper = F.coalesce(0.5 * (F.col("_hi") + F.col("z")), F.col("z"))
    return s.withColumn("lower", lower).withColumn("upper", upper).drop("_lo", "_hi")


def jitter(samples: DataFrame, keys=("ray_id",), index: str = "k", seed: int = 0) -> DataFrame:
    """One stratified draw per sample inside its interval."""
    u = rand.uniform(*keys, index, seed=seed)
    b = jitter_bounds(samples, keys, index)
    return b.withColumn("z", F.col("lower") + (F.col("upper") - F.col("lower")) * u).drop("lower", "upper")


def composite_weights(samples: DataFrame, keys=("ray_id",), index: str = "k", beta: float = 10.0, block: int = 1 << 18, length: int | None = None) -> DataFrame:
    """Front-to-back weights: alpha times the transmittance of all earlier samples. ``length``, where known, bounds the rows of a ray."""
    alpha = g.sdf_to_alpha(F.col("sdf"), beta)
    s = samples.withColumn("alpha", alpha)
    s = prefix_sum(s, keys, index, {"_log_t": F.log(1.0 - F.col("alpha") + 1e-10)}, block=block, length=length)
    return s.withColumn("w", F.col("alpha") * F.exp("_log_t")).drop("_log_t")


def composite(samples: DataFrame, keys=("ray_id",), index: str = "k", beta: float = 10.0, columns=("r", "g", "b"), n_logits: int = 0, block: int = 1 << 18) -> DataFrame:
    """Rendered depth, colours and class logits per ray."""
    w = composite_weights(samples, keys, index, beta, block)
    aggs = [F.sum(F.col("w") * F.col("z")).alias("depth")] + [F.sum(F.col("w") * F.col(c)).alias(c) for c in columns]
    if n_logits:
        aggs.append(F.array(*[F.sum(F.col("w") * F.col("logits")[i]) for i in range(n_logits)]).alias("logits"))
    return w.groupBy(*keys).agg(*aggs)


def cdf_bins(bins: DataFrame, keys=("ray_id",), index: str = "k", block: int = 1 << 18, length: int | None = None) -> DataFrame:
    """Bins with their cumulative weight interval.

    Bin ``k`` runs from position ``z_k`` to ``z_(k+1)`` and carries ``weight`` of node ``k``. Weights
    are used as they are, so the last cumulative value need not be 1; the last node is the open
    end and has no width.
    """
    b = lag_by_index(bins, keys, index, {"z_hi": ("z", -1)}, block)
    return prefix_sum(b, keys, index, {"cdf_lo": F.coalesce("weight", F.lit(0.0))}, block=block, length=length).withColumn(
        "cdf_hi", F.when(F.col("z_hi").isNotNull(), F.col("cdf_lo") + F.col("weight"))
    )


def _even_draws(n: int) -> Column:
    """Numbers of the evenly spaced uniforms that may fall into a bin; null where none can."""
    step = 1.0 / max(n - 1, 1)
    lo = F.floor(F.least(F.col("cdf_lo"), F.lit(2.0)) / step).cast("long") - 1
    hi = F.floor(F.least(F.coalesce("cdf_hi", F.lit(1.0)), F.lit(1.0)) / step).cast("long") + 1
    first, last = F.greatest(lo, F.lit(0).cast("long")), F.least(hi, F.lit(n - 1).cast("long"))
    return F.when(first <= last, F.sequence(first, last))


def _owns(u: Column) -> Column:
    return (u >= F.col("cdf_lo")) & (F.col("cdf_hi").isNull() | (u < F.col("cdf_hi")))


def _placed(u: Column) -> Column:
    """Position of a uniform inside its bin."""
    width = F.col("cdf_hi") - F.col("cdf_lo")
    t = (u - F.col("cdf_lo")) / F.when(width < 1e-5, 1.0).otherwise(width)
    return F.when(F.col("z_hi").isNull(), F.col("z")).otherwise(F.col("z") + t * (F.col("z_hi") - F.col("z")))


def sample_pdf(bins: DataFrame, n: int, keys=("ray_id",), index: str = "k", deterministic: bool = True, seed: int = 0, block: int = 1 << 18) -> DataFrame:
    """Inverse-CDF samples: each uniform goes to the last bin starting at or below it.

    ``bins`` has one row per node with ``z`` and the weight of the bin after it (the weight of the
    last node is ignored). Instead of joining uniforms to bins by range, every bin generates the
    uniforms that fall into its own interval, so nothing is joined at all when uniforms are evenly
    spaced; random uniforms are bucketed by the same evenly spaced grid.
    """
    keys = list(keys)
    c = cdf_bins(bins, keys, index, block)
    # Ties: a zero-weight bin shares its start with the next one and the later bin wins.
    owner = (F.col("cdf_hi") > F.col("cdf_lo")) | F.col("cdf_hi").isNull()
    c = c.filter(owner)
    if deterministic:
        c = c.withColumn("j", F.explode(_even_draws(n))).withColumn("u", F.col("j") / F.lit(float(max(n - 1, 1))))
        c = c.filter(_owns(F.col("u")))
    else:
        lo_b = F.floor(F.least(F.col("cdf_lo"), F.lit(1.0)) * n).cast("long")
        hi_b = F.floor(F.least(F.coalesce("cdf_hi", F.lit(1.0)), F.lit(1.0)) * n).cast("long")
        spread = c.withColumn("_b", F.explode(F.sequence(lo_b, F.greatest(hi_b, lo_b))))
        rays = bins.select(*keys).distinct()
        draws = rays.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        draws = draws.withColumn("u", rand.uniform(*keys, "j", seed=seed)).withColumn("_b", F.floor(F.col("u") * n).cast("long"))
        c = draws.join(spread, keys + ["_b"]).filter(_owns(F.col("u")))
    return c.select(*keys, "j", "u", _placed(F.col("u")).alias("sample"))


def depth_samples(rays: DataFrame, n_free: int = 32, n_surface: int = 8, truncation: float = 0.06, keys=("ray_id",)) -> DataFrame:
    """Sorted depths of rays with a measurement: free space 0..1.2 d and surface d -/+ 1.5 t."""
    d = F.col("depth")

    def line(n: int, lo: Column, hi: Column) -> Column:
        last = max(n - 1, 1)
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * (i / F.lit(float(last))))

    z = F.array_sort(F.concat(line(n_free, F.lit(0.0), 1.2 * d), line(n_surface, d - 1.5 * truncation, d + 1.5 * truncation)))
    return rays.filter(d > 0).select(*keys, F.posexplode(z).alias("k", "z"))


def overlap_samples(rays: DataFrame, n: int = 8, keep=("ray_id",)) -> DataFrame:
    """Depths 0.8 d .. d + 0.5 along measured rays."""
    near, far = F.col("depth") * 0.8, F.col("depth") + 0.5
    t = F.col("k") / F.lit(float(n - 1))
    return (
        rays.filter(F.col("depth") > 0)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(*keep, "k", (near * (1.0 - t) + far * t).alias("z"))
    )


def bands(truncation: float) -> dict[str, Column]:
    z, d, tr = F.col("z"), F.col("depth"), truncation
    front = z < d - tr
    back = z > d + tr
    centre = (z > d - 0.4 * tr) & (z < d + 0.4 * tr)
    return {"front": front, "centre": centre, "tail": ~front & ~back & ~centre}


def sdf_loss_columns(truncation: float, weights=(5.0, 200.0, 10.0)) -> list[Column]:
    b = bands(truncation)
    sdf, z, d = F.col("sdf"), F.col("z"), F.col("depth")
    near = z + sdf * truncation - d
    fs = F.avg(F.when(b["front"], (sdf - 1.0) * (sdf - 1.0)))
    centre = F.avg(F.when(b["centre"], near * near))
    tail = F.avg(F.when(b["tail"], near * near))
    return [
        fs.alias("fs_loss"), centre.alias("center_loss"), tail.alias("tail_loss"),
        (weights[0] * fs + weights[1] * centre + weights[2] * tail).alias("sdf_loss"),
    ]


def sdf_losses(samples: DataFrame, truncation: float = 0.06, keys=(), weights=(5.0, 200.0, 10.0)) -> DataFrame:
    """Free-space, centre and tail losses in one pass; an empty band gives NULL."""
    return samples.groupBy(*keys).agg(*sdf_loss_columns(truncation, weights))


def cross_entropy(logits: Column, label: Column) -> Column:
    """log(sum exp) - logit[label], shifted by the maximum; NULL where the label is -1."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(label >= 0, F.log(total) + top - F.get(logits, label))


def image_losses(pixels: DataFrame, keys=()) -> DataFrame:
    """Colour mean square, depth mean square over measured pixels and feature mean absolute error."""
    c, d = F.col("gt_c") - F.col("est_c"), F.col("gt_depth") - F.col("est_depth")
    return pixels.groupBy(*keys).agg(
        F.avg(c * c).alias("color_loss"), F.avg(F.when(F.col("gt_depth") > 0, d * d)).alias("depth_loss"), F.avg(F.abs(c)).alias("feature_loss")
    )


def median_error_mask(rays: DataFrame, keys, error: str, factor: float = 10.0, rows_per_block: int | None = None) -> DataFrame:
    """Rays whose error is under ``factor`` times the lower median error of their group."""
    kw = {} if rows_per_block is None else {"rows_per_block": rows_per_block}
    med = percentiles(rays, keys, error, {"_med": 0.5}, lower=True, **kw)
    return rays.join(small_table(med), list(keys)).filter(F.col(error) < factor * F.col("_med")).drop("_med")


def unmeasured_samples(rays: DataFrame, lo, hi, n: int = 32, keys=("ray_id",), carry=()) -> DataFrame:
    """Evenly spaced depths from 0 to the box exit, for rays without depth (``ox..oz, dx..dz``); NULL depth counts as none."""
    far = g.box_exit(g.vec("ox", "oy", "oz"), g.vec("dx", "dy", "dz"), lo, hi)
    t = F.col("k") / F.lit(float(max(n - 1, 1)))
    return (
        rays.filter(F.coalesce(F.col("depth") <= 0, F.lit(True)))
        .withColumn("far", far)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(*keys, "k", (F.col("far") * t).alias("z"), *carry)
    )


RAY_COLUMNS = ("ox", "oy", "oz", "dx", "dy", "dz")


def chained_samples(
    rays: DataFrame, lo, hi, field: Callable[[DataFrame], DataFrame], n: int = 32, n_importance: int = 8, keys=("ray_id",), beta: float = 10.0, deterministic: bool = True, seed: int = 0
) -> DataFrame:
    """Sorted depths of rays without a measurement: ``n`` samples to the box exit, and ``n_importance`` where their weights say that the
    surface is.

    ``field`` adds ``sdf`` to samples at px, py, pz (a join with a lattice, or any expression). A ray has ``n + n_importance`` rows at most,
    so rays are dealt to tasks once, and all that follows (weights, bins, draws, numbering) is small windows inside a task: no sample is
    written or shuffled, unless the field does. Without ``deterministic`` the coarse samples are jittered and the fine ones drawn.
    """
    keys = list(keys)
    blind = materialize(rays.filter(F.coalesce(F.col("depth") <= 0, F.lit(True))).select(*keys, "depth", *RAY_COLUMNS), "rays")
    spark = rays.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(blind.count() * (n + n_importance) / ROWS_PER_TASK))
    coarse = unmeasured_samples(blind.repartition(tasks, *keys), lo, hi, n, keys, RAY_COLUMNS)
    if not deterministic:
        coarse = jitter(coarse, keys, seed=seed)
    at = g.add(g.vec(*RAY_COLUMNS[:3]), g.scale(g.vec(*RAY_COLUMNS[3:]), F.col("z")))
    coarse = field(coarse.withColumns(dict(zip(("px", "py", "pz"), at)))).select(*keys, "k", "z", "sdf")
    # every sample carries the bin that starts at the midpoint behind it, and hands on what is drawn there
    c = cdf_bins(_nodes(coarse, keys, "k", beta, n).withColumnRenamed("z", "_z").withColumnRenamed("_mid", "z"), keys, "k", length=n)
    owner = F.col("z").isNotNull() & ((F.col("cdf_hi") > F.col("cdf_lo")) | F.col("cdf_hi").isNull())
    j, none = F.col("_j"), F.array().cast("array<bigint>")
    if deterministic:
        numbers, u = _even_draws(n_importance), j / F.lit(float(max(n_importance - 1, 1)))
    else:
        numbers, u = F.sequence(F.lit(0).cast("long"), F.lit(n_importance - 1).cast("long")), rand.uniform(*keys, "_j", seed=seed + 1)
    # -1 is the sample itself
    drawn = c.withColumn("_j", F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.coalesce(F.when(owner, numbers), none)))).withColumn("_u", u)
    place = F.when(j < 0, F.col("_z")).otherwise(_placed(F.col("_u")))
    merged = drawn.filter((j < 0) | _owns(F.col("_u"))).select(*keys, place.alias("z"), (j >= 0).alias("fine"), F.when(j < 0, F.col("k")).otherwise(j).alias("k"))
    order = Window.partitionBy(*keys).orderBy("z", "fine", "k")
    return merged.withColumn("k", F.row_number().over(order) - 1).select(*keys, "k", "z", "fine")


def _nodes(samples: DataFrame, keys, index: str, beta: float, length: int | None = None) -> DataFrame:
    """Composited samples with ``_mid``, the midpoint to the next one (null for the last), and ``weight``, the next inner sample's."""
    w = composite_weights(samples, keys, index, beta, length=length)
    s = lag_by_index(w, keys, index, {"_z1": ("z", -1), "_w1": ("w", -1), "_z2": ("z", -2)})
    return s.select(*keys, index, "z", (0.5 * (F.col("z") + F.col("_z1"))).alias("_mid"), F.when(F.col("_z2").isNotNull(), F.col("_w1")).alias("weight"))


def importance_bins(samples: DataFrame, keys=("ray_id",), index: str = "k", beta: float = 10.0) -> DataFrame:
    """Nodes for ``sample_pdf`` from composited samples: midpoints as nodes, the weights of the
    inner samples as bin weights."""
    s = _nodes(samples, keys, index, beta).filter(F.col("_mid").isNotNull())
    return s.select(*keys, index, F.col("_mid").alias("z"), "weight")
