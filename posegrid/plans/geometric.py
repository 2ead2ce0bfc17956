"""Geometry-only registration: local shape histograms, mutual matches, scored hypotheses, refinement.

No labels are used. Neighbour pairs come from the grid search with at most ``feature_max_nn`` rows
per point, hypotheses are drawn in rounds until a stated confidence, and each hypothesis is scored by
sums that combine before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rand
from ..operators import cloud as C
from ..operators import fit
from ..operators import neighbors as nn
from ..operators.ordered import rank_within
from ..session import materialize
from .registration import DST, RUN, SIM3, SRC, Config, align, register_method

BINS = 11


def downsample_geometry(cloud: DataFrame, keys, cfg: Config) -> DataFrame:
    """Label-free voxel means with normals from their neighbourhoods."""
    keys = list(keys)
    v = C.voxel_downsample(cloud.select(*keys, *nn.XYZ), cfg.voxel_size, keys, per_class=False)
    pid = F.xxhash64(*keys, "vx", "vy", "vz")
    v = materialize(v.select(*keys, pid.alias("point_id"), *nn.XYZ), "voxels")
    return materialize(C.estimate_normals(v, cfg.voxel_size * 2.0, 30, keys), "voxels")


def shape_histograms(cloud: DataFrame, keys, radius: float, max_nn: int) -> DataFrame:
    """33 values per point: three 11-bin angle histograms of the point, plus those of its neighbours
    weighted by inverse squared distance, each block of 11 summing to 200."""
    keys = list(keys)
    src = cloud.select(*keys, F.col("point_id").alias("src_id"), *nn.XYZ)
    dst = cloud.select(*keys, F.col("point_id").alias("dst_id"), *nn.XYZ)
    hood = nn.neighborhoods(src, dst, radius, max_nn, keys).filter((F.col("src_id") != F.col("dst_id")) & (F.col("d2") > 0))
    pairs = materialize(hood.select(*keys, "src_id", "dst_id", "d2"), "hood")
    p = cloud.select(*keys, F.col("point_id").alias("src_id"), *[F.col(a).alias("p" + a) for a in (*nn.XYZ, "nx", "ny", "nz")])
    q = cloud.select(*keys, F.col("point_id").alias("dst_id"), *[F.col(a).alias("q" + a) for a in (*nn.XYZ, "nx", "ny", "nz")])
    j = pairs.join(p, keys + ["src_id"]).join(q, keys + ["dst_id"])
    d = g.scale(g.sub(g.vec("qx", "qy", "qz"), g.vec("px", "py", "pz")), 1.0 / F.sqrt("d2"))
    u, n2 = g.vec("pnx", "pny", "pnz"), g.vec("qnx", "qny", "qnz")
    v = g.unit(g.cross(d, u))
    w = g.cross(u, v)
    theta = F.atan2(g.dot(w, n2), g.dot(u, n2))
    shares = [(theta + math.pi) / (2 * math.pi), (g.dot(v, n2) + 1.0) / 2.0, (g.dot(u, d) + 1.0) / 2.0]
    bins = [F.least(F.greatest(F.floor(s * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int") + BINS * k for k, s in enumerate(shares)]
    own = j.select(*keys, "src_id", F.explode(F.array(*bins)).alias("bin")).groupBy(*keys, "src_id", "bin").agg(F.count(F.lit(1)).alias("c"))
    count = pairs.groupBy(*keys, "src_id").agg(F.count(F.lit(1)).alias("k"))
    own = materialize(own.join(count, keys + ["src_id"]).select(*keys, "src_id", "bin", (100.0 * F.col("c") / F.col("k")).alias("h")), "histograms")
    theirs = (
        pairs.join(own.withColumnRenamed("src_id", "dst_id"), keys + ["dst_id"])
        .groupBy(*keys, "src_id", "bin")
        .agg(F.sum(F.col("h") / F.col("d2")).alias("h"))
    )
    block = F.floor(F.col("bin") / BINS)
    total = theirs.groupBy(*keys, "src_id", block.alias("blk")).agg(F.sum("h").alias("t"))
    theirs = theirs.withColumn("blk", block).join(total, keys + ["src_id", "blk"]).select(*keys, "src_id", "bin", (100.0 * F.col("h") / F.col("t")).alias("h"))
    both = own.unionByName(theirs).groupBy(*keys, "src_id", "bin").agg(F.sum("h").alias("h"))
    cells = both.groupBy(*keys, "src_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "h"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(3 * BINS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return cells.select(*keys, F.col("src_id").alias("point_id"), vec.alias("vec"))


def distinct_draws(draws: DataFrame, size: str, of, seed: int) -> DataFrame:
    """Four different numbers below ``size`` for each row, as ``i0`` to ``i3``: the k-th is drawn from ``size - k`` places and moved past
    those taken before it."""
    taken: list = []
    for k in range(4):
        u = F.floor(rand.uniform(*of, F.lit(k), seed=seed) * (F.col(size) - k)).cast("long")
        for_taken = F.array_sort(F.array(*taken)) if taken else None
        place = F.aggregate(for_taken, u, lambda v, t: v + F.when(v >= t, 1).otherwise(0)) if taken else u
        draws = draws.withColumn(f"i{k}", place)
        taken.append(F.col(f"i{k}"))
    return draws


def _gap():
    moved = g.apply_sim3(*g.sim3(), g.vec("sx", "sy", "sz"))
    return g.norm(g.sub(moved, g.vec("dx", "dy", "dz")))


def fitted_groups(draws: DataFrame, numbered: DataFrame, reach: float) -> DataFrame:
    """``RUN, sim3`` of the drawn groups whose own transform brings each of their matches within reach.

    A group whose edges differ by twice the reach between source and destination can't fit, and is dropped before it is solved.
    """
    match = F.struct("slot", "sx", "sy", "sz", "dx", "dy", "dz")
    slots = draws.select(*RUN, F.posexplode(F.array(*[f"i{k}" for k in range(4)])).alias("slot", "i"))
    groups = slots.join(numbered, [*SRC, "i"]).groupBy(*RUN).agg(F.sort_array(F.collect_list(match)).alias("m"))
    edge = lambda a, b, side: g.norm([F.col("m")[a][side + x] - F.col("m")[b][side + x] for x in nn.XYZ])
    fits = None
    for a in range(4):
        for b in range(a + 1, 4):
            same = F.abs(edge(a, b, "s") - edge(a, b, "d")) <= 2.0 * reach * (1 + 1e-9)
            fits = same if fits is None else fits & same
    rows = materialize(groups.filter(fits).select(*RUN, F.explode("m").alias("p")).select(*RUN, "p.*").drop("slot"), "groups")
    solved = materialize(fit.umeyama(rows, RUN, with_scaling=False).select(*RUN, *SIM3), "solved")
    worst = rows.join(solved, RUN).groupBy(*RUN).agg(F.max(_gap()).alias("worst")).filter(F.col("worst") < reach)
    return solved.join(worst.select(*RUN), RUN)


def scored_hypotheses(solved: DataFrame, numbered: DataFrame, reach: float, per_task: int = 1024) -> DataFrame:
    """Matches within reach and their mean squared error for each hypothesis. Hypotheses are dealt into buckets that each meet the
    matches of their run, so no run is one task."""
    bucket = F.shiftright("candidate", per_task.bit_length() - 1)
    dealt = solved.withColumn("bucket", bucket)
    buckets = dealt.select(*SRC, "bucket").distinct()
    pairs = numbered.join(buckets, SRC).join(dealt, [*SRC, "bucket"])
    near = F.col("gap") < reach
    return pairs.withColumn("gap", _gap()).groupBy(*RUN, *SIM3).agg(F.sum(near.cast("long")).alias("hits"), F.avg(F.when(near, F.col("gap") * F.col("gap"))).alias("err"))


def search_hypotheses(matches: DataFrame, cfg: Config, seed: int = 0, trace: list | None = None) -> DataFrame:
    """Rounds of random hypotheses for all runs in lockstep: ``SRC, n, drawn, needed, hits, err, sim3``, NULL where nothing fitted.

    A run draws until the chance to have missed a group of true matches is below ``1 - confidence``: with a share w of its matches
    within reach of the best transform, after log(1 - confidence) / log(1 - w^4) draws; at most ``hypotheses``. Each round doubles
    the draws, runs that are done draw no more. The best has most matches within reach, then the smallest error, then came first.
    ``trace`` receives the table of each round.
    """
    order = rank_within(matches.withColumn("_u", rand.uniform(*SRC, "src_id", "dst_id", seed=seed)), SRC, ["_u", "src_id", "dst_id"], "i").drop("_u")
    numbered = materialize(order, "matches")
    none = [F.lit(None).cast("double").alias(c) for c in ("err", *SIM3)]
    sizes = numbered.groupBy(*SRC).agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    start = [F.lit(0).cast("long").alias("drawn"), F.lit(cfg.hypotheses).cast("long").alias("needed"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast("long").alias("candidate")]
    state = materialize(sizes.select(*SRC, "n", *start, *none), "rounds")
    size = cfg.first_draws
    while True:
        active = state.filter("drawn < needed")
        if active.isEmpty():
            return state
        upto = F.least(F.col("drawn") + size, F.col("needed"))
        draws = active.select(*SRC, "n", F.explode(F.sequence("drawn", upto - 1)).alias("candidate"))
        draws = distinct_draws(draws, "n", (*SRC, "candidate"), seed + 1)
        solved = materialize(fitted_groups(draws, numbered, cfg.hypothesis_dist), "hypotheses")
        score = F.struct("hits", (-F.coalesce("err", F.lit(float("inf")))).alias("e"), (-F.col("candidate")).alias("c"))
        scored = scored_hypotheses(solved, numbered, cfg.hypothesis_dist)
        best = scored.groupBy(*SRC).agg(F.max_by(F.struct("hits", "err", "candidate", *SIM3), score).alias("b"))
        j = state.join(best, SRC, "left")
        won = F.coalesce((F.col("b.hits") > F.col("hits")) | ((F.col("b.hits") == F.col("hits")) & F.coalesce(F.col("b.err") < F.col("err"), F.lit(True))), F.lit(False))
        kept = {c: F.when(won, F.col(f"b.{c}")).otherwise(F.col(c)).alias(c) for c in ("hits", "candidate", "err", *SIM3)}
        j = j.select(*SRC, "n", F.when(F.col("drawn") < F.col("needed"), upto).otherwise(F.col("drawn")).alias("drawn"), "needed", *kept.values())
        share = F.col("hits") / F.col("n")
        enough = F.ceil(math.log(1.0 - cfg.confidence) / F.log(1.0 - share**4)).cast("long")
        needed = F.when(F.col("hits") == 0, F.lit(cfg.hypotheses)).when(F.col("hits") == F.col("n"), F.lit(1)).otherwise(F.least(F.lit(cfg.hypotheses).cast("long"), enough))
        state = materialize(j.withColumn("needed", needed.cast("long")), "rounds")
        if trace is not None:
            trace.append(state)
        size = min(2 * size, cfg.most_draws)


@register_method("baseline")
def geometric_registration(src: DataFrame, dst: DataFrame, cfg: Config, trace: list | None = None) -> DataFrame:
    """Global alignment from shape histograms, refined by closest points with scale."""
    s, d = downsample_geometry(src, SRC, cfg), downsample_geometry(dst, DST, cfg)
    fs = shape_histograms(s, SRC, cfg.feature_radius, cfg.feature_max_nn)
    fd = shape_histograms(d, DST, cfg.feature_radius, cfg.feature_max_nn)
    trials = s.select(*SRC).distinct()
    a = materialize(fs.select(*SRC, F.col("point_id").alias("a_id"), "vec"), "features")
    b = materialize(fd.join(trials, DST).select(*SRC, F.col("point_id").alias("b_id"), "vec"), "features")
    m = nn.mutual_nearest_features(a, b, SRC)
    sp = s.select(*SRC, F.col("point_id").alias("a_id"), *[F.col(x).alias("s" + x) for x in nn.XYZ])
    dp = d.select(*DST, F.col("point_id").alias("b_id"), *[F.col(x).alias("d" + x) for x in nn.XYZ])
    cols = [F.col("a_id").alias("src_id"), F.col("b_id").alias("dst_id")]
    matches = m.join(sp, [*SRC, "a_id"]).join(dp, [*DST, "b_id"]).select(*SRC, *cols, "sx", "sy", "sz", "dx", "dy", "dz")
    best = search_hypotheses(materialize(matches, "matches"), cfg).filter("hits > 0").select(*SRC, *SIM3)
    eye = {c: F.coalesce(F.col(c), F.lit(1.0 if c in ("m00", "m11", "m22") else 0.0)) for c in SIM3}
    init = trials.join(best, SRC, "left").withColumns(eye).withColumn("candidate", F.lit(0))
    icp = Config(max_iter=cfg.icp_iters, max_corr_dist=cfg.icp_dist, tukey_c=None, with_scaling=True, convergence_delta=1e-6)
    return align(s, d, init.select(*RUN, *SIM3), icp, by_class=False, trace=trace).select(*SRC, *SIM3)
