"""Similarity registration of labelled clouds, many runs in lockstep.

Source clouds are keyed by ``scene_id, trial_id`` and destinations by ``scene_id``; a run adds a
``candidate``. One iteration is one job over the active runs of all scenes and trials together:
move, match, weigh, sum. Only sums per run leave the join, the run table is written to the shared
folder each round, and the clouds are never collected.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import pkgutil
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import linalg
from ..operators import cloud as C
from ..operators import fit
from ..operators import neighbors as nn
from ..operators import sampling
from ..operators.skew import small_table
from ..operators.trajectory import last_write_per_iteration
from ..session import materialize

SRC = ["scene_id", "trial_id"]
DST = ["scene_id"]
RUN = [*SRC, "candidate"]
M9 = [f"m{i}{j}" for i in range(3) for j in range(3)]
SIM3 = M9 + ["t0", "t1", "t2"]


@dataclass(frozen=True)
class Config:
    voxel_size: float = 0.05
    normal_radius: float = 0.15
    normal_max_nn: int = 50
    ransac_iters: int = 1000
    ransac_thresh_deg: float = 5.0
    yaw_bins: int = 360
    max_iter: int = 50
    max_corr_dist: float = 0.3
    tukey_c: float | None = 0.3
    with_scaling: bool = True
    convergence_delta: float = 1e-5
    match_classes: tuple[int, ...] = (1, 3, 5, 2, 4)
    structural: tuple[int, ...] = (1, 3, 5)
    # geometry-only method
    feature_radius: float = 0.25
    feature_max_nn: int = 100
    hypothesis_dist: float = 0.075
    hypotheses: int = 4_000_000
    confidence: float = 0.999
    first_draws: int = 1024  # of a run in the first round; each round doubles them
    most_draws: int = 131_072
    icp_dist: float = 0.15
    icp_iters: int = 30
    # perturbation benchmark
    perturb: dict = field(default_factory=lambda: {"rot_deg": (0.0, 180.0), "trans": (-2.0, 2.0), "log_scale": (-0.4, 0.4)})
    success: dict = field(default_factory=lambda: {"rot_deg": 5.0, "trans": 0.1, "scale_ratio": 0.05})


# -- method registry ---------------------------------------------------------------------------

Method = Callable[[DataFrame, DataFrame, Config], DataFrame]
METHODS: dict[str, Method] = {}


def register_method(name: str):
    """Register ``fn(src, dst, cfg) -> (scene_id, trial_id, sim3)`` under a name."""

    def wrap(fn: Method) -> Method:
        METHODS[name] = fn
        return fn

    return wrap


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Import every module of a methods folder, and of its ``experimental`` part where there is one; the names that these register.

    Files also go to the workers, so functions of a method's own can run there. A module keeps its file name, so one that another
    module already has is refused. Calling again changes nothing.
    """
    own = []
    for place in (folder, os.path.join(folder, "experimental")):
        for info in sorted(pkgutil.iter_modules([place]), key=lambda m: m.name):
            if info.ispkg:
                continue
            path = os.path.realpath(os.path.join(place, info.name + ".py"))
            held = sys.modules.get(info.name)
            if held is None:
                if importlib.util.find_spec(info.name) is not None:
                    raise ValueError(f"{path}: another module is named {info.name!r}")
                spec = importlib.util.spec_from_file_location(info.name, path)
                held = sys.modules[info.name] = importlib.util.module_from_spec(spec)
                try:
                    spec.loader.exec_module(held)
                except BaseException:
                    del sys.modules[info.name]
                    raise
            elif os.path.realpath(getattr(held, "__file__", None) or "") != path:
                raise ValueError(f"{path}: another module is named {info.name!r}")
            if not any(sent.endswith(f"/{info.name}.py") for sent in spark.sparkContext.listFiles):
                spark.sparkContext.addPyFile(path)
            own += [name for name, fn in METHODS.items() if fn.__module__ == info.name]
    return sorted(own)


def available_methods() -> list[str]:
    """Names of all methods: the package's own, whose modules are imported here, and those registered or discovered."""
    package = importlib.import_module(__package__)
    for info in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{__package__}.{info.name}")
    return sorted(METHODS)


def get_method(name: str) -> Method:
    known = available_methods()
    if name not in METHODS:
        raise KeyError(f"no method {name!r} among {', '.join(known)}")
    return METHODS[name]


# -- preparation -------------------------------------------------------------------------------


def prepare(cloud: DataFrame, keys, cfg: Config) -> DataFrame:
    """Normals of the clouds that have none, then class-preserving down-sampling."""
    keys = list(keys)
    if "nx" not in cloud.columns:
        cloud = C.estimate_normals(cloud, cfg.normal_radius, cfg.normal_max_nn, keys)
    else:
        bare = small_table(cloud.groupBy(*keys).agg(F.count("nx").alias("_n")).filter("_n = 0").select(*keys))
        if not bare.isEmpty():
            made = C.estimate_normals(cloud.join(bare, keys, "left_semi"), cfg.normal_radius, cfg.normal_max_nn, keys)
            cloud = cloud.join(bare, keys, "left_anti").unionByName(made)
    down = C.voxel_downsample(cloud, cfg.voxel_size, keys)
    pid = F.xxhash64(*keys, "label", "vx", "vy", "vz")
    out = down.select(*keys, pid.alias("point_id"), "label", *nn.XYZ, "nx", "ny", "nz")
    return materialize(out, "prepared")


class Target:
    """A destination indexed once and probed by every iteration."""

    def __init__(self, dst: DataFrame, radius: float, by_class: bool = True):
        self.keys = DST + (["label"] if by_class else [])
        self.radius = radius
        self.points = dst.select(*self.keys, F.col("point_id").alias("dst_id"), *nn.XYZ)
        self.grid = nn.plan_grid(self.points, self.points, self.keys, radius)
        self.index = None
        if self.grid.gated:
            parts = int(dst.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            idx = nn.index_destination(self.points, self.keys, self.grid)
            self.index = idx.repartition(parts, *self.keys, *nn.CELL).persist(StorageLevel.MEMORY_AND_DISK)

    def closest(self, moved: DataFrame) -> DataFrame:
        """``moved`` has the keys, ``src_id`` and x, y, z."""
        if self.index is not None:
            return nn.probe_index(moved, self.index, self.keys, self.grid, self.radius)
        return nn.nearest(moved, self.points, self.keys, self.radius, grid=self.grid)

    def release(self) -> None:
        if self.index is not None:
            self.index.unpersist()


def move_runs(src: DataFrame, runs: DataFrame, label: bool = True) -> DataFrame:
    """Sources under every run's transform; the moved position travels in ``src_id``."""
    cols = [*SRC, "point_id", *(["label"] if label else []), *nn.XYZ]
    j = src.select(*cols).join(runs.select(*RUN, *SIM3), SRC)
    p = g.apply_sim3(*g.sim3(), g.vec(*nn.XYZ))
    moved = j.select("scene_id", *(["label"] if label else []), "trial_id", "candidate", "point_id", *[c.alias(a) for a, c in zip(nn.XYZ, p)])
    ident = F.struct("trial_id", "candidate", "point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return moved.withColumn("src_id", ident).drop("trial_id", "candidate", "point_id")


# -- iterative alignment -----------------------------------------------------------------------


class Steps:
    """The expressions of one iteration, built once and applied to every round's tables."""

    def __init__(self, cfg: Config, rotation_fixed: bool, by_class: bool):
        self.by_class = by_class
        w = F.lit(1.0) if cfg.tukey_c is None else g.tukey_weight(F.sqrt("d2"), cfg.tukey_c)
        a = [F.col(f"src_id.p{x}") - F.col("o" + x) for x in nn.XYZ]
        b = [F.col("d" + x) - F.col("o" + x) for x in nn.XYZ]
        self.pair = [
            "scene_id", "src_id.trial_id", "src_id.candidate", w.alias("w"), *g.named_vec(a, "ax", "ay", "az"), *g.named_vec(b, "bx", "by", "bz"), "ox", "oy", "oz",
        ]
        av, bv, wc = g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz"), F.col("w")
        self.sums = [F.count(F.lit(1)).alias("n"), F.sum(wc).alias("w")]
        self.sums += [F.sum(wc * c).alias(f"s{k}{x}") for k, v in (("a", av), ("b", bv)) for x, c in zip(nn.XYZ, v)]
        self.sums += [F.sum(wc * bv[i] * av[j]).alias(f"q{i}{j}") for i in range(3) for j in range(3)]
        self.sums += [F.sum(wc * g.dot(av, av)).alias("qq"), *[F.first("o" + x).alias("o" + x) for x in nn.XYZ]]
        self._solve(cfg, rotation_fixed)

    def _solve(self, cfg: Config, rotation_fixed: bool) -> None:
        total = F.col("w") + 1e-12
        ma, mb = g.vec("_ma0", "_ma1", "_ma2"), g.vec("_mb0", "_mb1", "_mb2")
        self.means = {"_ok": ~F.col("done") & F.coalesce((F.col("n") >= 3) & (F.col("w") >= 1e-9), F.lit(False)), "_k": 2.0 - F.col("w") / total}
        self.means |= {f"_m{k}{i}": F.col(f"s{k}{x}") / total for k in "ab" for i, x in enumerate(nn.XYZ)}
        cov = {f"_c{i}{j}": F.col(f"q{i}{j}") / total - mb[i] * ma[j] * F.col("_k") for i in range(3) for j in range(3)}
        self.second = cov | {"_var": F.col("qq") / total - g.dot(ma, ma) * F.col("_k")}
        m, t = g.sim3()
        o = g.vec("ox", "oy", "oz")
        s = F.col("_s")
        if rotation_fixed:
            self.solved = {}
            self.scale = {"_s": (F.col("_c00") + F.col("_c11") + F.col("_c22")) / (F.col("_var") + 1e-12)}
            shift = g.sub(g.add(mb, o), g.scale(g.add(ma, o), s))
            new_m = [[x * s for x in row] for row in m] if cfg.with_scaling else g.sim3_rotation(m)
            new_t = g.add(g.scale(t, s), shift)
        else:
            rot = linalg.best_rotation(F.array(*[F.col(c) for c in cov]))
            self.solved = {"_r": F.when(F.col("_ok"), rot)}
            self.scale = {"_s": F.col("_r")[9] / (F.col("_var") + 1e-12) if cfg.with_scaling else 1.0 / g.sim3_scale(m)}
            inc = [[F.col("_r")[3 * i + k] * s for k in range(3)] for i in range(3)]
            new_m = g.mat_mul(inc, m)
            new_t = g.add(g.mat_vec(inc, t), g.sub(g.add(mb, o), g.mat_vec(inc, g.add(ma, o))))
        self.fresh = {f"_n{c}": v for c, v in zip(SIM3, [x for row in new_m for x in row] + new_t)}
        delta2 = None
        for c in SIM3:
            d = F.col("_n" + c) - F.col(c)
            delta2 = d * d if delta2 is None else delta2 + d * d
        ok = F.col("_ok")
        self.out = [
            *RUN, *[F.when(ok, F.col("_n" + c)).otherwise(F.col(c)).alias(c) for c in SIM3],
            (F.col("done") | ~ok | (F.sqrt(delta2) < cfg.convergence_delta)).alias("done"),
        ]

    def measure(self, src: DataFrame, target: Target, active: DataFrame, centre: DataFrame) -> DataFrame:
        """Weighted sums per run about the destination centre, from moved positions to matches."""
        hits = target.closest(move_runs(src, active, self.by_class)).join(centre, DST)
        return hits.select(*self.pair).groupBy(*RUN).agg(*self.sums)

    def update(self, runs: DataFrame, sums: DataFrame, it: int) -> DataFrame:
        """New transforms and convergence flags; constant-size work per run."""
        j = runs.join(sums, RUN, "left").withColumns(self.means).withColumns(self.second)
        if self.solved:
            j = j.withColumns(self.solved)
        j = j.withColumns(self.scale).withColumns(self.fresh)
        return j.select(*self.out, F.when(F.col("done"), F.col("iter")).otherwise(F.lit(it)).cast("int").alias("iter"))


def align(src: DataFrame, dst: DataFrame, runs: DataFrame, cfg: Config, rotation_fixed: bool = False, by_class: bool = True, target: Target | None = None, trace: list | None = None) -> DataFrame:
    """Iterate all runs until each has converged or used up its iterations.

    ``trace`` (a list) receives one run table per iteration, written in the shared folder.
    """
    if by_class:
        src = src.filter(F.col("label").isin(list(cfg.match_classes)))
    owned = target is None
    target = target or Target(dst, cfg.max_corr_dist, by_class)
    centre = materialize(dst.groupBy(*DST).agg(*[F.avg(a).alias("o" + a) for a in nn.XYZ]), "centre")
    state = materialize(runs.select(*RUN, *SIM3, F.lit(False).alias("done"), F.lit(0).alias("iter")), "runs")
    if trace is not None:
        trace.append(state)
    steps = Steps(cfg, rotation_fixed, by_class)
    for it in range(1, cfg.max_iter + 1):
        sums = steps.measure(src, target, state.filter(~F.col("done")), centre)
        state = materialize(steps.update(state, sums, it), "runs")
        if trace is not None:
            trace.append(state)
        if state.filter(~F.col("done")).isEmpty():
            break
    if owned:
        target.release()
    return state


def trace_table(trace: list[DataFrame], stride: int = 1) -> DataFrame:
    """(run, iter, sim3) of every recorded iteration on the stride, plus each run's final one."""
    stacked = trace[0]
    for t in trace[1:]:
        stacked = stacked.unionByName(t)
    return last_write_per_iteration(stacked, RUN, "iter", stride, SIM3)


def inlier_ratios(src: DataFrame, dst: DataFrame, runs: DataFrame, target: Target) -> DataFrame:
    """Class-constrained inlier ratio of every run."""
    shared = C.common_classes(src, dst, keys=DST)
    s = src.join(small_table(shared), DST + ["label"], "left_semi")
    hits = target.closest(move_runs(s, runs)).groupBy("scene_id", "src_id.trial_id", "src_id.candidate").agg(F.count(F.lit(1)).alias("hits"))
    total = s.groupBy(*SRC).agg(F.count(F.lit(1)).alias("total"))
    return (
        runs.join(total, SRC, "left")
        .join(hits, RUN, "left")
        .withColumn("ratio", F.coalesce("hits", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)))
        .drop("hits", "total")
    )


def run_chamfer(src: DataFrame, dst: DataFrame, runs: DataFrame) -> DataFrame:
    """Symmetric chamfer distance of every run, labels ignored."""
    moved = move_runs(src, runs, False).select("scene_id", "src_id.trial_id", "src_id.candidate", "src_id.point_id", *nn.XYZ)
    copies = dst.select(*DST, "point_id", *nn.XYZ).join(small_table(runs.select(*RUN)), DST)
    return C.chamfer(moved, copies, RUN).select(*RUN, "chamfer")


# -- physical-constraint method ----------------------------------------------------------------


def _frames(cloud: DataFrame, keys, cfg: Config) -> DataFrame:
    up = fit.gravity_axis(cloud, keys, cfg.ransac_thresh_deg, cfg.ransac_iters)
    return materialize(fit.canonical_frame(fit.yaw_direction(cloud, up, keys, cfg.yaw_bins), keys), "frames")


def seed_candidates(src: DataFrame, dst: DataFrame, cfg: Config) -> DataFrame:
    """Four plane-seeded starting transforms per source cloud."""
    fs, fd = _frames(src, SRC, cfg), _frames(dst, DST, cfg)
    cand = fit.yaw_candidates(fs, fd, SRC, DST)
    both = cand.join(fd, DST)
    # Axes are turned into the source frame instead of turning four copies of the cloud.
    turned = both.select(*RUN, *g.named(g.mat_mul(g.mat("k"), g.mat("r")), "k"))
    src_spans = fit.axis_spans(src, turned, RUN, cloud_keys=SRC)
    dst_spans = fit.axis_spans(dst, fd, DST)
    c_dst = fit.struct_centroid(dst, DST, cfg.structural)
    c = fit.struct_centroid(src, SRC, cfg.structural).join(cand, SRC)
    rotated = g.mat_vec(g.mat("r"), g.vec("cx", "cy", "cz"))
    c_src = c.select(*RUN, *g.named_vec(rotated, "cx", "cy", "cz"))
    seed = fit.plane_seed(src_spans, dst_spans, c_src, c_dst, fd, RUN, DST)
    out = seed.join(cand, RUN)
    return materialize(out.select(*RUN, *[(F.col("r" + c[1:]) * F.col("scale")).alias(c) for c in M9], "t0", "t1", "t2"), "seeds")


@register_method("proposed")
def physical_registration(src: DataFrame, dst: DataFrame, cfg: Config, trace: list | None = None) -> DataFrame:
    """Rotation from labelled planes, four seeded alignments at once, best by inlier ratio, a
    centroid-seeded second alignment, and the lower chamfer of the two.

    Every source cloud has one row. Its ``status`` is ``ok``, or says what its transform is NULL for: ``no destination``, or
    ``no frame`` where floor, ceiling or wall normals do not name the axes of either cloud.
    """
    s, d = prepare(src, SRC, cfg), prepare(dst, DST, cfg)
    target = Target(d, cfg.max_corr_dist)
    stage1: list | None = [] if trace is not None else None
    runs = align(s, d, seed_candidates(s, d, cfg), cfg, True, target=target, trace=stage1)
    scored = materialize(inlier_ratios(s, d, runs, target), "scored")
    win = sampling.best_candidate(scored, SRC, "ratio", "candidate", SIM3).select(*RUN, *SIM3)
    win = materialize(win, "win")
    c_dst = fit.struct_centroid(d, DST, cfg.structural).select(*DST, *[F.col("c" + a).alias("d" + a) for a in nn.XYZ])
    c_src = fit.struct_centroid(s, SRC, cfg.structural)
    j = win.join(c_src, SRC).join(c_dst, DST)
    t = g.sub(g.vec("dx", "dy", "dz"), g.mat_vec(g.mat("m"), g.vec("cx", "cy", "cz")))
    reseeded = j.select(*SRC, (F.col("candidate") + 4).alias("candidate"), *M9, *g.named_vec(t, "t0", "t1", "t2"))
    stage2: list | None = [] if trace is not None else None
    refined = align(s, d, reseeded, cfg, True, target=target, trace=stage2)
    both = win.unionByName(refined.select(*RUN, *SIM3))
    scored = both.join(run_chamfer(s, d, both), RUN)
    best = scored.groupBy(*SRC).agg(F.min_by(F.struct("candidate", *SIM3), F.struct("chamfer", "candidate")).alias("b"))
    final = materialize(best.select(*SRC, "b.*"), "final")
    target.release()
    if trace is not None:
        trace.extend([x.join(final.select(*RUN), RUN, "left_semi") for x in (stage1 or []) + (stage2 or [])])
    every = s.select(*SRC).distinct().join(d.select(*DST).distinct().withColumn("_dst", F.lit(True)), DST, "left")
    status = F.when(F.col("m00").isNotNull(), "ok").when(F.col("_dst").isNull(), "no destination").otherwise("no frame")
    return every.join(final, SRC, "left").select(*SRC, *SIM3, status.alias("status"))


def point_to_point(src: DataFrame, dst: DataFrame, gate: float = 0.1, iters: int = 30, init: DataFrame | None = None, with_scaling: bool = False) -> DataFrame:
    """Plain iterative closest points from the identity: one class, unit weights."""
    cfg = Config(max_iter=iters, max_corr_dist=gate, tukey_c=None, with_scaling=with_scaling, convergence_delta=1e-6)
    if init is None:
        eye = [F.lit(1.0 if i == j else 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
        init = src.select(*SRC).distinct().select(*SRC, F.lit(0).alias("candidate"), *eye, *[F.lit(0.0).alias(f"t{i}") for i in range(3)])
    return align(src, dst, init, cfg, rotation_fixed=False, by_class=False).select(*SRC, *SIM3)


# -- benchmark ---------------------------------------------------------------------------------


def perturb_sources(src: DataFrame, trials: DataFrame, ranges: dict, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(perturbed sources, known transforms). ``trials`` lists trial ids above 0; trial 0 of the
    source is the unperturbed one."""
    known = materialize(sampling.random_sim3(trials.select("trial_id"), "trial_id", seed=seed, **ranges), "trials")
    base = src.filter("trial_id = 0").drop("trial_id").withColumn("_k", F.lit(0))
    many = base.join(small_table(known.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return C.transform_cloud(many, *g.sim3()).drop(*SIM3), known


def robustness(src: DataFrame, dst: DataFrame, method: str, trials: DataFrame, cfg: Config, seed: int = 0) -> DataFrame:
    """Errors of every perturbed run against the method's own direct result, and the summary inputs.

    The direct run and all perturbed runs go through the method together.
    """
    moved, known = perturb_sources(src, trials, cfg.perturb, seed)
    cols = [c for c in src.columns if c in moved.columns]
    every = src.select(*cols).unionByName(moved.select(*cols))
    est = materialize(get_method(method)(every, dst, cfg), "estimates")
    direct = est.filter("trial_id = 0").select("scene_id", *[F.col(c).alias("d" + c) for c in SIM3])
    k = known.select("trial_id", *[F.col(c).alias("p" + c) for c in SIM3])
    j = est.filter("trial_id > 0").join(direct, "scene_id").join(small_table(k), "trial_id")
    expected = g.compose_sim3(g.sim3("dm", "dt"), g.invert_sim3(*g.sim3("pm", "pt")))
    e = g.sim3_errors(g.sim3(), expected)
    return j.select("scene_id", "trial_id", F.lit(method).alias("method"), *[v.alias(n) for n, v in e.items()])


def direct_quality(src: DataFrame, dst: DataFrame, transform: DataFrame, threshold: float) -> DataFrame:
    """Scale, class inlier ratio and chamfer of one transform per source cloud, NULL where the transform is."""
    every = transform.withColumn("candidate", F.lit(0)).select(*RUN, *SIM3)
    runs = every.filter(F.col("m00").isNotNull())
    target = Target(dst, threshold)
    ratio = inlier_ratios(src, dst, runs, target).select(*RUN, "ratio")
    out = materialize(every.join(ratio, RUN, "left").join(run_chamfer(src, dst, runs), RUN, "left").withColumn("scale", g.sim3_scale(g.mat("m"))), "quality")
    target.release()
    return out.select(*SRC, "scale", "ratio", "chamfer")


def deviation_table(trace: DataFrame, reference: DataFrame, keys) -> DataFrame:
    """Rotation, translation and scale deviation of every traced transform from a frozen one."""
    ref = reference.select(*keys, *[F.col(c).alias("g" + c) for c in SIM3])
    e = g.sim3_errors(g.sim3(), g.sim3("gm", "gt"))
    return trace.join(small_table(ref), list(keys)).select(*[c for c in trace.columns if c not in SIM3], *[v.alias(n) for n, v in e.items()])

