"""Trajectory and reconstruction evaluation, composed from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cloud as C
from ..operators import mesh as M
from ..operators import neighbors as nn
from ..operators import trajectory as T
from ..operators.matching import match_one_to_one
from ..operators.skew import small_table
from ..session import materialize
from . import registration as R


def trajectory_evaluation(gt: DataFrame, est: DataFrame, keys=("seq_id",), scale: float = 1.0) -> DataFrame:
    """Valid frames, unit scale, pairing by frame, rigid alignment of the estimate, statistics.

    All sequences are scored together; sequences with fewer than two pairs are left out.
    """
    keys = list(keys)
    ok = T.valid_frames(gt, ["tx", "ty", "tz"] + [c for c in gt.columns if c.startswith("r") and len(c) == 3], keys + ["frame_idx"])
    pairs = (
        gt.select(*keys, "frame_idx", *[(F.col("t" + a) / scale).alias("d" + a) for a in nn.XYZ])
        .join(est.select(*keys, "frame_idx", *[(F.col("t" + a) / scale).alias("s" + a) for a in nn.XYZ]), keys + ["frame_idx"])
        .join(ok, keys + ["frame_idx"], "left_semi")
    )
    pairs = materialize(pairs, "pairs")
    fit = T.horn_align(pairs, keys).filter("n >= 2")
    return T.error_statistics(T.alignment_errors(pairs, fit, keys), keys).filter("pairs >= 2")


def timed_trajectory_evaluation(first: DataFrame, second: DataFrame, keys=("seq_id",), offset: float = 0.0, scale: float = 1.0, max_difference: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Error statistics, matched pairs and the whole aligned second trajectory, of stamped positions ``keys, ts, tx, ty, tz``.

    Stamps are paired one to one in time, the second's shifted by ``offset``; its positions are multiplied by ``scale`` and aligned
    rigidly to the first's. Positions that are not finite take no part; of repeated stamps the lowest position does. Sequences with
    fewer than two pairs are left out. The pairs have ``a, ax..az, b, bx..bz`` and ``err``.
    """
    keys = list(keys)

    def track(df: DataFrame, factor: float) -> DataFrame:
        pos = ["tx", "ty", "tz"]
        ok = None
        for c in pos:
            v = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
            ok = v if ok is None else ok & v
        p = df.filter(ok).groupBy(*keys, F.col("ts").cast("double").alias("ts")).agg(F.min(F.struct(*[(F.col(c) * factor).alias(c) for c in pos])).alias("p"))
        return materialize(p.select(*keys, "ts", "p.*"), "track")

    one, two = track(first, 1.0), track(second, scale)
    matches = materialize(match_one_to_one(one.select(*keys, "ts"), two.select(*keys, "ts"), keys, max_difference, offset), "matches")
    side = lambda df, stamp, p: df.select(*keys, F.col("ts").alias(stamp), *[F.col("t" + a).alias(p + a) for a in nn.XYZ])
    pairs = materialize(matches.join(side(one, "a", "d"), [*keys, "a"]).join(side(two, "b", "s"), [*keys, "b"]), "pairs")
    fit = small_table(T.horn_align(pairs, keys).filter("n >= 2"))
    errors = materialize(T.alignment_errors(pairs, fit, keys), "errors")
    moved = g.apply_sim3(*g.sim3(), g.vec("sx", "sy", "sz"))
    matched = errors.select(*keys, "a", *[F.col("d" + a).alias("a" + a) for a in nn.XYZ], "b", *[c.alias("b" + a) for a, c in zip(nn.XYZ, moved)], "err")
    whole = two.select(*keys, "ts", *[F.col("t" + a).alias("s" + a) for a in nn.XYZ]).join(fit, keys)
    aligned = whole.select(*keys, "ts", *[c.alias("t" + a) for a, c in zip(nn.XYZ, moved)])
    return T.error_statistics(errors, keys), matched, aligned


def reconstruction_evaluation(rec_faces: DataFrame, gt_faces: DataFrame, rec_vertices: DataFrame, gt_vertices: DataFrame, n_points: int = 450_000, align: bool = True, gate: float = 0.1, iters: int = 30, threshold: float = 0.05) -> DataFrame:
    """Align the reconstructed vertices, sample both surfaces, score accuracy and completion.

    Face tables carry ``scene_id, fid, p0x..p2z`` (gathered corners).
    """
    if align:
        src = rec_vertices.select("scene_id", F.lit(0).cast("long").alias("trial_id"), F.col("vid").alias("point_id"), *nn.XYZ)
        dst = gt_vertices.select("scene_id", F.col("vid").alias("point_id"), *nn.XYZ)
        fit = R.point_to_point(src, dst, gate, iters)
        moved = rec_faces.join(fit.drop("trial_id"), "scene_id")
        cols = {}
        for i in range(3):
            p = g.apply_sim3(*g.sim3(), g.vec(*[f"p{i}{a}" for a in nn.XYZ]))
            cols |= {f"p{i}{a}": c for a, c in zip(nn.XYZ, p)}
        rec_faces = moved.withColumns(cols).drop(*R.SIM3)
    samples = []
    for faces, seed in ((rec_faces, 1), (gt_faces, 2)):
        s = M.sample_surface(M.face_geometry(faces), ["scene_id"], n_points, ["fid"], seed)
        samples.append(materialize(s.select("scene_id", F.xxhash64("fid", "i").alias("point_id"), *nn.XYZ), "samples"))
    return C.reconstruction_scores(samples[0], samples[1], ["scene_id"], threshold)


def freeze_reference(src: DataFrame, dst: DataFrame, cfg: R.Config, method: str = "proposed") -> tuple[DataFrame, DataFrame]:
    """(transform, quality report) of a direct registration, ready to be saved and reused."""
    transform = R.get_method(method)(src, dst, cfg)
    return transform, R.direct_quality(src, dst, transform, cfg.max_corr_dist)
