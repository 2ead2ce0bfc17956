"""Pose sequences: prediction, thinning, segmentation and error statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import fit
from .ordered import lag_by_index, percentiles, prefix_sum, rank_within
from .skew import small_table

POSE7 = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")


def relative_to_first(poses: DataFrame, keys=("seq_id",)) -> DataFrame:
    """inv(first) * pose, the first becoming the identity, then the camera-axis flip."""
    keys = list(keys)
    cols = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
    first = poses.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c).alias("f" + c) for c in cols]), F.col("frame_idx")).alias("_f")).select(*keys, "_f.*")
    p = poses.join(small_table(first), keys)
    ri, ti = g.rigid_inverse(g.mat("fr"), g.vec("ftx", "fty", "ftz"))
    r = g.flip_camera(g.mat_mul(ri, g.mat("r")))
    t = g.add(g.mat_vec(ri, g.vec("tx", "ty", "tz")), ti)
    out = {f"r{i}{j}": r[i][j] for i in range(3) for j in range(3)} | dict(zip(("tx", "ty", "tz"), t))
    return p.select(*[c for c in poses.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def predict_constant_speed(poses: DataFrame, columns, keys=("seq_id",), index: str = "frame_idx", block: int = 1 << 18) -> DataFrame:
    """2*previous - one before; the previous pose itself while only one predecessor exists."""
    lags = {f"_{c}{n}": (c, n) for c in columns for n in (1, 2)}
    p = lag_by_index(poses, keys, index, lags, block)
    keep = [c for c in poses.columns]
    return p.select(*keep, *[F.coalesce(2 * F.col(f"_{c}1") - F.col(f"_{c}2"), F.col(f"_{c}1")).alias("pred_" + c) for c in columns])


def split_at_gaps(samples: DataFrame, keys=("seq_id",), index: str = "frame_idx", ts: str = "ts", block: int = 1 << 18, rows_per_block: int | None = None) -> DataFrame:
    """Segment number per sample; a step of two median steps or more starts a new segment and the
    sample that ends the gap belongs to none."""
    keys = list(keys)
    kw = {} if rows_per_block is None else {"rows_per_block": rows_per_block}
    s = lag_by_index(samples, keys, index, {"_prev": (ts, 1)}, block).withColumn("_step", F.col(ts) - F.col("_prev"))
    med = percentiles(s, keys, "_step", {"_median": 0.5}, **kw)
    s = s.join(small_table(med), keys, "left")
    gap = F.coalesce((F.col("_step") >= 2 * F.col("_median")), F.lit(False))
    s = s.withColumn("_gap", gap)
    s = prefix_sum(s, keys, index, {"segment": F.col("_gap").cast("double")}, inclusive=True, block=block)
    return s.filter(~F.col("_gap")).withColumn("segment", F.col("segment").cast("long")).drop("_prev", "_step", "_median", "_gap")


def thin_min_gap(samples: DataFrame, min_gap: float, keys=("seq_id",), ts: str = "ts", rows_per_block: int = 1 << 20) -> DataFrame:
    """Keep a sample when it lies more than ``min_gap`` after the last kept one.

    The rule is sequential, but each sample's successor under it (the first one more than the gap
    later) is not. Sequences are cut into blocks; every block answers, for each sample that could be
    its first kept one, where the chain leaves the block; the small entry-to-exit tables are chained
    per sequence; a second pass marks the kept samples of each block from its known entry.
    """
    import numpy as np
    import pandas as pd

    keys = list(keys)
    distinct = samples.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_within(distinct, keys, [ts], "_i", rows_per_block).withColumn("_blk", F.floor(F.col("_i") / rows_per_block))
    n_blocks = (ranked.agg(F.max("_blk")).first()[0] or 0) + 1
    head = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    head = head + ", " if keys else ""

    def successors(t: "np.ndarray") -> "np.ndarray":
        # The subtraction below is the one the sequential rule does, so equal gaps decide equally.
        nxt = np.searchsorted(t, t + min_gap, side="right")
        n = len(t)
        for shift in (-1, 1):
            cand = nxt + shift
            ok = (cand >= 0) & (cand < n)
            if shift < 0:
                earlier = ok & (t[np.clip(cand, 0, n - 1)] - t > min_gap)
                nxt = np.where(earlier, cand, nxt)
            else:
                inside = nxt < n
                late = inside & ~(t[np.clip(nxt, 0, n - 1)] - t > min_gap)
                nxt = np.where(late, nxt + 1, nxt)
        return nxt

    def walk(t, start):
        nxt, kept, i = successors(t), [], start
        while i < len(t):
            kept.append(i)
            i = nxt[i]
        return kept

    if n_blocks == 1:

        def mark(key, pdf):
            pdf = pdf.sort_values(ts)
            return pdf.iloc[walk(pdf[ts].to_numpy(), 0)][[*keys, ts]]

        kept = ranked.groupBy(*keys).applyInPandas(mark, f"{head}`{ts}` double")
        return samples.join(kept, keys + [ts], "left_semi")

    def exits(key, pdf):
        """For every entry within one gap of the block start: the last kept stamp in the block."""
        pdf = pdf.sort_values(ts)
        t = pdf[ts].to_numpy()
        nxt = successors(t)
        last = np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                last[i] = last[nxt[i]]
        entry = np.arange(len(t)) <= np.searchsorted(t, t[0] + min_gap, side="right")
        out = pd.DataFrame({"entry": t[entry], "last": t[last[entry]]})
        for k, v in zip(keys, key):
            out[k] = v
        out["_blk"] = key[-1]
        return out[[*keys, "_blk", "entry", "last"]]

    table = ranked.groupBy(*keys, "_blk").applyInPandas(exits, f"{head}_blk long, entry double, last double")

    def chain(key, pdf):
        """One row per entry candidate; the walk visits one candidate per block."""
        pdf = pdf.sort_values(["_blk", "entry"])
        rows, kept_last = [], None
        for blk, part in pdf.groupby("_blk", sort=True):
            e = part["entry"].to_numpy()
            i = 0
            if kept_last is not None:
                fit_ = np.nonzero(e - kept_last > min_gap)[0]
                if not len(fit_):
                    continue
                i = int(fit_[0])
            rows.append((blk, e[i]))
            kept_last = part["last"].to_numpy()[i]
        out = pd.DataFrame(rows, columns=["_blk", "entry"])
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "_blk", "entry"]]

    entries = table.groupBy(*keys).applyInPandas(chain, f"{head}_blk long, entry double")

    def mark_block(key, pdf):
        pdf = pdf.sort_values(ts)
        t = pdf[ts].to_numpy()
        start = int(np.searchsorted(t, pdf["entry"].iloc[0], side="left"))
        return pdf.iloc[walk(t, start)][[*keys, ts]]

    kept = ranked.join(entries, keys + ["_blk"]).groupBy(*keys, "_blk").applyInPandas(mark_block, f"{head}`{ts}` double")
    return samples.join(kept, keys + [ts], "left_semi")


def every_nth(frames: DataFrame, step: int, keys=("seq_id",), index: str = "frame_idx", repeat_last: bool = True) -> DataFrame:
    """Every ``step``-th frame plus the last; the last repeats when it was already chosen."""
    keys = list(keys)
    top = frames.groupBy(*keys).agg(F.max(index).alias("_top"))
    f = frames.join(small_table(top), keys)
    on_step, last = F.col(index) % step == 0, F.col(index) == F.col("_top")
    copies = F.when(on_step & last & F.lit(repeat_last), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return f.filter(on_step | last).withColumn("_c", F.explode(copies)).drop("_c", "_top")


def valid_frames(gt: DataFrame, columns, keys=("seq_id", "frame_idx")) -> DataFrame:
    """Keys of frames whose pose has no NaN, infinite or missing entry."""
    ok = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return gt.filter(ok).select(*keys)


def horn_align(pairs: DataFrame, keys) -> DataFrame:
    """Rigid alignment without scale of ``sx..sz`` onto ``dx..dz``; two pairs are enough to score a sequence."""
    return fit.umeyama(pairs, keys, with_scaling=False, least=2)


def alignment_errors(pairs: DataFrame, transform: DataFrame, keys) -> DataFrame:
    moved = g.apply_sim3(*g.sim3(), g.vec("sx", "sy", "sz"))
    return pairs.join(small_table(transform), list(keys)).withColumn("err", g.norm(g.sub(moved, g.vec("dx", "dy", "dz"))))


def error_statistics(errors: DataFrame, keys, rows_per_block: int | None = None) -> DataFrame:
    """Pair count and, in centimetres, rmse, mean, median, population deviation, min and max."""
    keys = list(keys)
    e = F.col("err")
    kw = {} if rows_per_block is None else {"rows_per_block": rows_per_block}
    base = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), (F.sqrt(F.avg(e * e)) * 100).alias("rmse"), (F.avg(e) * 100).alias("mean"),
        (F.stddev_pop(e) * 100).alias("std"), (F.min(e) * 100).alias("min"), (F.max(e) * 100).alias("max"),
    )
    med = percentiles(errors, keys, "err", {"median": 0.5}, **kw).select(*keys, (F.col("median") * 100).alias("median"))
    return base.join(med, keys)


def last_write_per_iteration(trace: DataFrame, keys, order: str, stride: int = 1, columns=()) -> DataFrame:
    """Trace rows on the stride, plus the final iteration; a repeated iteration keeps the last row."""
    keys = list(keys)
    final = trace.groupBy(*keys).agg(F.max("iter").alias("_final"))
    t = trace.join(small_table(final), keys).filter((F.col("iter") % max(stride, 1) == 0) | (F.col("iter") == F.col("_final")))
    best = t.groupBy(*keys, "iter").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_v"))
    return best.select(*keys, "iter", "_v.*")
