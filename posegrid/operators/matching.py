"""Time-stamp matching: nearest within a gate, and one-to-one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import ROWS_PER_BLOCK, block_cuts, block_of, numbered


def nearest_in_time(
    left: DataFrame, right: DataFrame, keys=(), max_dt: float | None = None, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Nearest right stamp of every left row within the same keys; ties go to the earlier stamp.

    ``left`` has ``keys, left_id, ts``, ``right`` has ``keys, right_id, ts``; the result has
    ``keys, left_id, ts, right_id, right_ts, dt`` and keeps pairs with ``dt < max_dt``.

    Both sides are merged and sorted once; the neighbours are the last right stamp before and the
    first one after, so no pairs are formed. Long sequences are cut into blocks and the last stamp
    before and first stamp after each block are carried in from the block table.
    """
    keys = list(keys)
    r = right.groupBy(*keys, "ts").agg(F.min("right_id").alias("right_id"))
    none = F.lit(None)
    both = left.select(*keys, "ts", F.lit(1).alias("_side"), "left_id", none.cast("double").alias("_rts"), none.cast("long").alias("_rid")).unionByName(
        r.select(*keys, "ts", F.lit(0).alias("_side"), none.cast("long").alias("left_id"), F.col("ts").alias("_rts"), F.col("right_id").cast("long").alias("_rid"))
    )
    cuts = block_cuts(both, "ts", rows_per_block)
    both = both.withColumn("_blk", block_of(F.col("ts"), cuts))
    stamp = F.when(F.col("_side") == 0, F.struct(F.col("_rts").alias("ts"), F.col("_rid").alias("id")))
    w = Window.partitionBy(*keys, "_blk").orderBy("ts", "_side")
    # Looking ahead is looking back in descending order; a frame open at its end would be quadratic.
    back_w = Window.partitionBy(*keys, "_blk").orderBy(F.col("ts").desc(), "_side")
    both = both.select(
        "*",
        F.last(stamp, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_prev"),
        F.last(stamp, True).over(back_w.rowsBetween(Window.unboundedPreceding, 0)).alias("_next"),
    ).filter("_side = 1")
    if cuts:
        rb = r.withColumn("_blk", block_of(F.col("ts"), cuts))
        point = F.struct("ts", F.col("right_id").cast("long").alias("id"))
        edge = rb.groupBy(*keys, "_blk").agg(F.min(point).alias("_lo"), F.max(point).alias("_hi"))
        blocks = materialize(
            left.select(*keys, block_of(F.col("ts"), cuts).alias("_blk")).distinct().join(edge, keys + ["_blk"], "full"), "blocks"
        )
        bw = Window.partitionBy(*keys).orderBy("_blk")
        bw_desc = Window.partitionBy(*keys).orderBy(F.col("_blk").desc())
        carry = blocks.select(
            *keys,
            "_blk",
            F.last("_hi", True).over(bw.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.last("_lo", True).over(bw_desc.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
        )
        # Null-safe equality keeps the optimizer from copying the block expression to the other side,
        # where its inner lambda would lose the column it reads.
        carry = carry.withColumnsRenamed({k: f"_c_{k}" for k in (*keys, "_blk")})
        same = F.lit(True)
        for k in (*keys, "_blk"):
            same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        both = both.join(carry, same, "left").withColumns(
            {"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")}
        )
    back = F.col("ts") - F.col("_prev.ts")
    ahead = F.col("_next.ts") - F.col("ts")
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    out = both.withColumn("_p", pick).select(
        *keys, "left_id", "ts", F.col("_p.id").alias("right_id"), F.col("_p.ts").alias("right_ts"), F.abs(F.col("ts") - F.col("_p.ts")).alias("dt")
    )
    return out.filter(F.col("right_id").isNotNull() & (F.lit(True) if max_dt is None else F.col("dt") < max_dt))


def associate_frames(images: DataFrame, depths: DataFrame, poses: DataFrame | None = None, keys=(), max_dt: float = 0.08) -> DataFrame:
    """Image rows with their nearest depth and, when given, nearest pose; both within the gate."""
    keys = list(keys)
    img = images.select(*keys, F.col("id").alias("left_id"), "ts")

    def match(other: DataFrame, name: str) -> DataFrame:
        hit = nearest_in_time(img, other.select(*keys, F.col("id").alias("right_id"), "ts"), keys, max_dt)
        return hit.select(*keys, F.col("left_id").alias("image_id"), F.col("right_id").alias(f"{name}_id"), F.col("dt").alias(f"{name}_dt"))

    out = match(depths, "depth")
    return out if poses is None else out.join(match(poses, "pose"), keys + ["image_id"])


def match_one_to_one(first: DataFrame, second: DataFrame, keys=(), max_difference: float = 0.02, offset: float = 0.0, block_bits: int = 18) -> DataFrame:
    """Greedy best-first pairing where every stamp is used once: ``keys, a, b``.

    The greedy order is (difference, a, b). Stamps further apart than the gate never meet, so a sequence falls into chains of close
    stamps. Both tables are sorted together and cut into blocks; a block pairs its stamps in one pass, and leaves open only what
    hangs on a stamp beyond its edge. Open stamps meet again in blocks cut elsewhere: most data need one round, and no chain
    needs more rounds than it fills blocks.
    """
    keys = list(keys)
    stamp = lambda df, side, shift: df.select(*keys, (F.col("ts").cast("double") + shift).alias("ts"), F.lit(side).alias("side"), F.col("ts").cast("double").alias("raw"))
    rest = stamp(first, 0, 0.0).unionByName(stamp(second, 1, offset)).distinct()
    pairs = None
    shift = 0
    while True:
        solved = materialize(_solved_blocks(rest, keys, max_difference, block_bits, shift), "stamps")
        new = solved.filter("b is not null").select(*keys, F.col("raw").alias("a"), "b")
        pairs = new if pairs is None else pairs.unionByName(new)
        rest = solved.filter("b is null").drop("b")
        if rest.isEmpty():
            return pairs
        shift = (1 << (block_bits - 1)) - shift


def _solved_blocks(rest: DataFrame, keys, gate: float, block_bits: int, shift: int) -> DataFrame:
    """``keys, ts, side, raw, b``: pairs (``b`` is the second's stamp, ``raw`` the first's), and open stamps without ``b``."""
    import numpy as np
    import pandas as pd

    placed, _ = numbered(rest, [*keys, "ts", "side"], "stamps")
    blocks = placed.withColumn("block", F.shiftright(F.col("_at") + shift, block_bits)).drop("_at")
    w = Window.partitionBy(*keys).orderBy("block")
    ends = blocks.groupBy(*keys, "block").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    # one row for a block of up to 2^block_bits stamps
    ends = ends.select(*[F.col(k).alias(f"e_{k}") for k in (*keys, "block")], F.lag("hi").over(w).alias("before"), F.lead("lo").over(w).alias("after"))
    key_types = "".join(f"`{k}` {rest.schema[k].dataType.simpleString()}, " for k in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "side"], ignore_index=True)
        edge = [float(pdf[c].iloc[0]) for c in ("before", "after")]
        i, j, open_ = greedy_pairs(pdf["ts"].to_numpy(), pdf["side"].to_numpy(), pdf["raw"].to_numpy(), gate, *edge)
        raw = pdf["raw"].to_numpy()
        out = pdf.iloc[np.concatenate([i, open_])][[*keys, "ts", "side", "raw"]].copy()
        out["b"] = np.concatenate([raw[j], np.full(len(open_), np.nan)])
        return out

    same = F.lit(True)
    for k in (*keys, "block"):
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    rows = blocks.join(ends, same).select(*keys, "block", "ts", "side", "raw", "before", "after")
    out = rows.groupBy(*keys, "block").applyInPandas(solve, f"{key_types}ts double, side int, raw double, b double")
    return out.withColumn("b", F.when(~F.isnan("b"), F.col("b")))


def greedy_pairs(ts, side, raw, gate: float, before: float, after: float):
    """Indices of the firsts and seconds that pair, and of the stamps that stay open, in one block of sorted stamps. ``before`` and
    ``after`` are the stamps beyond its edges, nan where there are none.

    The closest pair left is always next to each other, so a list of neighbours and a heap are enough. What lies up to ``lo`` or from
    ``hi`` on may hang on stamps beyond the edges. A pair is only taken if it is closer than either of its stamps is to those zones;
    else the zone grows over it.
    """
    import heapq

    import numpy as np

    n = len(ts)
    t, s, name = ts.tolist(), side.tolist(), raw.tolist()
    lo, hi = before if before == before else -math.inf, after if after == after else math.inf
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    used = [False] * n
    taken: list[tuple[int, int]] = []
    heap: list[tuple[float, float, float, int, int]] = []

    def offer(l: int, r: int) -> None:
        if l >= 0 and r >= 0 and s[l] != s[r] and t[r] - t[l] < gate:
            a, b = (l, r) if s[l] == 0 else (r, l)
            heapq.heappush(heap, (t[r] - t[l], name[a], name[b], l, r))

    for k in range(1, n):
        offer(k - 1, k)
    while heap:
        d, _, _, l, r = heapq.heappop(heap)
        if used[l] or used[r]:
            continue
        if t[l] - lo <= d or hi - t[r] <= d:
            if t[l] - lo <= d:
                lo = max(lo, t[r])
            if hi - t[r] <= d:
                hi = min(hi, t[l])
            continue
        used[l] = used[r] = True
        taken.append((l, r) if s[l] == 0 else (r, l))
        x, y = left[l], right[r]
        if x >= 0:
            right[x] = y
        if y >= 0:
            left[y] = x
        offer(x, y)
    open_ = np.array([not used[k] and (t[k] - lo < gate or hi - t[k] < gate) for k in range(n)], bool)
    both = np.array(taken, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1], np.flatnonzero(open_)
