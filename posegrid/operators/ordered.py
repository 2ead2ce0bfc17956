"""Ordered computations that never hold one long sequence in one task.

A sequence, scene or ray may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` is not enough. Sequences are cut into blocks of bounded size; blocks
are processed in parallel and joined by small per-block carries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

ROWS_PER_BLOCK = 2_000_000
ID_BITS = 33  # row numbers inside a partition, as ``monotonically_increasing_id`` lays them out


def numbered(df: DataFrame, order, name: str, drop=()) -> tuple[DataFrame, int]:
    """The rows written in order, with ``_at``, their number in it, and the bits the numbers take. A range shuffle sorts them, so numbers
    grow along the order and leave gaps only between partitions; shifted right, they name runs of bounded length."""
    order = list(order)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, name)
    row = F.col("_id").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    width, parts = (int(v or 0).bit_length() for v in placed.agg(F.max(row), F.max(F.shiftright("_id", ID_BITS))).first())
    return placed.withColumn("_at", F.shiftleft(F.shiftright("_id", ID_BITS), width).bitwiseOR(row)).drop("_id"), width + parts


def block_cuts(df: DataFrame, order: str, rows_per_block: int) -> list[float]:
    """Cut points that split the order column into blocks of about ``rows_per_block`` rows.

    At most 16384 numbers come back, none when the table fits one block.
    """
    n = df.count()
    if n <= rows_per_block:
        return []
    blocks = min(math.ceil(n / rows_per_block), 16384)
    probs = [i / blocks for i in range(1, blocks)]
    cuts = df.select(F.col(order).cast("double").alias("c")).approxQuantile("c", probs, 0.25 / blocks)
    return sorted(set(cuts))


def block_of(value: Column, cuts: list[float]) -> Column:
    """Number of cut points at or below the value, found in two short scans."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    v = value.cast("double")
    heads = F.array(*[F.lit(float(g[0])) for g in groups])
    nested = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in groups])
    coarse = F.size(F.filter(heads, lambda h: h <= v))
    fine = F.size(F.filter(F.get(nested, coarse - 1), lambda h: h <= v))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * k + fine)


def _join_blocks(rows: DataFrame, blocks: DataFrame, on) -> DataFrame:
    """Rows with the values of their block. Null-safe equality keeps the optimizer from copying the block expression to the other side,
    where its inner lambda would lose the column it reads."""
    named = blocks.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return rows.join(named, same).drop(*[f"_r_{c}" for c in on])


def rank_within(df: DataFrame, keys, order, out: str = "rn", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """0-based position of each row within its keys, ordered by ``order`` (first one numeric)."""
    keys, order = list(keys), list(order)
    cuts = block_cuts(df, order[0], rows_per_block)
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long") - 1)
    b = df.withColumn("_blk", block_of(F.col(order[0]), cuts))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        b.groupBy(*keys, "_blk")
        .count()
        .select(*keys, "_blk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    )
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return (
        b.withColumn(out, F.row_number().over(w).cast("long") - 1)
        .transform(_join_blocks, offsets, [*keys, "_blk"])
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_blk", "_off")
    )


def lag_by_index(df: DataFrame, keys, index: str, outputs: dict[str, tuple[str, int]], block: int = 1 << 18) -> DataFrame:
    """Lag (n > 0) or lead (n < 0) over a dense 0-based index column.

    Blocks are index ranges; only the rows next to a block edge are copied into the neighbour.
    """
    keys = list(keys)
    back = max([n for _, n in outputs.values()] + [0])
    ahead = max([-n for _, n in outputs.values()] + [0])
    pos = F.pmod(F.col(index), F.lit(block))
    own = F.floor(F.col(index) / block)
    copies = F.array_compact(
        F.array(
            own,
            F.when(pos >= block - back, own + 1) if back else F.lit(None).cast("long"),
            F.when(pos < ahead, own - 1) if ahead else F.lit(None).cast("long"),
        )
    )
    w = Window.partitionBy(*keys, "_blk").orderBy(index)
    halo = df.withColumn("_blk", F.explode(copies))
    made = halo.select(
        "*",
        *[(F.lag(c, n) if n > 0 else F.lead(c, -n)).over(w).alias(name) for name, (c, n) in outputs.items()],
    )
    return made.filter(F.col("_blk") == own).drop("_blk")


def prefix_sum(df: DataFrame, keys, index: str, outputs: dict[str, Column], inclusive: bool = False, block: int = 1 << 18, length: int | None = None) -> DataFrame:
    """Running sums over a dense 0-based index column, exclusive unless asked otherwise. ``length``, where known, bounds the index, which
    is looked up otherwise."""
    keys = list(keys)
    top = df.agg(F.max(index)).first()[0] if length is None else length - 1
    end = 0 if inclusive else -1
    part = df.withColumn("_blk", F.floor(F.col(index) / block))
    w = Window.partitionBy(*keys, "_blk").orderBy(index).rowsBetween(Window.unboundedPreceding, end)
    local = part.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0.0)).alias(n) for n, e in outputs.items()])
    if top is None or top < block:
        return local.drop("_blk")
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        part.groupBy(*keys, "_blk")
        .agg(*[F.sum(e).alias(f"_s_{n}") for n, e in outputs.items()])
        .select(*keys, "_blk", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_s_{n}") for n in outputs])
    )
    joined = local.join(carry, keys + ["_blk"])
    return joined.select(*[c for c in df.columns], *[(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in outputs])


def percentiles(df: DataFrame, keys, value: str, outputs: dict[str, float], lower: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Exact percentiles per key: interpolated, or the lower sample value.

    Large inputs are reduced to distinct values with counts, ranked in blocks, and read off at the
    wanted ranks; the built-in aggregate would hold a whole group in one task.
    """
    keys = list(keys)
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cuts = block_cuts(kept, value, rows_per_block)
    if not cuts:
        f = F.expr
        kind = "percentile_disc({p}) WITHIN GROUP (ORDER BY `{v}`)" if lower else "percentile(`{v}`, {p})"
        return kept.groupBy(*keys).agg(*[f(kind.format(p=p, v=value)).alias(n) for n, p in outputs.items()])
    hist = kept.groupBy(*keys, F.col(value).cast("double").alias("_v")).count().withColumn("_blk", block_of(F.col("_v"), cuts))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    blocks = (
        hist.groupBy(*keys, "_blk")
        .agg(F.sum("count").alias("_n"))
        .select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("_tot"))
    )
    run = Window.partitionBy(*keys, "_blk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = _join_blocks(hist.withColumn("_c", F.sum("count").over(run)), blocks, [*keys, "_blk"]).withColumn("_c", F.col("_c") + F.col("_off"))
    aggs = []
    for n, p in outputs.items():
        if lower:
            aggs.append(F.min(F.when(F.col("_c") >= F.col("_tot") * p, F.col("_v"))).alias(n))
        else:
            rank = (F.col("_tot") - 1) * p
            aggs += [
                F.min(F.when(F.col("_c") > F.floor(rank), F.col("_v"))).alias(f"_lo_{n}"),
                F.min(F.when(F.col("_c") > F.ceil(rank), F.col("_v"))).alias(f"_hi_{n}"),
                F.max(rank - F.floor(rank)).alias(f"_f_{n}"),
            ]
    done = cum.groupBy(*keys).agg(*aggs)
    if lower:
        return done
    return done.select(
        *keys,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in outputs],
    )
