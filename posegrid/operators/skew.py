"""Joins against hot keys and against small derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

def small_table(df: DataFrame) -> DataFrame:
    """Compute a per-key table once and hand back its written form.

    Joins against it carry no hint: the planner broadcasts it only where its real file size is under
    the session's threshold and shuffles it otherwise, and nothing upstream runs twice.
    """
    return materialize(df, "small")


ROWS_PER_TASK = 2_000_000


def hot_keys(counts: DataFrame, on, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Keys of a counted table (``on, count``) that need splitting, with their number of parts.

    At most ``rows / rows_per_task`` keys qualify, which bounds the broadcast; None when there are
    none, so ordinary data pays nothing in the join.
    """
    hot = counts.filter(F.col("count") > rows_per_task).select(*on, F.ceil(F.col("count") / rows_per_task).cast("long").alias("_n"))
    return None if hot.isEmpty() else F.broadcast(hot)


def salted_join(probe: DataFrame, build: DataFrame, on, spread: list[Column], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Equi-join that splits the hot keys of the probe side.

    ``build`` rows are copied only for those keys. ``how`` must keep the probe side.
    """
    on = list(on)
    if hot is None:
        return probe.join(build, on, how)
    parts = F.coalesce(F.col("_n"), F.lit(1).cast("long"))
    p = probe.join(hot, on, "left").withColumn("_s", F.pmod(F.xxhash64(*spread), parts)).drop("_n")
    b = build.join(hot, on, "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_n")
    return p.join(b, on + ["_s"], how).drop("_s")
