"""A labelled box room built in Spark from hashed draws, for property tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.functions import rand


def make_room(spark: SparkSession, n: int = 1500, seed: int = 0, size=(4.0, 3.0, 2.5), sigma: float = 0.005) -> DataFrame:
    """Floor, ceiling and four walls with inward normals; noise on positions only."""
    lx, ly, lz = size
    u, v = rand.uniform("id", seed=seed + 1), rand.uniform("id", seed=seed + 2)
    face = F.floor(F.col("id") / n)
    # (label, x, y, z, normal) per face in the order floor, ceiling, -x, +x, -y, +y walls
    faces = [
        (3, u * lx, v * ly, F.lit(0.0), (0, 0, 1)), (5, u * lx, v * ly, F.lit(lz), (0, 0, -1)),
        (1, F.lit(0.0), u * ly, v * lz, (1, 0, 0)), (1, F.lit(lx), u * ly, v * lz, (-1, 0, 0)),
        (1, u * lx, F.lit(0.0), v * lz, (0, 1, 0)), (1, u * lx, F.lit(ly), v * lz, (0, -1, 0)),
    ]

    def pick(k):
        out = None
        for i, f in enumerate(faces):
            value = f[k] if k < 4 else None
            if k == 0:
                value = F.lit(f[0])
            if k >= 4:
                value = F.lit(float(f[4][k - 4]))
            out = F.when(face == i, value) if out is None else out.when(face == i, value)
        return out

    noise = [rand.normal("id", seed=seed + 10 + i) * sigma for i in range(3)]
    return spark.range(6 * n).select(
        F.lit("room").alias("scene_id"), F.lit(0).cast("long").alias("trial_id"), F.col("id").alias("point_id"), pick(0).alias("label"),
        *[(pick(1 + i) + noise[i]).alias(a) for i, a in enumerate(("x", "y", "z"))],
        *[pick(4 + i).alias(a) for i, a in enumerate(("nx", "ny", "nz"))],
    )
