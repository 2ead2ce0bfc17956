"""Hash-derived draws: the same row gets the same number under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys, seed: int = 0) -> Column:
    """Uniform in [0, 1) from the row's own keys (53 bits of a 64-bit hash)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.xxhash64(*cols, F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def normal(*keys, seed: int = 0) -> Column:
    """Standard normal by the Box-Muller transform of two independent uniforms."""
    u1 = F.greatest(uniform(*keys, seed=2 * seed + 1_000_003), F.lit(1e-300))
    u2 = uniform(*keys, seed=2 * seed + 1_000_004)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def label_noise(label: Column, ratio: float, n_classes: int, *keys, seed: int = 0) -> Column:
    """With probability ``ratio`` replace the label by a uniform class draw."""
    draw = F.floor(uniform(*keys, seed=seed + 1) * n_classes).cast("int")
    return F.when(uniform(*keys, seed=seed) < ratio, draw).otherwise(label.cast("int"))
