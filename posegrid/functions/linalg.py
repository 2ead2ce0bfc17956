"""Batched 3x3 solves: one row per run, scene or point, numpy over the Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARR = T.ArrayType(T.DoubleType())


def _stack(s: pd.Series, shape) -> tuple[np.ndarray, np.ndarray]:
    """Stacked matrices and the mask of usable ones; missing or non-finite input becomes zeros.

    A conditional around a vectorised function does not keep rows from reaching it.
    """
    size = int(np.prod(shape))
    rows = [[np.nan] * size if v is None else v for v in s]
    m = np.array(rows, dtype=np.float64).reshape((len(s),) + shape)
    ok = np.isfinite(m).reshape(len(s), -1).all(axis=1)
    return np.where(ok.reshape((-1,) + (1,) * len(shape)), m, 0.0), ok


def _series(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    return pd.Series([v if good else None for v, good in zip(values, ok)], dtype=object)


def _symmetric(six: np.ndarray) -> np.ndarray:
    """(xx, xy, xz, yy, yz, zz) rows to matrices."""
    return six[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)


def _principal(which: int):
    @F.pandas_udf(_ARR)
    def solve(six: pd.Series) -> pd.Series:
        if not len(six):
            return pd.Series([], dtype=object)
        m, ok = _stack(six, (6,))
        _, v = np.linalg.eigh(_symmetric(m))
        return _series(v[:, :, which], ok)

    return solve


def smallest_eigenvector(xx, xy, xz, yy, yz, zz) -> Column:
    return _principal(0)(F.array(xx, xy, xz, yy, yz, zz))


def largest_eigenvector(xx, xy, xz, yy, yz, zz) -> Column:
    return _principal(2)(F.array(xx, xy, xz, yy, yz, zz))


@F.pandas_udf(_ARR)
def best_rotation(cov: pd.Series) -> pd.Series:
    """From a row-major cross-covariance (destination x source): the proper rotation (9 values)
    followed by the signed sum of singular values."""
    if not len(cov):
        return pd.Series([], dtype=object)
    m, ok = _stack(cov, (3, 3))
    u, d, vt = np.linalg.svd(m)
    sign = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    s = np.stack([np.ones_like(sign), np.ones_like(sign), sign], axis=1)
    rot = (u * s[:, None, :]) @ vt
    return _series(np.concatenate([rot.reshape(-1, 9), (d * s).sum(1)[:, None]], axis=1), ok)


@F.pandas_udf(_ARR)
def orthonormalize(m: pd.Series) -> pd.Series:
    """Nearest orthonormal matrix (row-major 9 values) of a drifted rotation."""
    if not len(m):
        return pd.Series([], dtype=object)
    a, ok = _stack(m, (3, 3))
    u, _, vt = np.linalg.svd(a)
    return _series((u @ vt).reshape(-1, 9), ok)
