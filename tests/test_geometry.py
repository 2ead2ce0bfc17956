"""Transforms, fits and scores against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posegrid.functions import geometry as g
from posegrid.functions import labels as L
from posegrid.functions import linalg
from posegrid.operators import cloud as C
from posegrid.operators import fit
from posegrid.operators import segmentation as S


def _rotation(axis, deg):
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    t = np.radians(deg)
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def test_similarity_fit_recovers_a_known_transform(spark):
    rng = np.random.default_rng(0)
    r, s, t = _rotation((0.3, 1, 0.2), 40), 1.4, np.array([1.5, -2.0, 0.7])
    src = rng.normal(size=(200, 3))
    dst = s * src @ r.T + t
    df = spark.createDataFrame(pd.DataFrame(np.hstack([src, dst]), columns=["sx", "sy", "sz", "dx", "dy", "dz"]).assign(k=0))
    row = fit.umeyama(df, ["k"]).first()
    m = np.array([[row[f"m{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.abs(m - s * r).max() < 1e-6 and np.abs([row[f"t{i}"] - t[i] for i in range(3)]).max() < 1e-6
    assert fit.umeyama(df.limit(2), ["k"]).first()["m00"] is None


def test_quaternion_round_trip_and_orthonormalize(spark):
    rng = np.random.default_rng(2)
    rows = [_rotation(rng.normal(size=3), d).reshape(-1).tolist() for d in (0, 30, 120, 179.9, 180, 250)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    q = df.select("*", *g.named_vec(g.matrix_to_quat(g.mat("r"))[:3], "w", "x", "y"), g.matrix_to_quat(g.mat("r"))[3].alias("z"))
    back = q.select(*g.named(g.quat_to_matrix(*[F.col(c) for c in "wxyz"]), "b"), *[f"r{i}{j}" for i in range(3) for j in range(3)]).toPandas().to_numpy()
    assert np.abs(back[:, :9] - back[:, 9:]).max() < 1e-9
    drift = df.select(linalg.orthonormalize(F.array(*[F.col(f"r{i}{j}") * 1.001 for i in range(3) for j in range(3)])).alias("o")).toPandas()
    m = np.array(drift.o.tolist()).reshape(-1, 3, 3)
    assert np.abs(m @ m.transpose(0, 2, 1) - np.eye(3)).max() < 1e-12


def test_colour_scale_flag_and_ties(spark):
    df = spark.createDataFrame([(1.0, 0.25, 0.25), (0.5, 0.5, 0.5)], "r double, g double, b double")
    assert [x.label for x in C.color_to_label(df).collect()] == [1, 0]
    out = spark.range(1).select(L.nearest_color(F.lit(1.0), F.lit(0.0), F.lit(0.0), [(0, 0, 0), (2, 0, 0)]).alias("i")).first()
    assert out.i == 0


def test_empty_class_and_missing_normals(spark):
    df = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0)], "point_id long, label int, x double, y double, z double")
    with pytest.raises(ValueError):
        C.subset(df, ["wall"], strict=True)
    from posegrid.sources.tables import load_cloud, normals_complete

    assert not normals_complete(df.withColumn("nx", F.lit(None).cast("double")))
    with pytest.raises(ValueError):
        load_cloud(spark, "unknown")


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(4)
    gt, pred = rng.integers(-1, 5, 500), rng.integers(0, 4, 500)
    df = spark.createDataFrame(pd.DataFrame({"gt": gt, "pred": pred}))
    s = S.score_summary(S.class_scores(S.confusion(df), 4)).first()
    k = (gt >= 0) & (gt < 4)
    h = np.bincount(4 * gt[k] + pred[k], minlength=16).reshape(4, 4)
    iou = np.diag(h) / (h.sum(1) + h.sum(0) - np.diag(h))
    assert abs(s.miou - np.nanmean(iou)) < 1e-12 and abs(s.miou_no_back - np.nanmean(iou[1:])) < 1e-12
    assert abs(s.pixel_acc - (gt[k] == pred[k]).mean()) < 1e-12
