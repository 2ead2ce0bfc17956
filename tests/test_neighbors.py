"""Grid searches against brute force, on even and on strongly clustered points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posegrid.operators import neighbors as nn


def _cloud(spark, rng, n, name, clustered):
    p = rng.normal(size=(n, 3))
    if clustered:
        p[: n // 2] = p[: n // 2] * 0.001 + 1.0
        p[: n // 3] = p[0]
    df = pd.DataFrame({"g": np.arange(n) % 2, name: np.arange(n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
    return p, spark.createDataFrame(df)


def _distances(a, b):
    d = ((a[:, None] - b[None]) ** 2).sum(-1)
    d[(np.arange(len(a)) % 2)[:, None] != (np.arange(len(b)) % 2)[None]] = np.inf
    return d


@pytest.mark.parametrize("clustered", [False, True])
def test_search_equals_brute_force(spark, clustered):
    rng = np.random.default_rng(3)
    pa, a = _cloud(spark, rng, 300, "src_id", clustered)
    pb, b = _cloud(spark, rng, 400, "dst_id", clustered)
    d = _distances(pa, pb)
    free = nn.nearest(a, b, ["g"]).toPandas().set_index("src_id").sort_index()
    assert (free.dst_id.to_numpy() == d.argmin(1)).all()
    hit = np.sqrt(d.min(1)) < 0.4
    for grid in (nn.Grid(0.4, 0, True), nn.Grid(0.4, 2, False)):
        gated = nn.nearest(a, b, ["g"], radius=0.4, grid=grid).toPandas().set_index("src_id").sort_index()
        assert list(gated.index) == list(np.nonzero(hit)[0])
        assert (gated.dst_id.to_numpy() == d.argmin(1)[hit]).all()
    want = {(i, j) for i in range(len(pa)) for j in np.lexsort((np.arange(len(pb)), d[i]))[:7] if d[i, j] <= 0.16}
    hood = nn.neighborhoods(a, b, 0.4, 7, ["g"], grid=nn.Grid(0.4, 2, False)).toPandas()
    assert set(zip(hood.src_id, hood.dst_id)) == want


def test_gate_is_strict_and_ties_take_the_lowest_id(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "src_id long, x double, y double, z double")
    dst = spark.createDataFrame([(9, 0.5, 0.0, 0.0), (4, -0.5, 0.0, 0.0), (7, 0.5, 0.0, 0.0)], "dst_id long, x double, y double, z double")
    assert nn.nearest(src, dst, radius=0.5, grid=nn.Grid(0.5, 0, True)).count() == 0
    assert nn.nearest(src, dst, radius=0.6, grid=nn.Grid(0.6, 0, True)).first()["dst_id"] == 4
    assert nn.nearest(src, dst).first()["dst_id"] == 4


def test_dense_pile_takes_the_descent(spark, monkeypatch):
    monkeypatch.setattr(nn, "GATED_POINTS", 50)
    pts = spark.range(400).select(F.col("id").alias("dst_id"), *[(F.col("id") * k % 397 / 10000.0).alias(a) for a, k in zip("xyz", (3, 5, 7))])
    src = pts.withColumnRenamed("dst_id", "src_id")
    plan = nn.plan_grid(src, pts, radius=1.0)
    assert not plan.gated and plan.levels > 3
    got = nn.nearest(src, pts, radius=1.0)
    assert got.count() == 400 and got.filter("d2 > 0").count() == 0  # every point finds itself or its copy


def test_salted_join_keeps_every_row(spark):
    from posegrid.operators.skew import hot_keys, salted_join

    probe = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 800, 0).otherwise(F.col("id") % 5).alias("k"))
    build = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = hot_keys(probe.groupBy("k").count(), ["k"], 100)
    out = salted_join(probe, build, ["k"], [F.col("id")], hot)
    assert out.count() == 1000 and out.filter("v != k * 10").count() == 0


def _tree_equals_brute_force(spark, p, q, radius=None):
    from posegrid.operators import packed

    src = spark.createDataFrame(pd.DataFrame({"src_id": np.arange(len(p)), **{a: p[:, i] for i, a in enumerate("xyz")}}))
    dst = spark.createDataFrame(pd.DataFrame({"dst_id": np.arange(len(q))[::-1], **{a: q[:, i] for i, a in enumerate("xyz")}}))
    got = packed.nearest(src, dst, radius=radius).toPandas().set_index("src_id").sort_index()
    d = np.stack([((x - q) ** 2)[:, 0] + ((x - q) ** 2)[:, 1] + ((x - q) ** 2)[:, 2] for x in p])[:, ::-1]
    keep = d.min(1) <= (np.inf if radius is None else radius * radius)
    assert list(got.index) == list(np.flatnonzero(keep))
    assert (got.d2.to_numpy() == d.min(1)[keep]).all() and (got.dst_id.to_numpy() == d.argmin(1)[keep]).all()


def test_most_sources_in_one_cell(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(size=(9000, 3)) * 100
    p[:8100] = 50 + p[:8100] * 1e-9
    _tree_equals_brute_force(spark, p, rng.uniform(size=(6000, 3)) * 100)


def test_sources_amid_a_shell_meet_every_leaf_in_parts(spark, monkeypatch):
    from posegrid.operators import packed

    monkeypatch.setattr(packed, "PART_LEAVES", 10)
    rng = np.random.default_rng(9)
    q = rng.normal(size=(5000, 3))
    q /= np.linalg.norm(q, axis=1)[:, None]
    _tree_equals_brute_force(spark, rng.normal(size=(300, 3)) * 1e-4, q)
    _tree_equals_brute_force(spark, np.zeros((2, 3)), np.array([[1.0, 0, 0], [0, -1.0, 0], [0, 0, 1.0], [1.0, 0, 0]]))


def test_tree_on_piles_gates_and_empty_tables(spark):
    rng = np.random.default_rng(10)
    q = rng.normal(size=(3000, 3))
    q[:1500] = q[0]
    _tree_equals_brute_force(spark, np.vstack([q[:500], rng.normal(size=(500, 3)) * 3]), q, 0.3)
    src = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "src_id long, x double, y double, z double")
    dst = src.withColumnRenamed("src_id", "dst_id")
    assert nn.nearest(src, dst.limit(0)).count() == 0 and nn.nearest(src.limit(0), dst).count() == 0
