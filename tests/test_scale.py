"""Operators whose rows must not be written or shuffled once for each sample, voxel or pair."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from posegrid.functions.geometry import Camera
from posegrid.operators import neighbors, rays, sampling, views, visibility


def test_samples_of_a_ray_are_neither_written_nor_shuffled(spark, monkeypatch):
    r = spark.range(500).select(F.col("id").alias("ray_id"), F.lit(-3.0).alias("ox"), (F.col("id") * 0.001).alias("oy"), F.lit(0.02).alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.01).alias("dy"), F.lit(0.013).alias("dz"), F.lit(0.0).alias("depth"))
    written, plain = [], rays.materialize
    monkeypatch.setattr(rays, "materialize", lambda df, *a: written.append(df.count()) or plain(df, *a))
    ball = lambda s: s.withColumn("sdf", F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2) - 1.0)
    out = rays.chained_samples(r, (-4, -4, -4), (4, 4, 4), ball, 32, 16)
    n = out.groupBy("ray_id").count()
    assert {x["count"] for x in n.collect()} == {48} and n.count() == 500
    assert all(w <= 500 for w in written)
    plan = n._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1


def _brute(u, v):
    d = np.array([np.einsum("ij,ij->i", v - x, v - x) for x in u])
    return (d.argmin(1), d.min(1)), (d.argmin(0), d.min(0))


def test_nearest_rows_equal_brute_force():
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(700, 40))
    cases = [(wide[:300], wide[300:]), (np.round(wide[:300]), np.round(wide[300:])), (wide[:300], wide[100:500]), (wide * 1e-7 + 3.0, wide[::-1] * 1e-7 + 3.0), (wide[:9] * 1e20, wide * 1e20), (wide[:1], wide[:1])]
    for u, v in cases:
        for got, want in zip(neighbors.nearest_rows(u, v), _brute(u, v)):
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_blocks_of_vectors_hold_no_table_of_pairs():
    u = np.random.default_rng(4).normal(size=(8000, 3))
    tracemalloc.start()
    neighbors.nearest_rows(u, u + 1e-3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8000 * 8000 * 8 / 2


def test_mutual_features_of_copies(spark):
    rng = np.random.default_rng(5)
    p, q = np.repeat(rng.normal(size=(40, 5)), 3, 0), np.repeat(rng.normal(size=(50, 5)), 2, 0)
    side = lambda x, n: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{n} long, vec array<double>")
    got = neighbors.mutual_nearest_features(side(p, "a_id"), side(q, "b_id"), rows_per_block=16).collect()
    (j, _), (i, _) = _brute(p, q)
    assert sorted((r.a_id, r.b_id) for r in got) == [(a, j[a]) for a in range(len(p)) if i[j[a]] == a]


def test_frames_make_their_voxels_in_their_rows(spark, monkeypatch):
    cam = Camera(H=12, W=8, fx=6.0, fy=6.0, cx=3.5, cy=5.5)
    rng = np.random.default_rng(6)
    pixels = [(m, u, v, float(rng.uniform(1, 3))) for m in range(3) for u in range(8) for v in range(12)] + [(0, 2, 4, 1.5), (1, 9, 2, 2.0), (2, 2, 2, None)]
    frames = []
    for i in range(12):
        a = i * 0.7
        r = [-np.sin(a), 0.0, -np.cos(a), np.cos(a), 0.0, -np.sin(a), 0.0, 1.0, 0.0]
        frames.append((i % 2, None if i == 11 else min(i, 9), i % 4, *map(float, r), *map(float, rng.uniform(0, 2, 3))))  # one id comes twice
    p = spark.createDataFrame(pixels, "image long, u long, v long, depth double")
    f = spark.createDataFrame(frames, "scene_id long, frame long, image long, " + ", ".join(f"{c} double" for c in visibility.POSE_COLUMNS))
    args = (cam, ["scene_id"], ["frame"], ["image"], 0.2003, 0.4007, 4, 2)
    fused = visibility.fused_voxels(p, f, *args)
    got = {tuple(r[:4]): (r.frames, r.sdf) for r in fused.collect()}
    hits = visibility._hits_by_join(p.filter("depth > 0"), f, *args).groupBy("scene_id", *visibility.CELL).agg(F.count("_d").alias("n"), F.avg(F.least(F.lit(1.0), F.col("_d") / 0.4007)).alias("sdf"))
    want = {tuple(r[:4]): (r.n, r.sdf) for r in hits.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - s) < 1e-9 for k, (n, s) in want.items())
    alone = visibility.fused_voxels(p, f.filter("frame < 9"), *args)
    plan = alone._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    rows = plan.index("MapInArrow")  # below it frames meet images; above it only sums are dealt
    assert plan[:rows].count("Exchange hashpartitioning") == 1 and "Join" not in plan[:rows]


def test_a_large_index_is_not_broadcast(spark, tmp_path):
    points = spark.range(30_000).select((F.col("id") % 200).cast("double").alias("x"), F.floor(F.col("id") / 200).cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("id"))
    points.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    plans = {}
    for n in (300, 30_000):
        dst = points.filter(F.col("id") < n).withColumnRenamed("id", "dst_id")
        found = neighbors.nearest(points.withColumnRenamed("id", "src_id").withColumn("x", F.col("x") + 0.1), dst, radius=0.2)
        assert found.count() == n and found.filter("src_id <> dst_id").isEmpty()
        plans[n] = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plans[300] and "BroadcastHashJoin" not in plans[30_000] and "SortMergeJoin" in plans[30_000]


def test_overlap_forms_no_row_for_a_pair(spark, monkeypatch):
    cam = Camera(H=12, W=8, fx=6.0, fy=6.0, cx=3.5, cy=5.5)
    rng = np.random.default_rng(8)
    monkeypatch.setattr(views, "SAMPLES", 40)
    monkeypatch.setattr(views, "KEYFRAMES", 16)
    poses = []
    for i in range(60):
        a = i * 0.7
        r = [-np.sin(a), 0.0, -np.cos(a), np.cos(a), 0.0, -np.sin(a), 0.0, 1.0, 0.0]
        poses.append((None if i == 59 else i % 2, i // 2 * 2, *map(float, r), *map(float, rng.uniform(0, 2, 3))))  # ids come twice
    points = [(i % 3, 0 if i % 10 else i % 7, i, *map(float, rng.uniform(-1, 3, 3))) for i in range(600)] + [(0, 1, 700, None, 0.0, 0.0), (1, None, 701, 0.0, 0.0, 0.0), (0, 2, 702, float("nan"), 0.0, 0.0)]
    points += [(0, 5, 800 + i, p[11], p[12], p[13]) for i, p in enumerate(poses[:8])]  # on the apex
    kf = spark.createDataFrame(poses, "scene_id long, kf long, " + ", ".join(f"{c} double" for c in visibility.POSE_COLUMNS))
    s = spark.createDataFrame(points, "scene_id long, frame long, point_id long, x double, y double, z double")
    seen = visibility.visible_points(kf, s.dropna(subset=["x"]).filter("not isnan(x)"), cam, ["scene_id"], ["kf"], ["frame", "point_id"], 1.0, strict_front=True)
    want = {tuple(r) for r in seen.dropna(subset=["frame"]).groupBy("scene_id", "frame", "kf").count().collect()}
    got = [tuple(r) for r in views.counts_by_frame(s, kf, cam, ["scene_id"], "frame", 1.0).collect()]
    assert len(got) == len(want) > 100 and set(got) == want
    monkeypatch.setattr(views, "SAMPLES", 1 << 15)
    whole = views.counts_by_frame(s, kf, cam, ["scene_id"], "frame", 1.0)
    assert {tuple(r) for r in whole.collect()} == want
    plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Aggregate" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_keyframes_are_picked_in_one_pass(spark, monkeypatch):
    rows = [(0, f, k, 0.0 if f == 3 else k / 10) for f in range(4) for k in range(9)]
    overlap = spark.createDataFrame(rows, "scene_id long, frame long, kf long, overlap double")
    passes = []
    plain = sampling.small_table
    monkeypatch.setattr(sampling, "small_table", lambda df: passes.append(1) or plain(df))
    kept = sampling.pick_keyframes(overlap, overlap.select("scene_id", "kf").distinct(), 2, ["scene_id"])
    assert passes == [1] and "Window" not in kept.filter("reason = 'current'")._jdf.queryExecution().optimizedPlan().toString()
    by = {(r.frame, r.reason): r["count"] for r in kept.groupBy("frame", "reason").count().collect()}
    assert by == {(f, w): n for f in range(4) for w, n in (("overlap", 2), ("last", 2), ("current", 1)) if (f, w) != (3, "overlap")}


def test_views_are_settled_in_blocks(spark, monkeypatch):
    cam = Camera(H=12, W=8, fx=6.0, fy=6.0, cx=3.5, cy=5.5)
    rng = np.random.default_rng(9)
    for name, size in (("POINT_BITS", 7), ("DEEP_BITS", 7), ("FRAMES", 8), ("DEEP_FRAMES", 8)):
        monkeypatch.setattr(views, name, size)
    frames = []
    for i in range(30):
        a = i * 0.7
        r = [-np.sin(a), 0.0, -np.cos(a), np.cos(a), 0.0, -np.sin(a), 0.0, 1.0, 0.0]
        frames.append((None if i == 29 else i % 2, i // 2 * 2, i % 5, *map(float, r), *map(float, rng.uniform(0, 2, 3))))  # ids come twice
    points = [(i % 3, i // 2, *map(float, rng.uniform(-1, 3, 3))) for i in range(1500)] + [(0, 9, *f[12:]) for f in frames[:4]]
    pixels = [(m, u, v, None if u + v == 9 else float(rng.uniform(0, 3))) for m in range(4) for u in range(8) for v in range(12)] + [(0, 2, 4, 2.9), (1, 9, 2, 2.0)]
    f = spark.createDataFrame(frames, "scene_id long, frame long, image long, " + ", ".join(f"{c} double" for c in visibility.POSE_COLUMNS))
    p = spark.createDataFrame(points, "scene_id long, point_id long, x double, y double, z double")
    depth = spark.createDataFrame(pixels, "image long, u long, v long, depth double")
    odd = p.unionByName(spark.createDataFrame([(0, 1, None, 0.0, 0.0), (1, 1, float("nan"), 0.0, 0.0)], p.schema))
    seen = visibility.visible_points(f, p, cam, ["scene_id"], ["frame"], ["point_id"], 1.0, strict_front=True)
    got = views.counts_in_view(f, odd, cam, ["scene_id"], ["frame"], 1.0)
    want = {tuple(r) for r in seen.groupBy("scene_id", "frame").count().collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 15
    near = visibility.with_depth_reach(f, depth, ["image"], 0.06)
    near = visibility.visible_points(near, p, cam, ["scene_id"], ["frame", "image"], ["point_id"])
    want = sorted(tuple(r) for r in visibility.not_occluded(near, depth, cam, ["scene_id"], ["frame"], ["point_id"], 0.06, ["image"]).collect())
    out = views.unoccluded_points(f, odd, depth, cam, ["scene_id"], ["frame"], ["image"], ["point_id"], 0.06)
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 100
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
