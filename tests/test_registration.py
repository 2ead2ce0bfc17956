"""Box-room recovery within the published tolerances."""

import math

import pytest
from pyspark.sql import functions as F

from posegrid.functions import geometry as g
from posegrid.operators import cloud as C
from posegrid.operators import fit
from posegrid.plans import geometric  # noqa: F401
from posegrid.plans import registration as R
from posegrid.session import materialize
from rooms import make_room


def _transform(cloud, axis, deg, s, t):
    r = g.axis_rotation(g.unit([F.lit(float(x)) for x in axis]), F.lit(math.radians(deg)))
    return C.transform_cloud(cloud, [[x * s for x in row] for row in r], [F.lit(float(x)) for x in t])


def _truth(spark, axis, deg, s, t):
    r = g.axis_rotation(g.unit([F.lit(float(x)) for x in axis]), F.lit(math.radians(deg)))
    m = [[x * s for x in row] for row in r]
    return spark.range(1).select(F.lit("room").alias("scene_id"), *g.named(m, "m"), *[F.lit(float(x)).alias(f"t{i}") for i, x in enumerate(t)])


@pytest.fixture(scope="module")
def room(spark):
    return materialize(make_room(spark, 250, seed=5), "room")


def _identity(spark):
    eye = [F.lit(1.0 if i == j else 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    zero = [F.lit(0.0).alias(f"t{i}") for i in range(3)]
    return spark.range(1).select(F.lit("room").alias("scene_id"), F.lit(0).cast("long").alias("trial_id"), F.lit(0).alias("candidate"), *eye, *zero)


def _errors(result, truth):
    return R.deviation_table(result, truth, ["scene_id"]).first()


def test_registry():
    assert {"baseline", "proposed"} <= set(R.available_methods())
    with pytest.raises(KeyError):
        R.get_method("does_not_exist")


def test_gravity_under_tilt(spark, room):
    tilted = _transform(room, (1, 0, 0), 12, 1.0, (0, 0, 0))
    a = fit.gravity_axis(tilted, ["scene_id"], 5.0, 100).first()
    want = (0.0, -math.sin(math.radians(12)), math.cos(math.radians(12)))
    cos = a.ax * want[0] + a.ay * want[1] + a.az * want[2]
    assert cos > math.cos(math.radians(2))


def test_alignment_recovers_translation_and_scale(spark, room):
    t, s = (0.1, -0.05, 0.08), 1.03
    dst = materialize(_transform(room, (0, 0, 1), 0, s, t).drop("trial_id"), "dst")
    cfg = R.Config(max_iter=25, max_corr_dist=0.5, tukey_c=0.5, convergence_delta=1e-6)
    trace = []
    out = R.align(room, dst, _identity(spark), cfg, rotation_fixed=True, trace=trace)
    e = _errors(out, _truth(spark, (0, 0, 1), 0, s, t))
    assert e.trans < 0.02 and e.scale_ratio < 0.02
    steps = R.trace_table(trace, 5)
    last = out.first().iter
    assert {r.iter for r in steps.collect()} == {i for i in range(last + 1) if i % 5 == 0 or i == last}


def test_full_alignment_from_a_close_start(spark, room):
    t, s = (0.05, 0.04, -0.03), 1.02
    dst = materialize(_transform(room, (0.2, 0.3, 1), 4, s, t).drop("trial_id"), "dst")
    cfg = R.Config(max_iter=25, max_corr_dist=0.5, tukey_c=0.5, convergence_delta=1e-6)
    e = _errors(R.align(room, dst, _identity(spark), cfg), _truth(spark, (0.2, 0.3, 1), 4, s, t))
    assert e.rot_deg < 2 and e.trans < 0.05 and e.scale_ratio < 0.03


def test_far_apart_clouds_stop_at_once(spark, room):
    dst = materialize(_transform(room, (0, 0, 1), 0, 1.0, (100, 0, 0)).drop("trial_id"), "dst")
    out = R.align(room, dst, _identity(spark), R.Config(max_iter=5)).first()
    assert out.done and out.m00 == 1.0 and out.t0 == 0.0


def test_end_to_end(spark, room):
    t, s = (0.5, -0.4, 0.3), 1.15
    dst = materialize(_transform(room, (0, 0, 1), 0, s, t).drop("trial_id"), "dst")
    cfg = R.Config(voxel_size=0.12, ransac_iters=100, max_iter=12, max_corr_dist=0.5, tukey_c=0.5, convergence_delta=1e-4)
    e = _errors(R.get_method("proposed")(room, dst, cfg), _truth(spark, (0, 0, 1), 0, s, t))
    assert e.rot_deg < 3 and e.trans < 0.1 and e.scale_ratio < 0.05


def test_every_scene_has_a_row(spark, room):
    """A scene without normals, one without floor and ceiling, one without walls, one without a destination."""
    named = lambda df, name: df.withColumn("scene_id", F.lit(name))
    bare = named(room, "bare").withColumns({c: F.lit(None).cast("double") for c in ("nx", "ny", "nz")})
    src = room.unionByName(bare).unionByName(named(room, "walls").filter("label = 1")).unionByName(named(room, "flat").filter("label <> 1")).unionByName(named(room, "alone"))
    src = materialize(src, "src")
    dst = materialize(_transform(src.filter("scene_id <> 'alone'"), (0, 0, 1), 0, 1.0, (0.1, 0.1, 0.1)).drop("trial_id"), "dst")
    cfg = R.Config(voxel_size=0.3, normal_radius=0.3, ransac_iters=50, max_iter=2, max_corr_dist=0.5, tukey_c=0.5)
    out = materialize(R.get_method("proposed")(src, dst, cfg), "out")
    got = {r.scene_id: r for r in out.collect()}
    assert {k: r.status for k, r in got.items()} == {"room": "ok", "bare": "ok", "walls": "no frame", "flat": "no frame", "alone": "no destination"}
    assert all((r.m00 is None) == (r.status != "ok") for r in got.values())
    quality = {r.scene_id: r for r in R.direct_quality(src, dst, out, 0.5).collect()}
    assert quality.keys() == got.keys() and all((r.chamfer is None) == (got[k].status != "ok") for k, r in quality.items())


@pytest.mark.parametrize("seed", range(6))
def test_axis_of_repeated_normals(spark, seed):
    """Most normals are one value and a tenth another: the larger group wins whatever its hash."""
    a = math.radians(10 + 13 * seed)
    other = (math.sin(a), 0.0, math.cos(a)) if seed % 2 else (math.cos(a), math.sin(a), 0.0)
    cloud = spark.range(10_000).select(F.lit("s").alias("scene_id"), *[F.when(F.col("id") < 9000, x).otherwise(float(y)).alias(c) for c, x, y in zip(("nx", "ny", "nz"), (0.0, 0.0, 1.0), other)])
    r = fit.robust_axis(cloud, ["scene_id"], 5.0, 100).first()
    assert r.inliers == 9000 and abs(r.az) > 1 - 1e-9


def test_sample_counts_are_exact(spark, monkeypatch):
    from posegrid.operators import mesh as M

    monkeypatch.setattr(M, "FACES_PER_BLOCK", 64)
    corner = {f"p{i}{c}": F.rand(i * 3 + k) for i in range(3) for k, c in enumerate("xyz")}
    faces = materialize(spark.range(3000).select((F.col("id") % 3).alias("scene_id"), F.col("id").alias("fid")).withColumns(corner), "faces")
    got = M.sample_surface(M.face_geometry(faces), ["scene_id"], 1777, ["fid"]).groupBy("scene_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 1777), (1, 1777), (2, 1777)]
    assert M.sample_surface(M.face_geometry(faces), [], 501, ["fid"]).count() == 501


def test_two_pair_sequences_are_scored(spark):
    from posegrid.plans import evaluation as E

    cols = "seq_id long, frame_idx long, tx double, ty double, tz double"
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0), (2, 2, 0.0, 2.0, 0.0)], cols)
    est = gt.withColumn("tx", F.col("tx") + 5)
    got = {r.seq_id: r for r in E.trajectory_evaluation(gt, est).collect()}
    assert got.keys() == {1, 2} and got[1].pairs == 2 and all(r.rmse < 1e-6 for r in got.values())


def test_runs_without_a_transform_are_no_successes(spark):
    from posegrid.operators.sampling import benchmark_summary

    trials = spark.createDataFrame([("m", 1.0, 0.0, 0.0), ("m", None, None, None)], "method string, rot_deg double, trans double, scale_ratio double")
    assert benchmark_summary(trials).first().success_rate == 0.5


def test_draws_never_repeat_a_match(spark):
    from posegrid.plans import geometric

    rows = spark.range(3000).select(F.col("id").alias("candidate"), (F.col("id") % 7 + 4).alias("n"))
    d = geometric.distinct_draws(rows, "n", ["candidate"], 3).select("n", F.array(*[f"i{k}" for k in range(4)]).alias("i"))
    assert d.filter((F.size(F.array_distinct("i")) < 4) | (F.array_min("i") < 0) | (F.array_max("i") >= F.col("n"))).count() == 0
    # every place is drawn about equally often
    share = d.filter("n = 4").select(F.explode("i").alias("i")).groupBy("i").count().toPandas()
    assert len(share) == 4 and share["count"].nunique() == 1


def test_rounds_stop_at_the_stated_confidence(spark):
    from posegrid.plans import geometric
    from posegrid.plans import registration as R

    pts = spark.range(120).select(F.lit("s").alias("scene_id"), F.lit(0).cast("long").alias("trial_id"), F.col("id").alias("src_id"), F.col("id").alias("dst_id"), *[(F.col("id") * k % 101 / 10.0).alias("s" + a) for a, k in zip("xyz", (7, 13, 29))])
    true = F.col("src_id") % 3 == 0
    matches = pts.select("*", *[F.when(true, F.col("s" + a) + 1.0).otherwise(F.col("src_id") * k % 89 / 8.0).alias("d" + a) for a, k in zip("xyz", (31, 17, 3))])
    matches = matches.unionByName(pts.limit(3).withColumn("trial_id", F.lit(1).cast("long")).select("*", *[F.col("s" + a).alias("d" + a) for a in "xyz"]))  # too few
    trace = []
    (got,) = geometric.search_hypotheses(matches, R.Config(hypothesis_dist=0.01, first_draws=64), trace=trace).collect()
    assert got.n == 120 and got.hits == 40 and abs(got.t0 - 1) < 1e-6 and abs(got.m00 - 1) < 1e-6
    assert got.needed == 557 and got.needed <= got.drawn < 2 * got.needed  # log(0.001) / log(1 - 3**-4), rounded up
    assert [t.first()["drawn"] for t in trace] == sorted(t.first()["drawn"] for t in trace) and len(trace) <= 5
    scrambled = matches.withColumns({"d" + a: F.xxhash64("src_id", F.lit(i)) % 1000 / 10.0 for i, a in enumerate("xyz")})
    (lost,) = geometric.search_hypotheses(scrambled, R.Config(hypothesis_dist=1e-9, hypotheses=300, first_draws=200)).collect()
    assert lost.drawn == 300 and lost.hits == 0 and lost.m00 is None
