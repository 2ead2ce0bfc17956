"""Methods dropped into a folder are found, listed, and run on the workers; depth-free rays are sampled in a chain."""

import pytest
from pyspark.sql import functions as F

from posegrid.operators import rays
from posegrid.plans import registration as R

MEAN_SHIFT = '''
from pyspark.sql import functions as F

from posegrid.plans import registration as R


def halved(rows):
    rows["x"] = [half(v) for v in rows["x"]]
    return rows


def half(v):
    return v / 2.0


@R.register_method("{name}")
def method(src, dst, cfg):
    own = src.select(*R.SRC, "x").groupBy(*R.SRC).applyInPandas(halved, src.select(*R.SRC, "x").schema)
    return own.groupBy(*R.SRC).agg(F.avg("x").alias("t0"))
'''


def test_methods_of_a_folder(spark, tmp_path):
    (tmp_path / "experimental").mkdir()
    (tmp_path / "posegrid_drop_a.py").write_text(MEAN_SHIFT.replace("{name}", "dropped"))
    (tmp_path / "experimental" / "posegrid_drop_b.py").write_text(MEAN_SHIFT.replace("{name}", "tried"))
    (tmp_path / "notes.txt").write_text("no module")
    assert R.discover(spark, str(tmp_path)) == ["dropped", "tried"] == R.discover(spark, str(tmp_path))
    assert {"baseline", "dropped", "proposed", "tried"} <= set(R.available_methods()) and R.available_methods() == sorted(R.available_methods())
    src = spark.createDataFrame([("s", 0, 2.0), ("s", 0, 4.0), ("t", 1, 8.0)], "scene_id string, trial_id long, x double")
    got = {tuple(r) for r in R.get_method("tried")(src, src, R.Config()).collect()}
    assert got == {("s", 0, 1.5), ("t", 1, 4.0)}
    for name in ("dropped", "tried"):
        del R.METHODS[name]


def test_unknown_method_and_taken_name(spark, tmp_path):
    with pytest.raises(KeyError, match="baseline"):
        R.get_method("nothing")
    (tmp_path / "json.py").write_text("")
    with pytest.raises(ValueError, match="json"):
        R.discover(spark, str(tmp_path))


def ball(samples):
    return samples.withColumn("sdf", F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2) - 1.0)


@pytest.mark.parametrize("deterministic", [True, False])
def test_chained_samples_meet_the_surface(spark, deterministic):
    """From x = -3 along x through a unit ball: its front is at depth 2, and fine samples gather around it."""
    rows = [(i, -3.0, 0.01 * i, 0.02, 1.0, 0.01, 0.013, d) for i, d in enumerate((0.0, None, 0.0, 2.5))]
    r = spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, depth double")
    out = rays.chained_samples(r, (-4, -4, -4), (4, 4, 4), ball, 32, 16, deterministic=deterministic).toPandas()
    assert sorted(out["ray_id"].unique()) == [0, 1, 2]
    for _, one in out.groupby("ray_id"):
        one = one.sort_values("k")
        assert list(one["k"]) == list(range(48)) and one["fine"].sum() == 16
        assert one["z"].is_monotonic_increasing and one["z"].between(0, 7.02).all()
        assert (one.loc[one["fine"], "z"] - 2.0).abs().median() < 0.35
        assert (one.loc[~one["fine"], "z"] - 2.0).abs().median() > 1.0


def test_chained_samples_of_no_rays(spark):
    r = spark.createDataFrame([], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, depth double")
    assert rays.chained_samples(r, (-4, -4, -4), (4, 4, 4), ball).count() == 0
