"""Blocked forms must equal the plain windows, whatever the block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from posegrid.operators import matching, ordered
from posegrid.operators import trajectory as T


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({"seq_id": np.where(np.arange(n) < 330, 0, 1), "ts": np.cumsum(rng.exponential(1.0, n)).round(3), "v": rng.integers(0, 40, n) / 4.0})
    pdf["frame_idx"] = pdf.groupby("seq_id").cumcount()
    return spark.createDataFrame(pdf).repartition(3).cache()


def test_rank_and_percentiles(series):
    got = ordered.rank_within(series, ["seq_id"], ["ts"], "rn", rows_per_block=37)
    assert got.filter("rn != frame_idx").count() == 0
    for lower in (False, True):
        a = ordered.percentiles(series, ["seq_id"], "v", {"p": 0.5, "q": 0.02}, lower).toPandas().sort_values("seq_id")
        b = ordered.percentiles(series, ["seq_id"], "v", {"p": 0.5, "q": 0.02}, lower, rows_per_block=20).toPandas().sort_values("seq_id")
        assert np.allclose(a[["p", "q"]], b[["p", "q"]])


def test_lag_and_prefix_sum(series):
    w = Window.partitionBy("seq_id").orderBy("frame_idx")
    plain = series.select("seq_id", "frame_idx", F.lag("v", 2).over(w).alias("a"), F.lead("v").over(w).alias("b"), F.sum("v").over(w).alias("s")).toPandas()
    got = ordered.lag_by_index(series, ["seq_id"], "frame_idx", {"a": ("v", 2), "b": ("v", -1)}, block=16)
    got = ordered.prefix_sum(got, ["seq_id"], "frame_idx", {"s": F.col("v")}, inclusive=True, block=16).select("seq_id", "frame_idx", "a", "b", "s").toPandas()
    key = ["seq_id", "frame_idx"]
    pd.testing.assert_frame_equal(plain.sort_values(key).reset_index(drop=True), got.sort_values(key).reset_index(drop=True), check_dtype=False)


def _greedy(ts, gap):
    out = []
    for t in ts:
        if not out or t - out[-1] > gap:
            out.append(t)
    return out


@pytest.mark.parametrize("block", [1 << 20, 29])
def test_thinning(series, block):
    pdf = series.toPandas().sort_values(["seq_id", "ts"])
    want = {(k, t) for k, g in pdf.groupby("seq_id") for t in _greedy(list(g.ts), 3.7)}
    got = T.thin_min_gap(series, 3.7, rows_per_block=block).toPandas()
    assert set(zip(got.seq_id, got.ts)) == want


def test_nearest_in_time_blocks_and_ties(spark, series):
    left = series.select("seq_id", F.col("frame_idx").cast("long").alias("left_id"), "ts")
    right = series.filter("frame_idx % 3 = 0").select("seq_id", F.col("frame_idx").cast("long").alias("right_id"), (F.col("ts") + 0.4).alias("ts"))
    a = matching.nearest_in_time(left, right, ["seq_id"], 2.0).toPandas()
    b = matching.nearest_in_time(left, right, ["seq_id"], 2.0, rows_per_block=31).toPandas()
    key = ["seq_id", "left_id"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))
    lft = spark.createDataFrame([(1, 10.0)], "left_id long, ts double")
    rgt = spark.createDataFrame([(5, 9.0), (6, 11.0)], "right_id long, ts double")
    assert matching.nearest_in_time(lft, rgt, [], 2.0).first()["right_id"] == 5
    assert matching.nearest_in_time(lft, rgt, [], 1.0).count() == 0


def test_one_to_one_equals_greedy(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        a, b = np.unique(rng.integers(0, 60, 25) / 4.0), np.unique(rng.integers(0, 60, 25) / 4.0 + 0.125)
        cand = sorted((abs(x - y), x, y) for x in a for y in b if abs(x - y) < 1.0)
        ua, ub, want = set(), set(), set()
        for _d, x, y in cand:
            if x not in ua and y not in ub:
                ua.add(x), ub.add(y), want.add((x, y))
        fa = spark.createDataFrame([(float(x),) for x in a], "ts double")
        fb = spark.createDataFrame([(float(x),) for x in b], "ts double")
        got = matching.match_one_to_one(fa, fb, max_difference=1.0).toPandas()
        assert set(zip(got.a, got.b)) == want


def greedy(a, b, gate):
    """Best-first pairs over all candidates."""
    left, right, out = set(a), set(b), []
    for _, x, y in sorted((abs(x - y), x, y) for x in a for y in b if abs(x - y) < gate):
        if x in left and y in right:
            left.discard(x)
            right.discard(y)
            out.append((x, y))
    return sorted(out)


def test_blocks_of_stamps_pair_like_one(spark):
    from posegrid.operators import matching

    rng = np.random.default_rng(21)
    for gate, span in ((0.5, 400), (3.0, 60)):
        a, b = (sorted(set(np.round(rng.uniform(0, span, 300), 2).tolist())) for _ in range(2))
        fa, fb = (spark.createDataFrame([(x,) for x in v], "ts double") for v in (a, b))
        got = matching.match_one_to_one(fa, fb, max_difference=gate, block_bits=5).collect()
        assert sorted((r.a, r.b) for r in got) == greedy(a, b, gate)


def test_growing_gaps_are_one_pass(spark, monkeypatch):
    """A chain in which each pair hangs on the one before: rounds of mutual nearest stamps would need one round for each."""
    from posegrid.operators import matching

    n, rounds = 100_000, []
    real = matching._solved_blocks
    monkeypatch.setattr(matching, "_solved_blocks", lambda *x: rounds.append(1) or real(*x))
    t = np.cumsum(1.0 + np.arange(n) * 1e-6)
    stamps = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "ts": t}))
    got = matching.match_one_to_one(stamps.filter("i % 2 = 0"), stamps.filter("i % 2 = 1"), max_difference=2.0, block_bits=15)
    assert got.count() == n // 2 and got.filter("b < a").count() == 0 and len(rounds) <= 6
