"""Streams in several micro-batches against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posegrid.session import shared_dir
from posegrid.streaming import frames as ST
from posegrid.streaming.ordered_state import InOrder, predicted, thinned

START = 1_700_000_000_000_000


def _stream(spark, name, batches, schema):
    import os
    import uuid

    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).drop("us").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _nearest(rows, kind, seq, at, gate):
    c = [(abs(us - at), us, i) for s, k, i, us in rows if k == kind and s == seq and us is not None and abs(us - at) < gate]
    return min(c) if c else None


@pytest.mark.parametrize("with_pose", [True, False])
def test_nearest_partners_of_two_interleaved_sequences(spark, with_pose):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(240):  # seconds apart, many equal stamps, neighbours in time arrive out of order
        rows.append((int(i % 2), ("image", "depth", "pose", "other")[int(draw.integers(0, 4))], i, START + int(draw.integers(0, 400)) * 500_000))
    rows = sorted(rows, key=lambda r: r[3] + int(draw.integers(-3_000_000, 3_000_000)))
    rows += [(0, "depth", 900, None), (None, "image", 901, START + 100)]
    closing = [(7, "depth", 999, START + 86_400_000_000)]
    s = _stream(spark, "nearest", [rows[:80], rows[80:160], rows[160:], closing], "seq_id long, kind string, id long, us long")
    got = ST.drain(ST.associate_stream(s, "2 seconds", width="10 seconds", with_pose=with_pose, delay="20 seconds"), "append", "nearest").collect()
    want = {}
    for seq, kind, i, us in rows:
        if kind == "image" and seq is not None:
            d, p = _nearest(rows, "depth", seq, us, 2_000_000), _nearest(rows, "pose", seq, us, 2_000_000)
            if d and (p or not with_pose):
                want[i] = (seq, d[2], d[0] / 1e6, p[2] if p else None, p[0] / 1e6 if p else None)
    assert {r.image_id: (r.seq_id, r.depth_id, r.depth_dt, r.pose_id, r.pose_dt) for r in got} == want
    assert len(got) == len(want) > 10


def test_order_of_time_and_rest(spark):
    """Two sequences, rows of one micro-batch late but within the delay; after a rest the prediction starts anew."""
    t = [0, 3, 1, 2, 7, 5, 6, 4, 40, 42, 41, 43]
    rows = [(s, k, START + k * 1_000_000, float(k * k + s), 0.0, 1.0) for k in t for s in (1, 2)]
    closing = [(9, 0, START + 10**10, 0.0, 0.0, 0.0)]
    cols = "seq_id long, frame_idx long, us long, tx double, ty double, tz double"
    s = _stream(spark, "order", [rows[:6], rows[6:16], rows[16:], closing], cols)
    got = {(r.seq_id, r.frame_idx): r.pred_tx for r in ST.drain(ST.predict_stream(s, idle="10 seconds", delay="5 seconds"), "append", "order").collect()}
    for q in (1, 2):
        x = {k: k * k + q for k in t}
        for k in t:
            want = None if k in (0, 40) else x[k - 1] if k in (1, 41) else 2.0 * x[k - 1] - x[k - 2]
            assert got[(q, k)] == want, (q, k)
    s = _stream(spark, "thin", [rows[:6], rows[6:16], rows[16:], closing], cols)
    kept = ST.drain(ST.thin_stream(s.select("seq_id", "ts"), "2 seconds", delay="5 seconds"), "append", "thin").filter("seq_id = 1")
    assert sorted((r.us - START) // 1_000_000 for r in kept.select(F.unix_micros("ts").alias("us")).collect()) == [0, 3, 6, 40, 43]


def test_rules_do_not_depend_on_where_batches_end():
    draw = np.random.default_rng(3)
    us = np.sort(draw.integers(0, 500, 300))
    rows = pd.DataFrame({"us": us, "frame_idx": np.arange(300), "tx": draw.normal(size=300), "ty": 0.0, "tz": np.arange(300.0)})
    for rule in (thinned(7), predicted(("tx", "ty", "tz"), 4)):
        whole, end = rule(rows, None)
        for size in (1, 2, 37):
            memory, parts = None, []
            for at in range(0, 300, size):
                out, memory = rule(rows[at : at + size], memory)
                parts.append(out)
            pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole)
            assert memory[0] == end[0]


def test_many_sequences_share_few_keys_of_state(spark, monkeypatch):
    """Calls and requests to the state cost the same however few rows they carry, so they go by shard; a null sequence stays one."""
    calls = spark.sparkContext.accumulator(0)
    handle = InOrder.handleInputRows

    def counted(self, key, rows, timers):
        calls.add(1)
        return handle(self, key, rows, timers)

    monkeypatch.setattr(InOrder, "handleInputRows", counted)
    monkeypatch.setattr(InOrder, "__module__", "__main__")  # sent by value, so that workers count, too
    big = 2**53 + 1
    seqs = [None, 0, big, big + 1, *range(1, 400)]
    rows = [(s, START + k * 1_000_000 + (s or 0) % 7) for k in (0, 2, 1, 5, 4, 9) for s in seqs]
    s = _stream(spark, "many", [rows[: len(rows) // 2], rows[len(rows) // 2 :], [(5000, START + 10**10)]], "seq_id long, us long")
    monkeypatch.setattr(ST.state.in_order, "__defaults__", (4,))
    kept = ST.drain(ST.thin_stream(s, "3 seconds", delay="10 seconds"), "append", "many").select("seq_id", F.unix_micros("ts").alias("us")).collect()
    want = {(s, START + k * 1_000_000 + (s or 0) % 7) for k in (0, 4, 9) for s in seqs}
    assert {(r.seq_id, r.us) for r in kept} - {(5000, START + 10**10)} == want
    assert 0 < calls.value <= 4 * 3


def test_candidates_grow_with_the_images(spark, tmp_path):
    rng = np.random.default_rng(12)
    schema = "id long, kind string, ts timestamp"
    rows = [(i, "image" if i % 3 else "depth", int(rng.integers(0, 3_000_000_000))) for i in range(1200)]
    rows += [(None, "image", 500_000_000), (5000, "image", -400_000_000), (5001, "depth", -400_300_000), (5002, "depth", -399_500_000), (5003, "image", None)]
    order = rng.permutation(len(rows))
    for k in range(3):  # stamps of all times come in every batch
        part = spark.createDataFrame([rows[i] for i in order[k::3]], "id long, kind string, us long")
        part.select("id", "kind", F.timestamp_micros(F.col("us") + START).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    side = lambda kind: stream.filter(F.col("kind") == kind).drop("kind")
    found = ST.drain(ST.candidate_associations(side("image"), side("depth"), 200.0, "2 hours"), "append", "candidates")
    images, depths = ([(i, us) for i, k, us in rows if k == kind and us is not None] for kind in ("image", "depth"))
    pairs = sum(abs(a - b) < 200_000_000 for _, a in images for _, b in depths)
    assert len(images) < found.count() < min(pairs / 5, 6 * len(images)) and found.filter("dt >= 200 OR image_ts IS NULL").isEmpty()
    got = {r.image_id: (r.other_id, r.dt) for r in ST.nearest_association(found).collect()}
    want = {}
    for i, a in images:
        gap, _, other = min((abs(a - b), b, j) for j, b in depths)
        if gap < 200_000_000:
            want[i] = (other, gap / 1e6)
    assert got == want and None in got and got[5000] == (5001, 0.3)
