"""Folders of text are written by many tasks."""

import os
import re
import uuid

from pyspark.sql import functions as F

from posegrid.session import shared_dir, write_folders
from posegrid.sources import poses as P
from posegrid.sources import sinks


def _eye():
    return [F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)]


def _parts(path):
    return {re.match(r"part-(\d+)", f)[1] for _, _, names in os.walk(path.removeprefix("file:")) for f in names if f.startswith("part-")}


def test_small_folders_are_written_by_many_tasks(spark):
    p = spark.range(120).select((F.col("id") % 40).alias("seq_id"), F.floor(F.col("id") / 40).cast("int").alias("frame_idx"), *_eye(), F.col("id").cast("double").alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
    path = os.path.join(shared_dir(spark), f"lines-{uuid.uuid4().hex}")
    P.write_pose_lines(p.orderBy(F.desc("frame_idx")), path)
    back = {(int(r.seq_id), r.frame_idx): r.tx for r in P.read_pose_lines(spark, path).collect()}
    assert back == {(i % 40, i // 40): float(i) for i in range(120)}
    assert len(_parts(path)) > 1
    pairs = p.select("seq_id", *[F.col("tx").alias(c) for c in ("a", "ax", "ay", "az", "b", "bx", "by", "bz")])
    path = os.path.join(shared_dir(spark), f"pairs-{uuid.uuid4().hex}")
    sinks.write_associations(pairs, path)
    assert spark.read.text(path).count() == 120 and len(_parts(path)) > 1


def test_folders_are_those_of_the_text_sink(spark, tmp_path):
    rows = [(None if i == 7 else i % 5, "" if i % 11 == 0 else "a=b/c d%é"[: i % 9], i, None if i == 3 else f"line {i}\u00fc") for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id long, `a b` string, at int, value string")
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    write_folders(df, ours, ["seq_id", "a b"], ["at"])
    df.repartition(3, "seq_id", "a b").sortWithinPartitions("seq_id", "a b", "at").drop("at").write.partitionBy("seq_id", "a b").text(theirs)
    held = [{os.path.relpath(d, top): [open(os.path.join(d, f), "rb").read() for f in names if f.startswith("part-")] for d, _, names in os.walk(top) if "=" in os.path.basename(d)} for top in (ours, theirs)]
    assert held[0] == held[1] and len(held[0]) > 20
    write_folders(df.limit(1), ours, ["seq_id", "a b"], ["at"])  # takes the place of what was there
    assert spark.read.text(ours).count() == 1
    assert not [f for d, _, names in os.walk(ours) for f in names if f.endswith(".crc") and f.startswith(".part")]  # a process for each mode
