"""Pose and time-stamp text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..session import write_folders

ROT = [f"r{i}{j}" for i in range(3) for j in range(3)]


def _pose_columns(v) -> list:
    """Row-major 4x4 values to pose columns with the camera axes flipped."""
    m = [[v[4 * i + j] for j in range(3)] for i in range(3)]
    r = g.flip_camera(m)
    return [*g.named(r, "r"), v[3].alias("tx"), v[7].alias("ty"), v[11].alias("tz")]


def read_pose_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One 4x4 matrix per line, the line number being the frame; one file per sequence, named by its
    file or by a ``seq_id=`` folder.

    The byte offset of a line is not available, so each file is one row and is split in place; a
    pose file holds one short line per frame.
    """
    files = spark.read.text(path, wholetext=True)
    seq = F.col("seq_id") if "seq_id" in files.columns else F.col("_metadata.file_name")
    lines = files.select(
        seq.alias("seq_id"), F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("frame_idx", "line")
    )
    if limit is not None:
        lines = lines.filter(F.col("frame_idx") < limit)
    v = F.split(F.trim("line"), r"\s+").cast("array<double>")
    return lines.withColumn("_v", v).filter(F.size("_v") >= 12).select("seq_id", "frame_idx", *_pose_columns(F.col("_v")))


def read_pose_directory(spark: SparkSession, path: str) -> DataFrame:
    """One 4x4 text file per frame; the file name's number is the frame."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("seq_id"),
        F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("int").alias("frame_idx"),
        F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").cast("array<double>").alias("_v"),
    )
    return files.select("seq_id", "frame_idx", *_pose_columns(F.col("_v")))


STAMP_PATH = T.StructType([T.StructField("stamp", T.DoubleType()), T.StructField("path", T.StringType())])
STAMP_POSE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("stamp", "tx", "ty", "tz", "qx", "qy", "qz", "qw")])


def read_stamped(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Space-delimited list; comment lines and header rows that are no numbers are dropped."""
    rows = spark.read.csv(path, sep=" ", comment="#", schema=schema, mode="PERMISSIVE")
    return rows.filter(F.col("stamp").isNotNull())


def read_stamped_poses(spark: SparkSession, folder: str) -> DataFrame:
    """Poses from the first existing of ``groundtruth.txt`` and ``pose.txt``; (x,y,z,w) quaternions."""
    found = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("n")).filter(F.col("n").isin("groundtruth.txt", "pose.txt")).agg(F.min("n")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no pose list in {folder}")
    rows = read_stamped(spark, f"{folder}/{found}", STAMP_POSE)
    r = g.quat_to_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return rows.select(F.col("stamp").alias("ts"), *g.named(r, "r"), "tx", "ty", "tz")


def write_pose_lines(poses: DataFrame, path: str, keys=("seq_id",)) -> None:
    """One file per sequence in frame order (flipped back), the format ``read_pose_lines`` reads."""
    r = g.flip_camera(g.mat("r"))
    rows = [[*r[i], F.col(t)] for i, t in enumerate(("tx", "ty", "tz"))]
    text = F.concat_ws(" ", *[c.cast("string") for row in rows for c in row], F.lit("0 0 0 1"))
    out = poses.select(*keys, "frame_idx", text.alias("value"))
    write_folders(out, path, keys, ["frame_idx"])
