"""Result sinks: small tables as single files, and the frozen reference transform."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_folders

SIM3 = [f"m{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
TRANSFORM = T.StructType([T.StructField("scene_id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in SIM3])


def write_results(summary: DataFrame, path: str) -> None:
    """Benchmark summary: one row per method, so one CSV file."""
    summary.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_adopted(ranking: DataFrame, path: str) -> None:
    """The ranking as JSON lines with the adopted method flagged."""
    ranking.coalesce(1).write.mode("overwrite").json(path)


def write_trajectory(deviation: DataFrame, path: str) -> None:
    """Per-iteration deviations with six decimals."""
    out = deviation.select("iter", *[F.format_string("%.6f", F.col(c)).alias(n) for c, n in (("rot_deg", "rot_deg"), ("trans", "trans_m"), ("scale_ratio", "scale_ratio"))])
    out.write.mode("overwrite").csv(path, header=True)


def _six_decimals(df: DataFrame, columns) -> DataFrame:
    return df.select("seq_id", F.concat_ws(" ", *[F.format_string("%.6f", F.col(c)) for c in columns]).alias("line"))


def write_associations(pairs: DataFrame, path: str) -> None:
    """Lines ``a ax ay az b bx by bz`` of matched stamps, in a folder for each sequence."""
    write_folders(_six_decimals(pairs, ["a", "ax", "ay", "az", "b", "bx", "by", "bz"]), path, ["seq_id"])


def write_aligned(track: DataFrame, path: str) -> None:
    """Lines ``ts x y z`` of aligned trajectories, in a folder for each sequence."""
    write_folders(_six_decimals(track, ["ts", "tx", "ty", "tz"]), path, ["seq_id"])


def save_transform(transform: DataFrame, path: str) -> None:
    """Freeze one transform per scene."""
    transform.select(F.col("scene_id").cast("string"), *SIM3).coalesce(1).write.mode("overwrite").parquet(path)


def load_transform(spark: SparkSession, path: str) -> DataFrame:
    """The frozen transforms; an empty table when none were saved."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], TRANSFORM)
    return spark.read.schema(TRANSFORM).parquet(path)
