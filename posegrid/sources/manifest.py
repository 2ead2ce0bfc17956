"""Frame manifests: ordering, pairing by position, and the latest snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import rank_within


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File paths under a folder; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")


def first_number(path: Column) -> Column:
    """First digit run of the file name, as a number."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(\d+)", 1).cast("long")


def frame_manifest(paths: DataFrame, keys=("seq_id",), lexicographic: bool = False) -> DataFrame:
    """Position of each file within its (keys, kind), by number or by name.

    ``paths`` has ``keys, kind, path``. Kinds pair up by position, not by number.
    """
    group = [*keys, "kind"]
    p = paths.withColumn("num", first_number(F.col("path")))
    if lexicographic:
        # Names are ordered as text; the numeric block key is the hash-free prefix code of the name.
        code = F.conv(F.substring(F.hex(F.substring_index("path", "/", -1)), 1, 12), 16, 10).cast("long")
        return rank_within(p.withColumn("_code", code), group, ["_code", "path"], "pos").drop("_code")
    return rank_within(p, group, ["num", "path"], "pos")


def pair_by_position(manifest: DataFrame, kinds, keys=("seq_id",), strict: bool = False) -> DataFrame:
    """One row per position with a column per kind; strict mode raises on unequal counts."""
    keys = list(keys)
    wide = manifest.filter(F.col("kind").isin(list(kinds))).groupBy(*keys, "pos").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in kinds]
    )
    whole = F.lit(True)
    for k in kinds:
        whole = whole & F.col(k).isNotNull()
    if strict and not wide.filter(~whole).isEmpty():
        raise ValueError(f"file counts of {list(kinds)} differ")
    return wide.filter(whole)


def unpaired(manifest: DataFrame, kind: str, other: str, keys=("seq_id",)) -> DataFrame:
    """Files of ``kind`` whose position has no file of ``other``."""
    b = manifest.filter(F.col("kind") == other).select(*keys, "pos")
    return manifest.filter(F.col("kind") == kind).join(b, [*keys, "pos"], "left_anti")


def latest_snapshot(paths: DataFrame, marker: str = "tar", keys=()) -> DataFrame:
    """Last name in text order among files whose name contains the marker."""
    return paths.filter(F.col("path").contains(marker)).groupBy(*keys).agg(F.max("path").alias("path"))
