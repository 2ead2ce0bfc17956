"""Streaming forms of the frame operators.

Each function turns streaming DataFrames into a streaming DataFrame; ``drain`` runs one to the end
of its available input into a table in the shared folder (tests, backfills).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rays
from ..session import shared_dir
from . import ordered_state as state


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run the query over all available input; every micro-batch is stored under its own id, so a
    replayed batch overwrites itself. The result carries ``batch``."""
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")

    def save(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{base}/out/b{batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def latest_update(updates: DataFrame, keys) -> DataFrame:
    """Last emitted row per key of an update-mode output."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_v")).select(*keys, "_v.*")


def running_confusion(pairs: DataFrame, keys=("seq_id",)) -> DataFrame:
    """Running (gt, pred) counts; scores follow from them in ``segmentation.class_scores``."""
    return pairs.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def candidate_associations(images: DataFrame, others: DataFrame, max_dt: float, delay: str = "10 minutes") -> DataFrame:
    """Stamps within the gate of an image that can be its nearest; ``nearest_association`` picks it from these rows.

    Both sides have ``id`` (a whole number) and ``ts`` (timestamp). In each micro-batch an image has a row for the closest new stamp not
    after it and for the closest new one after it, and at its first for the closest of all, so rows grow with the images however many
    stamps are within the gate. Of stamps at the same time the smallest id counts. State is kept by blocks of time and expires with them.
    """
    sides = [df.withWatermark("ts", delay).select(F.lit(side).alias("side"), "id", "ts") for side, df in enumerate((images, others))]
    c = state.closest_stamps(sides[0].unionByName(sides[1]), max_dt)
    own = {n: F.when(F.col(f"with_{n}") == 1, F.col(n)).cast(df.schema["id"].dataType).alias(n) for n, df in (("image_id", images), ("other_id", others))}
    stamps = [F.timestamp_micros(f"{n}_us").alias(f"{n}_ts") for n in ("image", "other")]
    return c.select(own["image_id"], own["other_id"], *stamps, (F.abs(F.col("image_us") - F.col("other_us")) / 1e6).alias("dt"))


def nearest_association(candidates: DataFrame) -> DataFrame:
    """Nearest partner per image from the joined rows; ties to the earlier stamp."""
    best = F.min_by(F.struct("other_id", "dt"), F.struct("dt", "other_ts"))
    return candidates.groupBy("image_id").agg(best.alias("b")).select("image_id", "b.*")


def associate_stream(stamps: DataFrame, max_dt: str, width: str | None = None, with_pose: bool = True, delay: str = "10 minutes") -> DataFrame:
    """The nearest depth and pose stamps of every image, by sequence, decided inside the stream.

    ``stamps`` has ``seq_id long, kind string (image, depth, pose), id long, ts timestamp``. An image needs a depth stamp, and with
    ``with_pose`` a pose stamp, less than ``max_dt`` away; without, the pose is null where none is. State is kept by sequence and block
    of ``width`` of time (64 gates if not given), so that a long sequence is many keys, and a block leaves the state when its images are
    emitted: once the watermark has passed its end by the gate. Ties go to the earlier stamp, then to the smaller id; stamps of other
    kinds or without a time take no part.
    """
    gate = state.micros(max_dt)
    out = state.nearest_frames(stamps, gate, 64 * gate if width is None else state.micros(width), with_pose, delay)
    gaps = [(F.col(n + "_us") / 1e6).alias(n + "_dt") for n in ("depth", "pose")]
    return out.select("seq_id", "image_id", F.timestamp_micros("image_us").alias("image_ts"), "depth_id", gaps[0], "pose_id", gaps[1])


def thin_stream(samples: DataFrame, min_gap: str, key: str = "seq_id", delay: str = "10 minutes") -> DataFrame:
    """Minimum-gap thinning in order of time (``key long, ts timestamp``).

    What is remembered of a key, its last kept stamp, leaves the state when ``min_gap`` has passed: it decides nothing after that.
    """
    gap = state.micros(min_gap)
    out = state.in_order(samples.select(key, "ts"), state.thinned(gap), [key], ["us"], "at long, last long", "us long", gap, "ts", delay)
    return out.select(key, F.timestamp_micros("us").alias("ts"))


def predict_stream(poses: DataFrame, key: str = "seq_id", idle: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Constant-speed prediction of ``tx, ty, tz`` from the two poses before, in order of ``ts`` and ``frame_idx``.

    A pose more than ``idle`` after the one before starts a new track: its prediction is null, the next one's is the pose before. By
    then the key has left the state.
    """
    axes = ("tx", "ty", "tz")
    cols = [", ".join(f"{p}{a} double" for a in axes) for p in ("a", "b", "pred_")]
    rest = state.micros(idle)
    return state.in_order(
        poses, state.predicted(axes, rest), [key], ["us", "frame_idx", *axes],
        f"at long, before long, known int, {cols[0]}, {cols[1]}", f"frame_idx long, {cols[2]}", rest, "ts", delay,
    ).select(key, "frame_idx", *[F.nanvl(F.col("pred_" + a), F.lit(None).cast("double")).alias("pred_" + a) for a in axes])


def every_nth_stream(frames: DataFrame, step: int) -> DataFrame:
    return frames.filter(F.col("frame_idx") % step == 0)


def windowed_losses(samples: DataFrame, truncation: float, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Band losses per time window of frames; ``ts`` is a timestamp."""
    w: Column = F.window("ts", width, slide) if slide else F.window("ts", width)
    return samples.withWatermark("ts", delay).groupBy(w.alias("w")).agg(*rays.sdf_loss_columns(truncation), F.count(F.lit(1)).alias("n"))
