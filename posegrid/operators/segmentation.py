"""Pixel-pair scores: confusion counts, IoU families, image errors.

Everything starts from counts per (gt, pred), which combine before the shuffle; scores are
arithmetic over at most classes-squared rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def confusion(pairs: DataFrame, keys=()) -> DataFrame:
    return pairs.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, n_classes: int, keys=()) -> DataFrame:
    """Intersection, row and column totals per class from confusion counts with 0 <= gt < n."""
    keys = list(keys)
    c = counts.filter((F.col("gt") >= 0) & (F.col("gt") < n_classes))
    hit = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)
    rows = c.groupBy(*keys, F.col("gt").alias("label")).agg(F.sum("n").alias("gt_n"), F.sum(hit).alias("inter"), F.lit(0).cast("long").alias("pred_n"))
    cols = c.groupBy(*keys, F.col("pred").alias("label")).agg(F.lit(0).cast("long").alias("gt_n"), F.lit(0).cast("long").alias("inter"), F.sum("n").alias("pred_n"))
    both = rows.unionByName(cols).groupBy(*keys, "label").agg(*[F.sum(x).alias(x) for x in ("gt_n", "pred_n", "inter")])
    union = F.col("gt_n") + F.col("pred_n") - F.col("inter")
    return both.withColumn("union_n", union).withColumn("iou", F.try_divide(F.col("inter").cast("double"), F.col("union_n")))


def score_summary(per_class: DataFrame, keys=()) -> DataFrame:
    """Mean IoU (with and without class 0), frequency-weighted IoU and pixel accuracy."""
    total = F.sum("gt_n")
    return per_class.groupBy(*keys).agg(
        F.avg("iou").alias("miou"), F.avg(F.when(F.col("label") != 0, F.col("iou"))).alias("miou_no_back"),
        (F.sum(F.col("iou") * F.col("gt_n")) / total).alias("freq_iou"), (F.sum("inter") / total).alias("pixel_acc"), total.alias("labeled"),
    )


def running_scores(per_update: DataFrame, n_classes: int, keys, index: str) -> DataFrame:
    """Accumulated pixel accuracy and mIoU after each update of confusion counts.

    ``per_update`` has ``keys, index, gt, pred, n``; the running sums are over per-update class
    totals, so their size is updates times classes.
    """
    keys = list(keys)
    c = class_scores(per_update, n_classes, keys + [index])
    wide = c.groupBy(*keys, index).agg(
        F.sum("inter").alias("correct"), F.sum("gt_n").alias("labeled"),
        *[F.sum(F.when(F.col("label") == k, F.col(s))).alias(f"{s}_{k}") for k in range(n_classes) for s in ("inter", "union_n")],
    )
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    run = wide.select(
        *keys, index, F.sum("correct").over(w).alias("correct"), F.sum("labeled").over(w).alias("labeled"),
        *[F.coalesce(F.sum(f"{s}_{k}").over(w), F.lit(0)).alias(f"{s}_{k}") for k in range(n_classes) for s in ("inter", "union_n")],
    )
    ious = F.filter(
        F.array(*[F.when(F.col(f"union_n_{k}") > 0, F.col(f"inter_{k}") / (EPS + F.col(f"union_n_{k}"))) for k in range(n_classes)]),
        lambda x: x.isNotNull(),
    )
    mean = F.try_divide(F.aggregate(ious, F.lit(0.0), lambda a, x: a + x), F.size(ious))
    return run.select(*keys, index, (F.col("correct") / (EPS + F.col("labeled"))).alias("pix_acc"), mean.alias("miou"))


def accumulated_scores(pairs: DataFrame, n_classes: int, keys=()) -> DataFrame:
    """Final accumulated pixel accuracy and mIoU over classes with a non-empty union.

    ``pairs`` has ``gt``, ``pred`` and optionally ``pred_acc``, the prediction used for accuracy
    (argmax of integer-truncated scores) where it differs from the one used for IoU.
    """
    keys = list(keys)
    acc = "pred_acc" if "pred_acc" in pairs.columns else "pred"
    counts = pairs.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(acc) == F.col("gt")).cast("long")).alias("ok"))
    valid = counts.filter(F.col("gt") >= 0)
    none = F.lit(None).cast("double")
    per = class_scores(valid, n_classes, keys).groupBy(*keys).agg(
        none.alias("pix_acc"), F.avg(F.when(F.col("union_n") > 0, F.col("inter") / (EPS + F.col("union_n")))).alias("miou")
    )
    acc_t = valid.groupBy(*keys).agg((F.sum("ok") / (EPS + F.sum("n"))).alias("pix_acc"), none.alias("miou"))
    return acc_t.unionByName(per).groupBy(*keys).agg(F.max("pix_acc").alias("pix_acc"), F.max("miou").alias("miou"))


def image_accuracy(pairs: DataFrame, keys) -> DataFrame:
    """Per image: labelled pixels (gt >= 0), correct pixels and their ratio."""
    ok = F.col("gt") >= 0
    out = pairs.groupBy(*keys).agg(
        F.sum(ok.cast("long")).alias("labeled"), F.sum((ok & (F.col("gt") == F.col("pred"))).cast("long")).alias("correct")
    )
    return out.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("labeled")))


def image_areas(pairs: DataFrame, keys, n_classes: int) -> DataFrame:
    """Per image and class 1..n: intersection and union areas; predictions outside the ground
    truth count as 0, and class 0 is outside the histogram range."""
    counts = pairs.select(*keys, "gt", F.when(F.col("gt") >= 0, F.col("pred")).otherwise(0).alias("pred")).groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    e = F.array(
        F.struct(F.col("gt").alias("label"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("i"), F.col("n").alias("u")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("i"), F.when(F.col("gt") == F.col("pred"), 0).otherwise(F.col("n")).alias("u")),
    )
    long = counts.select(*keys, F.explode(e).alias("e")).select(*keys, "e.*").filter((F.col("label") >= 1) & (F.col("label") <= n_classes))
    return long.groupBy(*keys, "label").agg(F.sum("i").alias("inter"), F.sum("u").alias("union_n"))


def psnr(pixels: DataFrame, frame_keys, row: str, a: Column, b: Column) -> DataFrame:
    """Mean over image rows of 20*log10(1/sqrt(row mse)); rows without error are infinite."""
    rows = pixels.groupBy(*frame_keys, row).agg(F.avg((a - b) * (a - b)).alias("mse"))
    value = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(20.0 * F.log10(1.0 / F.sqrt("mse")))
    return rows.groupBy(*frame_keys).agg(F.avg(value).alias("psnr"))


def depth_l1(pairs: DataFrame, view_keys, scene_keys=()) -> DataFrame:
    """Mean over views of the per-view mean absolute depth difference, in centimetres."""
    per = pairs.groupBy(*view_keys).agg(F.avg(F.abs(F.col("gt_depth") - F.col("est_depth"))).alias("l1"))
    return per.groupBy(*scene_keys).agg((F.avg("l1") * 100).alias("depth_l1_cm"), F.count(F.lit(1)).alias("views"))


def residual_means(pixels: DataFrame, keys, pairs: dict[str, tuple[str, str]], depth: str = "gt_depth") -> DataFrame:
    """Mean absolute residual per frame; pixels without measured depth count as zero."""
    masked = {n: F.when(F.col(depth) == 0, 0.0).otherwise(F.abs(F.col(a) - F.col(b))) for n, (a, b) in pairs.items()}
    return pixels.groupBy(*keys).agg(*[F.avg(e).alias(n) for n, e in masked.items()])
