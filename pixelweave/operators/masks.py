"""Masks as set pixels (image_id, mask_id, y, x): projections, order, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.ranks import ranked
from pixelweave.functions.staging import spread
from pixelweave.operators.boxes import slices


def as_masks(rows: DataFrame, value: str = "value") -> DataFrame:
    """Set pixels of dense rows: every value but 0 is set."""
    return rows.where(F.col(value) != 0).drop(value)


def to_labels_3d(masks: DataFrame) -> DataFrame:
    """Mask i as label i + 1 on a plane of its own."""
    return masks.select("image_id", F.col("mask_id").alias("z"), "y", "x", (F.col("mask_id") + 1).alias("label"))


def to_labels_2d(masks: DataFrame, strategy: str = "min") -> DataFrame:
    """One plane; where masks overlap, the first ('min') or the last ('max') wins."""
    if strategy not in ("min", "max"):
        raise ValueError(f"strategy is min or max, not {strategy!r}")
    pick = F.min if strategy == "min" else F.max
    return masks.groupBy("image_id", "y", "x").agg((pick("mask_id") + 1).alias("label"))


def areas(masks: DataFrame) -> DataFrame:
    return masks.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("area"))


def order_by_area(masks: DataFrame, descending: bool = True) -> DataFrame:
    """Masks renumbered by area; equal areas keep their order."""
    by = F.desc("area") if descending else F.asc("area")
    ranks = ranked(areas(masks), ["image_id"], [by, "mask_id"]).withColumn("rank", F.col("rank") - 1)
    # by a shuffle, as a broadcast would gather all masks' ranks in the driver and leave the pixels in the few tasks that read them
    return masks.join(ranks.drop("area").hint("merge"), ["image_id", "mask_id"]).drop("mask_id").withColumnRenamed("rank", "mask_id")


def drop_empty(boxes: DataFrame, masks: DataFrame, box: str = "box_id") -> DataFrame:
    """The boxes whose mask (of the same number and slice) has a pixel; masks without pixels have no rows."""
    per = slices(boxes, masks)
    found = masks.select(*per, F.col("mask_id").alias(box)).distinct()
    return boxes.join(found, [*per, box], "left_semi")


def to_runs(masks: DataFrame) -> DataFrame:
    """(image_id, mask_id, y, x0, len): runs of set pixels in a row."""
    order = Window.partitionBy("image_id", "mask_id", "y").orderBy("x")
    dealt = spread(masks, "image_id", "mask_id", "y")  # a task sorts a part of the pixels, not its core's share of them all
    island = dealt.withColumn("gap", F.col("x") - F.row_number().over(order))
    return island.groupBy("image_id", "mask_id", "y", "gap").agg(F.min("x").alias("x0"), F.count(F.lit(1)).alias("len")).drop("gap")


def from_runs(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", "mask_id", "y", F.explode(F.sequence(F.col("x0"), (F.col("x0") + F.col("len") - 1).cast("int"))).alias("x"))


def run_areas(runs: DataFrame) -> DataFrame:
    return runs.groupBy("image_id", "mask_id").agg(F.sum("len").alias("area"))


def blank(images: DataFrame) -> DataFrame:
    """Zero pixels of the catalogue's (image_id, height, width)."""
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select("image_id", "y", "x", F.lit(0).alias("label"))


def project(masks: DataFrame, images: DataFrame, strategy: str = "min") -> DataFrame:
    """Dense labels of every image of the catalogue; one without masks is blank."""
    found = to_labels_2d(masks, strategy)
    return blank(images).drop("label").join(found, ["image_id", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
