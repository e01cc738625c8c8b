"""Intensity: percentile and min-max scaling, gray and 8-bit colour, totals. Key columns tell images apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to the span of percentiles, so a constant image divides by something (fixed value).
TINY = 1e-20


def percentiles(pixels: DataFrame, low: float, high: float, per: list[str], value: str = "value") -> DataFrame:
    """(key, lo, hi) with linear interpolation.

    Values are counted first, so a task holds the different values of a key and
    not its pixels.
    """
    if not 0 <= low < high <= 100:
        raise ValueError(f"percentiles need 0 <= low < high <= 100, not {low} and {high}")
    counts = pixels.groupBy(*per, value).agg(F.count(F.lit(1)).alias("n"))
    at = F.expr(f"percentile({value}, array({low / 100.0!r}D, {high / 100.0!r}D), n)")
    return counts.groupBy(*per).agg(at.alias("p")).select(*per, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def normalize_percentile(pixels: DataFrame, low: float = 1.0, high: float = 99.8, clip: bool = False, per: list[str] | None = None) -> DataFrame:
    """(value - lo) / (hi - lo), with the percentiles of all pixels of a key."""
    per = per or ["image_id"]
    scaled: Column = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(TINY))
    if clip:
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    return pixels.join(percentiles(pixels, low, high, per), per).withColumn("value", scaled).drop("lo", "hi")


def unit(pixels: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Scaled to [0, 1] by the least and largest value of a key; a constant image is 0. Keeps them as lo and span."""
    per = per or ["image_id"]
    ends = pixels.groupBy(*per).agg(F.min("value").alias("lo"), (F.max("value") - F.min("value")).alias("span"))
    ends = ends.withColumn("span", F.when(F.col("span") == 0, 1.0).otherwise(F.col("span")))
    return pixels.join(ends, per).withColumn("value", (F.col("value") - F.col("lo")) / F.col("span"))


def from_unit(scaled: DataFrame) -> DataFrame:
    return scaled.withColumn("value", F.col("value") * F.col("span") + F.col("lo")).drop("lo", "span")


def to_gray(pixels: DataFrame) -> DataFrame:
    """Mean of the first three channels; further ones (alpha) are ignored."""
    rest = [c for c in pixels.columns if c not in ("c", "value")]
    return pixels.where("c < 3").groupBy(*rest).agg(F.avg("value").alias("value"))


def to_rgb(pixels: DataFrame, low: float = 1.0, high: float = 99.8, is_bytes: bool = False) -> DataFrame:
    """8-bit colour for models of natural images: percentiles over all channels, clipped and cut to whole numbers.

    Gray planes are repeated in three channels, alpha is dropped, byte colour is
    left as it is, and a blank image becomes 0.
    """
    colour = "c" in pixels.columns
    if not colour and {"z", "t"} & set(pixels.columns):
        raise ValueError("a plane or a colour image is needed")
    px = pixels.where("c < 3") if colour else pixels
    if colour and is_bytes:
        return px.withColumn("value", F.col("value").cast("int"))
    ends = percentiles(px, low, high, ["image_id"]).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    out = px.join(ends, "image_id").withColumn("value", F.floor(share * 255).cast("int")).drop("lo", "hi")
    return out if colour else out.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


def scale(pixels: DataFrame, factor: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The scaled pixels, and the total of each image before it."""
    return pixels.withColumn("value", F.col("value") * factor), pixels.groupBy("image_id").agg(F.sum("value").alias("total"))


def quadrants(pixels: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Labels 1 to 4 of the quarters of a plane; odd sizes cut at the smaller half."""
    per = per or ["image_id"]
    size = pixels.groupBy(*per).agg(F.expr("(max(y) + 1) div 2").alias("hy"), F.expr("(max(x) + 1) div 2").alias("hx"))
    label = F.when(F.col("y") < F.col("hy"), 0).otherwise(2) + F.when(F.col("x") < F.col("hx"), 1).otherwise(2)
    return pixels.join(size, per).withColumn("label", label).drop("hy", "hx", "value")
