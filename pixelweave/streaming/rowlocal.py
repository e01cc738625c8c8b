"""Row-local operators on streams: they need no state, so the batch functions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import axes, intensity


def threshold_stream(pixels: DataFrame, cut: float, invert: bool = False) -> DataFrame:
    """A stream of pixels against a fixed cut (cuts from histograms need a whole image, so they belong to batches)."""
    above = F.col("value") <= cut if invert else F.col("value") > cut
    return pixels.withColumn("value", F.when(above, 1).otherwise(0))


def scaled_stream(pixels: DataFrame, factor: float) -> DataFrame:
    return intensity.scale(axes.canonical_axes(pixels), factor)[0]
