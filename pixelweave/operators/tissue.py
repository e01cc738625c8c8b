"""Two-marker tissue masks: nuclei (channel 0) and membrane (channel 1), pixel by pixel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions import kernels as k
from pixelweave.functions.staging import staged
from pixelweave.operators.components import TILE, label_runs, to_runs
from pixelweave.operators.filters import gaussian, plane_ends, with_ends
from pixelweave.operators.threshold import multiotsu_cuts
from pixelweave.sources.tiles import SIDE, apply_halo, from_tiles, to_tiles

PER = ["image_id", "c"]


def two_channels(pixels: DataFrame, nuclei_channel: int = 2, membrane_channel: int = 0) -> DataFrame:
    """The two channels as c = 0 and 1, each scaled to [0, 1]; a constant channel stays as it is."""
    chosen = pixels.where(F.col("c").isin(nuclei_channel, membrane_channel)).withColumn("c", F.when(F.col("c") == nuclei_channel, 0).otherwise(1))
    ends = chosen.groupBy(*PER).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return chosen.join(ends, PER).withColumn("value", F.when(span > 0, (F.col("value") - F.col("lo")) / F.nullif(span, F.lit(0.0))).otherwise(F.col("value"))).drop("lo", "hi")


def widened(channels: DataFrame) -> DataFrame:
    """(image_id, y, x, v0, v1)"""
    pick = lambda c: F.max(F.when(F.col("c") == c, F.col("value"))).alias(f"v{c}")
    return channels.groupBy("image_id", "y", "x").agg(pick(0), pick(1))


def _unit(rows: DataFrame, value: str = "value") -> DataFrame:
    """Each channel of an image scaled to [0, 1] by its own ends; a constant one stays as it is."""
    ends = rows.groupBy(*PER).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return rows.join(ends, PER).withColumn(value, F.when(span > 0, (F.col(value) - F.col("lo")) / F.nullif(span, F.lit(0.0))).otherwise(F.col(value))).drop("lo", "hi")


def foreground_probability(channels: DataFrame, sigma: float = 3.0, side: int = SIDE) -> DataFrame:
    """Per pixel: the share of foreground pixels of at most its 8-bit level; 0 below the first.

    Foreground is what lies over the first of two cuts of the smoothed, scaled channel. Planes
    of any size: the smoothing works on tiles with halos, and its ends are found over the whole plane.
    """
    smooth = _unit(from_tiles(staged(gaussian(to_tiles(channels, side), sigma), "smooth")).withColumnRenamed("value", "soft"), "soft")
    cuts = multiotsu_cuts(smooth.withColumnRenamed("soft", "value"), 3, PER, integer=False).select(*PER, F.col("cuts")[0].alias("cut"))
    leveled = channels.withColumn("level", F.floor(F.col("value") * 255).cast("int"))
    fore = leveled.join(smooth, [*PER, "y", "x"]).join(cuts, PER).where(F.col("soft") > F.col("cut")).groupBy(*PER, "level").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*PER).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(*PER))
    after = F.lead("level", 1, 256).over(Window.partitionBy(*PER).orderBy("level"))
    steps = fore.select(*PER, "level", share.alias("p"), after.alias("after"))
    # each of the 256 levels of a channel takes the step at or below it
    lookup = steps.select(*PER, F.explode(F.sequence("level", F.col("after") - 1)).alias("level"), "p")
    return leveled.join(lookup, [*PER, "level"], "left").select(*PER, "y", "x", F.coalesce("p", F.lit(0.0)).alias("value"))


def global_masks(channels: DataFrame, reaches: tuple[int, ...] = (5, 10, 20, 40), t0: float = 0.5, side: int = SIDE) -> DataFrame:
    """Where a pixel isn't 0 and reaches t0 times the mean of each of the windows, cut at the borders."""

    def kernel(a: np.ndarray) -> np.ndarray:
        ok = a != 0
        total = np.pad(np.cumsum(np.cumsum(a, axis=0), axis=1), ((1, 0), (1, 0)))
        y, x = np.arange(a.shape[0]), np.arange(a.shape[1])
        for r in reaches:
            y0, y1, x0, x1 = np.maximum(y - r, 0), np.minimum(y + r + 1, len(y)), np.maximum(x - r, 0), np.minimum(x + r + 1, len(x))
            window = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
            mean = window / np.outer(y1 - y0, x1 - x0)
            ok &= a >= t0 * mean - 1e-12
        return ok

    return from_tiles(apply_halo(to_tiles(channels, side), kernel, max(reaches))).withColumn("value", F.col("value") > 0)


def local_masks(channels: DataFrame, r0: int = 5, k0: float = 1.0, smoothing: bool = True, side: int = SIDE) -> DataFrame:
    """Over a local Otsu cut in a disk, after smoothing that spares gradients; 8-bit levels.

    Planes of any size: both steps work on tiles with halos (of 2 and of r0 pixels), and the ends
    that levels are scaled by are found over the whole plane. Memory doesn't grow with r0.
    """

    def spared(a: np.ndarray) -> np.ndarray:
        u = np.exp(-(k.gradient(a, "sobel") ** 2) / (2 * k0 * k0))
        add = lambda v: sum(np.pad(v, 1)[dy : dy + v.shape[0], dx : dx + v.shape[1]] for dy in range(3) for dx in range(3))
        return add(u * a) / add(u)

    tiles = to_tiles(_unit(channels), side) if smoothing else to_tiles(channels, side)
    if smoothing:
        soft = staged(apply_halo(tiles, spared, 2), "spared")
        ends = plane_ends(soft, flat=0.0)
        tiles = with_ends(soft.join(ends, PER), lambda a, lo, span: (a - lo) / span if span > 0 else a)
    leveled = lambda a: np.clip(np.rint(a * 255), 0, 255).astype(np.int64)
    return from_tiles(apply_halo(tiles, lambda a: k.local_otsu(leveled(a), r0), r0)).withColumn("value", F.col("value") > 0)


def remove_background(rows: DataFrame, pct: float | tuple[float | None, float | None] | None = (0.01, 0.01)) -> DataFrame:
    """Global masks where the probability passes a marker's ``pct``, and local ones inside them.

    One number is for both markers; None takes the first of two cuts that part an
    image's probabilities in three classes (no cut where it has fewer values).
    """
    both = pct if isinstance(pct, tuple) else (pct, pct)
    for c, least in enumerate(both):
        if least is None:
            found = multiotsu_cuts(rows.select("image_id", F.col(f"p{c}").alias("value")), 3, integer=False)
            rows = rows.join(found.select("image_id", F.coalesce(F.get("cuts", F.lit(0)), F.lit(0.0)).alias("least")), "image_id")
        else:
            rows = rows.withColumn("least", F.lit(float(least)))
        rows = rows.withColumn(f"global{c}", F.col(f"global{c}") & (F.col(f"p{c}") > F.col("least"))).drop("least")
        rows = rows.withColumn(f"local{c}", F.col(f"local{c}") & F.col(f"global{c}"))
    return rows


def likelihood(rows: DataFrame) -> DataFrame:
    """Contrast of the channels, -(v0 - v1) / (v0 + v1), where either is over its least local value; gated by the global masks."""
    least = rows.groupBy("image_id").agg(*(F.min(F.when(F.col(f"local{c}"), F.col(f"v{c}"))).alias(f"m{c}") for c in (0, 1)))
    over = (F.col("v0") > F.col("m0")) | (F.col("v1") > F.col("m1"))
    raw = F.when(over, -(F.col("v0") - F.col("v1")) / F.nullif(F.col("v0") + F.col("v1"), F.lit(0.0))).otherwise(0.0)
    found = rows.join(least, "image_id").withColumn("likelihood", raw)
    off = ((F.col("likelihood") < 0) & ~F.col("global0")) | ((F.col("likelihood") > 0) & ~F.col("global1"))
    return found.withColumn("likelihood", F.when(off, 0.0).otherwise(F.col("likelihood"))).drop("m0", "m1")


def posterior(rows: DataFrame) -> DataFrame:
    """local0, local1 probabilities as prior (1 inside a local mask), joined with the likelihood: p + l - p * l."""
    size = F.abs(F.col("likelihood"))

    def joined(c: int) -> Column:
        prior = F.when(F.col(f"local{c}"), 1.0).otherwise(F.col(f"p{c}"))
        side = F.col("likelihood") < 0 if c == 0 else F.col("likelihood") > 0
        return F.when(side, prior + size - prior * size).otherwise(0.0)

    return rows.withColumn("post0", joined(0)).withColumn("post1", joined(1))


def ternary(rows: DataFrame, source: str = "Aposteriori") -> DataFrame:
    """kind: 0 background, 1 nuclei, 2 membrane, by the larger probability. Another source than 'Aposteriori' is an error."""
    if source != "Aposteriori":
        raise ValueError(f"no mask is defined for {source!r}")
    return rows.withColumn("kind", F.when(F.col("post0") + F.col("post1") == 0, 0).when(F.col("post0") >= F.col("post1"), 1).otherwise(2))


def tissue_masks(pixels: DataFrame, nuclei_channel: int = 2, membrane_channel: int = 0, r0: int = 5, pct=(0.01, 0.01), side: int = SIDE) -> DataFrame:
    """All stages from the pixels of an image table to the ternary mask."""
    channels = two_channels(pixels, nuclei_channel, membrane_channel)

    def wide(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("image_id", "y", "x").agg(*(F.max(F.when(F.col("c") == c, F.col("value"))).alias(f"{name}{c}") for c in (0, 1)))

    on = ["image_id", "y", "x"]
    rows = widened(channels).join(wide(foreground_probability(channels, side=side), "p"), on)
    rows = rows.join(wide(global_masks(channels, side=side), "global"), on).join(wide(local_masks(channels, r0, side=side), "local"), on)
    return ternary(posterior(likelihood(remove_background(rows, pct))))


def nuclei(rows: DataFrame, area: int = 15, tile: int = TILE) -> DataFrame:
    """Nuclei objects of at least ``area`` pixels, counting their holes, and how many an image has.

    All on runs: a hole is a 4-connected part of what isn't the object, within its box, that
    doesn't reach the box's side. What isn't the object lies between its runs in each row of the box
    and beside them, as an 8-connected object has a run in every row.
    """
    objects = label_runs(to_runs(rows.where("kind = 1").select("image_id", "y", "x"), ["image_id"]), ["image_id"], tile=tile)
    per = ["image_id", "label"]
    box = objects.groupBy(*per).agg(
        F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")
    )
    along = Window.partitionBy(*per, "y").orderBy("x0")
    placed = objects.join(box, per).withColumn("before", F.lag("x1").over(along)).withColumn("after", F.lead("x0").over(along))
    left = F.struct((F.coalesce("before", F.col("min_x") - 1) + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    right = F.when(F.col("after").isNull(), F.struct((F.col("x1") + 1).alias("x0"), F.col("max_x").alias("x1")))
    gaps = placed.select(*per, "y", "min_y", "max_y", "min_x", "max_x", F.explode(F.array(left, right)).alias("g")).where("g.x0 <= g.x1")
    gaps = gaps.select("image_id", F.col("label").alias("object"), "y", F.col("g.x0").alias("x0"), F.col("g.x1").alias("x1"))
    parts = label_runs(gaps, ["image_id", "object"], "edge", tile).withColumnRenamed("label", "part")
    sides = box.select("image_id", F.col("label").alias("object"), "min_y", "max_y", "min_x", "max_x")
    at_side = (F.col("y") == F.col("min_y")) | (F.col("y") == F.col("max_y")) | (F.col("x0") == F.col("min_x")) | (F.col("x1") == F.col("max_x"))
    holes = parts.join(sides, ["image_id", "object"]).groupBy("image_id", "object", "part").agg(F.max(at_side).alias("open"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    filled = holes.where("NOT open").groupBy("image_id", F.col("object").alias("label")).agg(F.sum("n").alias("hole"))
    size = box.select(*per, "area").join(filled, per, "left").withColumn("filled", F.col("area") + F.coalesce("hole", F.lit(0)))
    good = size.where(F.col("filled") >= area)
    return good.join(good.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_nuclei")), "image_id").select("image_id", "label", "area", "filled", "n_nuclei")
