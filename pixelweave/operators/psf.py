"""Point spread functions as tables (psf_id, z, y, x, value); z is 0 in a plane."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Peak emission of fluorophores, in microns (fixed values).
EMISSION = {"DAPI": 0.461, "Cy2": 0.506, "FITC": 0.519, "TexasRed": 0.610, "AF594": 0.617, "Cy5": 0.670}


def _normalized(psf: DataFrame) -> DataFrame:
    return psf.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("psf_id")))


def used(settings: DataFrame, tiles: DataFrame) -> DataFrame:
    """The settings whose psf_id a row of ``tiles`` has, so that no other PSF is made."""
    return settings.join(tiles.select("psf_id").distinct(), "psf_id", "left_semi")


def gaussian(settings: DataFrame) -> DataFrame:
    """From (psf_id, xy_dim, xy_sigma, [z_dim, z_sigma]): sampled at dim points from -(dim div 2) to dim div 2, sum 1."""
    if "z_dim" not in settings.columns:
        settings = settings.withColumn("z_dim", F.lit(0)).withColumn("z_sigma", F.lit(1.0))
    axis = lambda dim: F.explode(F.sequence(F.lit(0), F.greatest(F.col(dim), F.lit(1)) - 1))
    half = lambda dim: F.expr(f"{dim} div 2").cast("double")

    def part(i: str, dim: str, sigma: str) -> Column:
        step = F.when(F.col(dim) > 1, 2 * half(dim) / F.greatest(F.col(dim) - 1, F.lit(1))).otherwise(0.0)
        u = F.when(F.col(dim) > 1, -half(dim) + F.col(i) * step).otherwise(0.0)
        return u * u / (2 * F.col(sigma) * F.col(sigma))

    grid = settings.withColumn("z", axis("z_dim")).withColumn("y", axis("xy_dim")).withColumn("x", axis("xy_dim"))
    value = F.exp(-(part("z", "z_dim", "z_sigma") + part("y", "xy_dim", "xy_sigma") + part("x", "xy_dim", "xy_sigma")))
    return _normalized(grid.select("psf_id", "z", "y", "x", value.alias("value")))


def paraxial_otf(settings: DataFrame) -> DataFrame:
    """From (psf_id, size, wavelength, numerical_aperture, pixel_size): the transfer function on size x size."""
    size = F.col("size")
    line = F.explode(F.sequence(F.lit(0), size - 1))
    grid = settings.withColumn("y", line).withColumn("x", line)
    centre = size / 2 + 1
    u, v = F.col("x") - centre, F.col("y") - centre
    limit = 2 * F.col("pixel_size") / (0.5 * F.col("wavelength") / F.col("numerical_aperture"))
    radius = F.sqrt(u * u + v * v) / ((size - 1) - centre)
    r = F.when(radius <= limit, radius / limit).otherwise(1.0)
    value = F.when(radius <= limit, 2 / F.lit(np.pi) * (F.acos(r) - r * F.sqrt(1 - r * r))).otherwise(0.0)
    return grid.select("psf_id", F.lit(0).alias("z"), "y", "x", value.alias("value"))


def paraxial_psf(settings: DataFrame) -> DataFrame:
    """The inverse transform of ``paraxial_otf``, centred, sum 1; it has small negative lobes."""

    def invert(rows: pd.DataFrame) -> pd.DataFrame:
        otf = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1))
        otf[rows["y"], rows["x"]] = rows["value"]
        psf = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(otf)).real)
        rows = rows.copy()
        rows["value"] = (psf / psf.sum())[rows["y"], rows["x"]]
        return rows

    return paraxial_otf(settings).groupBy("psf_id").applyInPandas(invert, f"psf_id {settings.schema['psf_id'].dataType.simpleString()}, z int, y int, x int, value double")


def clip(psf: DataFrame) -> DataFrame:
    """Negative values to 0, sum 1 again."""
    return _normalized(psf.withColumn("value", F.greatest("value", F.lit(0.0))))


def recenter(psf: DataFrame, new_z: int, by: str = "value") -> DataFrame:
    """``new_z`` planes around the brightest one (the first of equals), at new_z div 2; an error if they run off.

    Brightness is that of the column ``by``, which may be another than the values, like those of a smoothed or marked copy.
    """
    peak = psf.groupBy("psf_id").agg(F.max(F.struct(by, (-F.col("z")).alias("m"))).alias("p"), (F.max("z") + 1).alias("planes"))
    start = peak.select("psf_id", (-F.col("p.m") - new_z // 2).alias("start"), "planes")
    off = (F.col("start") < 0) | (F.col("start") + new_z > F.col("planes"))
    checked = start.withColumn("start", F.when(off, F.raise_error(F.lit("the peak is too near to an end of the planes"))).otherwise(F.col("start")))
    moved = psf.join(checked, "psf_id").where((F.col("z") >= F.col("start")) & (F.col("z") < F.col("start") + new_z))
    return moved.withColumn("z", (F.col("z") - F.col("start")).cast("int")).drop("start", "planes")


def confocal(psf: DataFrame, factor: float = 1.0) -> DataFrame:
    """The power of the values, then sum 1; after a crop, not before it."""
    return _normalized(psf.withColumn("value", F.pow("value", F.lit(factor))) if factor != 1.0 else psf)


def emissions(spark: SparkSession) -> DataFrame:
    """(name, wavelength): six rows."""
    rows = F.explode(F.create_map(*(F.lit(x) for pair in EMISSION.items() for x in pair)))
    return spark.range(1).select(rows.alias("name", "wavelength"))


def with_emission(settings: DataFrame, name: str = "fluorophore") -> DataFrame:
    """Settings with the wavelength of their fluorophore; an unknown name is an error."""
    known = settings.join(F.broadcast(emissions(settings.sparkSession)), F.col(name) == F.col("name"), "left").drop("name")
    return known.withColumn("wavelength", F.coalesce("wavelength", F.raise_error(F.concat(F.lit("unknown fluorophore "), F.col(name)))))


def next_smooth(n: int) -> int:
    """The least number from n on without prime factors over 7."""
    while True:
        left = n
        for p in (2, 3, 5, 7):
            while left % p == 0:
                left //= p
        if left == 1:
            return n
        n += 1


def pad(pixels: DataFrame, sizes: dict[str, tuple[int, int]], per: list[str] | None = None) -> DataFrame:
    """Dense pixels on larger extents, centred: ceil of half the difference before. sizes: axis -> (old, new)."""
    per = per or ["image_id"]
    shift = {a: -(-(new - old) // 2) for a, (old, new) in sizes.items()}
    grid = pixels.select(*per).distinct()
    for a, (_, new) in sizes.items():
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(new - 1))))
    moved = pixels.withColumns({a: (F.col(a) + d).cast("int") for a, d in shift.items()})
    return grid.join(moved, [*per, *sizes], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def unpad(pixels: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """The inverse of ``pad`` with the same sizes."""
    for a, (old, new) in sizes.items():
        d = -(-(new - old) // 2)
        pixels = pixels.where((F.col(a) >= d) & (F.col(a) < d + old)).withColumn(a, (F.col(a) - d).cast("int"))
    return pixels


def blobs(objects: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels of Gaussian blobs from (image_id, cz, cy, cx, sigma, peak): the largest of all blobs, whole numbers to 65535.

    Each blob fills a box of four sigmas; voxels without a blob are absent.
    """
    reach = F.ceil(4 * F.col("sigma")).cast("int")
    line = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - reach), F.least(F.lit(n - 1), F.col(c) + reach)))
    cells = objects.withColumn("z", line("cz", shape[0])).withColumn("y", line("cy", shape[1])).withColumn("x", line("cx", shape[2]))
    far = F.pow(F.col("z") - F.col("cz"), 2) + F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("x") - F.col("cx"), 2)
    value = F.least(F.lit(65535), F.floor(F.col("peak") * F.exp(-far / (2 * F.col("sigma") * F.col("sigma")))))
    return cells.groupBy("image_id", "z", "y", "x").agg(F.max(value).alias("value"))
