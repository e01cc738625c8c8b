"""Deconvolution in overlapping blocks against the whole image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import kernels
from pixelweave.operators import deconvolve, psf
from pixelweave.sources import tiles as t


def table(spark, a, value="value"):
    at = np.indices(a.shape).reshape(a.ndim, -1).T
    rows = [(image, *map(int, p), float(v)) for image in (1, 2) for p, v in zip(at, (a * image).ravel() if value == "value" else a.ravel(), strict=True)]
    return spark.createDataFrame(rows, "image_id long, " + "".join(f"{c} int, " for c in ("z", "y", "x")[-a.ndim :]) + "value double")


def back(rows, shape):
    out = {i: np.zeros(shape) for i in (1, 2)}
    dims = ("z", "y", "x")[-len(shape) :]
    for r in rows.collect():
        out[r["image_id"]][tuple(r[c] for c in dims)] = r["value"]
    return out


def spots(shape, n, seed):
    rng = np.random.default_rng(seed)
    a = np.full(shape, 0.05)
    for _ in range(n):
        a[tuple(rng.integers(s) for s in shape)] += rng.uniform(1, 5)
    return kernels.gaussian(a, 0.7)


@pytest.mark.parametrize("masked", [False, True])
def test_difference_to_the_whole_plane_falls_with_the_overlap(spark, masked):
    image = spots((64, 60), 40, 1)
    seen = np.ones(image.shape)
    seen[10:20, 12:40] = 0
    kernel = psf.gaussian(spark.createDataFrame([(7, 7, 1.2)], "psf_id int, xy_dim int, xy_sigma double"))
    tiled = lambda a, side, v="value": t.to_tiles(table(spark, a, v), side).withColumn("psf_id", F.lit(7))
    mask = (lambda side: tiled(seen, side, "seen")) if masked else lambda side: None
    whole = back(deconvolve.richardson_lucy(tiled(image, 64), kernel, 3, True, mask(64)), image.shape)
    far = []
    for overlap, side in ((4, 16), (8, 16), (16, 16), (26, 32)):  # 4 x 4 tiles, and 2 x 2 that see all there is to see
        out = deconvolve.richardson_lucy_tiles(tiled(image, side), kernel, 3, overlap, mask(side))
        assert out.count() == 2 * (4 * 4 if side == 16 else 2 * 2)
        got = back(t.from_tiles(out.drop("psf_id")), image.shape)
        far.append(max(np.abs(got[i] - whole[i]).max() for i in (1, 2)))
        if masked:
            assert np.allclose(got[1][seen == 0], image[seen == 0])
    assert far[0] > 10 * far[1] > 100 * far[2] and far[3] < 1e-9, far


def test_volumes_with_masks_and_psfs_of_their_own(spark):
    image = spots((12, 20, 18), 30, 2)
    seen = np.ones(image.shape)
    seen[3:6, 4:9, 5:8] = 0
    settings = spark.createDataFrame([(1, 5, 0.8, 3, 0.6), (2, 3, 0.5, 3, 0.5)], "psf_id int, xy_dim int, xy_sigma double, z_dim int, z_sigma double")
    kernel = psf.gaussian(settings)
    tiled = lambda a, side, v: t.to_tiles(table(spark, a, v), side, volume=True).withColumn("psf_id", F.col("image_id").cast("int"))
    whole = back(deconvolve.richardson_lucy(tiled(image, 32, "value"), kernel, 2, True, tiled(seen, 32, "seen")), image.shape)
    far = []
    for overlap in (2, 4, 10):
        out = deconvolve.richardson_lucy_tiles(tiled(image, 10, "value"), kernel, 2, overlap, tiled(seen, 10, "seen"))
        got = back(t.from_tiles(out.drop("psf_id")), image.shape)
        far.append(max(np.abs(got[i] - whole[i]).max() for i in (1, 2)))
    assert far[0] > 3 * far[1] and far[2] < 1e-9, far


def test_weights_of_neighbours_add_up_to_one():
    for ramp in (0, 1, 3, 8):
        total = np.zeros(64)
        for low in range(0, 64, 16):
            total[max(0, low - ramp) : min(64, low + 16 + ramp)] += kernels.fade(low, low + 16, ramp, 64)
        assert np.allclose(total, 1)
