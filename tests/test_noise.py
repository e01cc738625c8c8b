"""Noise estimates and non-local means: against plain loops, and independent of the tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import kernels
from pixelweave.operators import filters
from pixelweave.sources import tiles as t


def plain(a, patch, reach, h, sigma, fast):
    r, out = patch // 2, np.zeros(a.shape)
    big = np.pad(a, reach + r, mode="symmetric")
    soft = np.ones(patch) if fast else np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * ((patch - 1) / 4) ** 2))
    weight = np.outer(soft, soft) / soft.sum() ** 2
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            at, total, sum_ = (y + reach + r, x + reach + r), 0.0, 0.0
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    one = big[at[0] - r : at[0] + r + 1, at[1] - r : at[1] + r + 1]
                    two = big[at[0] + dy - r : at[0] + dy + r + 1, at[1] + dx - r : at[1] + dx + r + 1]
                    w = np.exp(-max(((one - two) ** 2 * weight).sum() - 2 * sigma * sigma, 0) / (h * h))
                    total, sum_ = total + w * big[at[0] + dy, at[1] + dx], sum_ + w
            out[y, x] = total / sum_
    return out


@pytest.mark.parametrize("fast", [True, False])
def test_means_against_a_loop_inside(fast):
    a = np.random.default_rng(1).random((16, 15))
    got, want = kernels.non_local_means(a, 3, 2, 0.3, 0.05, fast), plain(a, 3, 2, 0.3, 0.05, fast)
    assert np.allclose(got[1:-1, 1:-1], want[1:-1, 1:-1])  # at the rim a patch's mirror images differ


def image(spark, planes):
    rows = [(i, y, x, float(v)) for i, a in planes.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, value double")


def test_noise_is_the_exact_median_whatever_the_tile(spark):
    rng = np.random.default_rng(5)
    planes = {1: rng.normal(0, 0.1, (61, 50)), 2: rng.normal(5, 2, (30, 31)), 3: np.full((9, 9), 4.0), 4: rng.integers(0, 2, (24, 24)).astype(float)}
    px = image(spark, planes)
    want = {i: np.median(kernels.diagonal_details(a, (0, 0), (slice(0, a.shape[0]), slice(0, a.shape[1])))) / kernels.MEDIAN_OF_NORMAL for i, a in planes.items()}
    assert abs(want[1] - 0.1) < 0.01 and abs(want[2] - 2) < 0.25
    for side in (64, 16, 7):
        got = {r["image_id"]: r["noise"] for r in filters.noise(t.to_tiles(px, side)).collect()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in planes)


def test_default_estimates_the_noise_and_does_not_depend_on_the_tile(spark):
    rng = np.random.default_rng(6)
    clean = np.add.outer(np.arange(30) > 14, np.arange(28) > 10).astype(float)
    px = image(spark, {1: clean + rng.normal(0, 0.1, clean.shape)}).withColumn("c", F.lit(0))
    run = lambda side, **how: {(r["y"], r["x"]): r["value"] for r in t.from_tiles(filters.non_local_means(t.to_tiles(px, side), 3, 4, 0.06, **how)).collect()}
    whole, parts, without = run(64), run(9), run(64, sigma=0.0)
    assert all(abs(whole[k] - parts[k]) < 1e-9 for k in whole) and any(abs(whole[k] - without[k]) > 1e-3 for k in whole)
    error = lambda found: sum((found[y, x] - clean[y, x]) ** 2 for y, x in found)
    assert error(whole) < error(without)


def test_small_tiles_are_filtered_as_stacks(spark, monkeypatch):
    """Equal blocks go to the kernel together, each with its own noise, and come out as alone."""
    rng = np.random.default_rng(8)
    planes = {i: rng.random((8, 8 - i % 2)) * (1 + i) for i in range(30)}
    tiles, real = t.to_tiles(image(spark, planes), 5).coalesce(1), kernels.non_local_means
    got = {}
    for r in t.from_tiles(filters.non_local_means(tiles, 3, 3)).collect():
        got.setdefault(r["image_id"], np.zeros(planes[r["image_id"]].shape))[r["y"], r["x"]] = r["value"]
    noise = {r["image_id"]: r["noise"] for r in filters.noise(tiles).collect()}
    for i, a in planes.items():
        lo, span = a.min(), a.max() - a.min()
        assert np.allclose(got[i], real((a - lo) / span, 3, 3, sigma=noise[i] / span) * span + lo)
    blocks, sigmas = rng.random((40, 8, 7)), rng.random(40) * 0.1
    for fast in (True, False):
        assert (real(blocks, 3, 3, 0.1, sigmas, fast, 2) == np.stack([real(b, 3, 3, 0.1, s, fast) for b, s in zip(blocks, sigmas, strict=True)])).all()
    monkeypatch.setattr(t, "STACKED", 8 * 7 * 16)
    stacks = list(t._stacks([*blocks, rng.random((5, 5))]))
    assert sorted(map(len, stacks)) == [1, 8, 16, 16] and sorted(i for s in stacks for i in s) == list(range(41))
