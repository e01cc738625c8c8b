"""The tissue stages on planes larger than a tile, and the local cut against a plain loop."""

import numpy as np
import pytest

from pixelweave.functions import kernels
from pixelweave.operators import tissue


def by_loop(level, r):
    h, w = level.shape
    out = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            near = [level[a, b] for a in range(max(0, y - r), min(h, y + r + 1)) for b in range(max(0, x - r), min(w, x + r + 1)) if (a - y) ** 2 + (b - x) ** 2 <= r * r]
            values, n = np.unique(near, return_counts=True)
            c, s = np.cumsum(n), np.cumsum(n * values)
            best, cut = -1.0, values[-1]
            for i in range(len(values) - 1):
                score = float(s[-1] * c[i] - c[-1] * s[i]) ** 2 / (c[i] * (c[-1] - c[i]))
                if score > best:
                    best, cut = score, values[i]
            out[y, x] = level[y, x] > cut
    return out


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_local_cut_against_a_loop(radius):
    rng = np.random.default_rng(radius)
    for level in (rng.integers(0, 256, (23, 17)), rng.integers(0, 3, (9, 30)) * 100, np.full((6, 5), 9), rng.integers(0, 256, (1, 1))):
        assert (kernels.local_otsu(level, radius) == by_loop(level, radius)).all()


def two_markers(spark, h=44, w=37):
    rng = np.random.default_rng(3)
    base = [kernels.gaussian(rng.random((h, w)) * 200 + 40 * (np.indices((h, w)).sum(axis=0) % 17 < 8), 1.0) for _ in range(2)]
    rows = [(i, c, y, x, float(base[c // 2][y, x]) * (i + 1)) for i in (0, 1) for c in (0, 2) for y in range(h) for x in range(w)]
    rows += [(2, c, y, x, 5.0) for c in (0, 2) for y in range(5) for x in range(5)]  # constant channels
    return spark.createDataFrame(rows, "image_id long, c int, y int, x int, value double")


def rounded(rows, columns):
    return sorted(tuple(round(float(r[c]), 9) for c in columns) for r in rows.collect())


def test_stages_do_not_depend_on_the_tile(spark):
    channels = tissue.two_channels(two_markers(spark), 2, 0)
    columns = ["image_id", "c", "y", "x", "value"]
    for stage in (lambda side: tissue.foreground_probability(channels, side=side), lambda side: tissue.local_masks(channels, 4, side=side), lambda side: tissue.local_masks(channels, 3, smoothing=False, side=side)):
        whole = rounded(stage(64), columns)
        assert len(whole) == 2 * (2 * 44 * 37 + 25) and len({v[-1] for v in whole}) > 1
        assert rounded(stage(16), columns) == whole


def test_the_chain_runs_on_planes_over_a_tile(spark):
    px = two_markers(spark)
    columns = ["image_id", "y", "x", "kind"]
    whole = rounded(tissue.tissue_masks(px, 2, 0, 3, side=64), columns)
    assert rounded(tissue.tissue_masks(px, 2, 0, 3, side=48), columns) == whole
    assert {v[-1] for v in whole} == {0.0, 1.0, 2.0}
