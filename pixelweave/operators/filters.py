"""Neighbourhood filters over tiles of planes or volumes: smoothing, edges, ridges and morphology.

On tiles of volumes a filter works along all three axes. Bilateral, Farid and Roberts
filters are of planes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions import kernels as k
from pixelweave.functions.ranks import ranked
from pixelweave.functions.staging import staged
from pixelweave.sources.tiles import _assembled, _body, _fields, _keys, _numbers, apply_halo, apply_whole, axes, largest


def gaussian(tiles: DataFrame, sigma: float = 1.0) -> DataFrame:
    return apply_halo(tiles, lambda a: k.gaussian(a, sigma), math.ceil(4 * sigma))


def median(tiles: DataFrame, radius: int = 1, shape: str = "ball") -> DataFrame:
    k.offsets(radius, len(axes(tiles)), shape)
    return apply_halo(tiles, lambda a: k.median(a, radius, shape), radius)


def mean(tiles: DataFrame, radius: int = 1) -> DataFrame:
    return apply_halo(tiles, lambda a: k.box_mean(a, radius), radius)


def kuwahara(tiles: DataFrame, radius: int = 2) -> DataFrame:
    if radius < 0:
        raise ValueError("radius is at least 0")
    return apply_halo(tiles, lambda a: k.kuwahara(a, radius), 2 * radius)


def _planes_only(tiles: DataFrame) -> None:
    if len(axes(tiles)) != 2:
        raise ValueError("this filter is of planes")


def _unit(a: np.ndarray, kernel) -> np.ndarray:
    """A kernel on the plane scaled to [0, 1], and back."""
    low, span = a.min(), (a.max() - a.min()) or 1.0
    return kernel((a - low) / span) * span + low


def bilateral(tiles: DataFrame, sigma_color: float = 0.1, sigma_spatial: float = 1.0) -> DataFrame:
    """Planes in parts are scaled by the ends of the whole plane, found first."""
    _planes_only(tiles)
    halo = max(1, math.ceil(3 * sigma_spatial))
    return _scaled(tiles, lambda a: k.bilateral(a, sigma_color, sigma_spatial, halo), halo)


def noise(tiles: DataFrame) -> DataFrame:
    """(keys, noise): the deviation of the noise of whole planes or volumes, from the median of the finest diagonal details.

    The median is exact and takes two passes: counts in bins of less than a hundredth of a value, then
    the ranks, by ranges, of the values in the bins that the middle falls in. Tiles need three pixels of their neighbours.
    """
    keys, dims = _keys(tiles), axes(tiles)

    def make(heads, keys_, dims_, numbers, blocks, insides, extras) -> pa.RecordBatch:
        found = [k.diagonal_details(b, [n - s.start for n, s in zip(number[: len(dims)], inside, strict=True)], inside) for b, number, inside in zip(blocks, numbers, insides, strict=True)]
        return pa.RecordBatch.from_arrays([*(heads.column(c).combine_chunks() for c in keys_), pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], [*keys_, "details"])

    each = staged(_assembled(tiles, 3, None, make, "details array<double>"), "details").select(*keys, F.explode("details").alias("v"))
    # 1/128 of a power of two each; the exponent is in the bits of a double
    each = each.withColumn("bin", F.floor(F.log2(F.greatest("v", F.lit(1e-300))) * 128).cast("int"))
    bins = each.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a key has some thousands of bins
    placed = bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    middle = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    ranks = F.filter(F.array(F.when(middle(F.expr("(total - 1) div 2")), F.expr("(total - 1) div 2") - F.col("before")), F.when(middle(F.expr("total div 2")), F.expr("total div 2") - F.col("before"))), lambda v: v.isNotNull())
    wanted = placed.select(*keys, "bin", "n", ranks.alias("ranks")).where(F.size("ranks") > 0)
    near = ranked(each.join(wanted.select(*keys, "bin", "ranks"), [*keys, "bin"]), [*keys, "bin"], ["v"], "place")
    picked = near.where(F.array_contains("ranks", (F.col("place") - 1).cast("long"))).withColumn("times", F.when(F.size("ranks") == 2, F.when(F.get("ranks", F.lit(0)) == F.get("ranks", F.lit(1)), 2).otherwise(1)).otherwise(1))
    picked = picked.withColumn("v", F.explode(F.array_repeat("v", F.col("times"))))
    return picked.groupBy(*keys).agg((F.avg("v") / k.MEDIAN_OF_NORMAL).alias("noise"))


def non_local_means(tiles: DataFrame, patch_size: int = 7, patch_distance: int = 11, h: float = 0.1, sigma: float | None = None, fast_mode: bool = True) -> DataFrame:
    """``sigma`` is a share of the image's range; without one it is the noise of the scaled plane, averaged over the channels (c) of an image."""
    halo, dims = patch_distance + patch_size // 2, len(axes(tiles))
    if sigma is not None:
        return _scaled(tiles, None, halo, lambda scaled: apply_halo(scaled, lambda a: k.non_local_means(a, patch_size, patch_distance, h, sigma, fast_mode, dims), halo, stacked=True))
    keys = _keys(tiles)
    alike = [c for c in keys if c != "c"]

    def with_noise(scaled: DataFrame) -> DataFrame:
        found = noise(scaled).groupBy(*alike).agg(F.avg("noise").alias("noise"))
        return apply_halo(scaled.join(found, alike), lambda a, deviation: k.non_local_means(a, patch_size, patch_distance, h, deviation, fast_mode, dims), halo, extra="noise", stacked=True)

    return _scaled(tiles, None, halo, with_noise)


def _scaled(tiles: DataFrame, kernel, halo: int, step=None) -> DataFrame:
    """A kernel (or a step of tiles to tiles) on planes scaled to [0, 1], and back."""
    keys = _keys(tiles)
    ends = plane_ends(tiles)
    scaled = with_ends(tiles.join(ends, keys), lambda a, lo, span: (a - lo) / span)
    done = step(scaled) if step else apply_halo(scaled, kernel, halo)
    return with_ends(done.join(ends, keys), lambda a, lo, span: a * span + lo)


def plane_ends(tiles: DataFrame, flat: float = 1.0) -> DataFrame:
    """(keys, lo, span) of whole planes or volumes; a constant one has the span ``flat``."""
    keys = _keys(tiles)

    def run(batches):
        for rows in batches:
            values = [np.frombuffer(x.as_buffer(), "<f8") for x in rows.column("data")]
            ends = [pa.array([float(f(v)) for v in values], pa.float64()) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), *ends], [*keys, "lo", "hi"])

    parts = tiles.select(*keys, "data").mapInArrow(run, _fields(tiles, keys) + "lo double, hi double")
    ends = parts.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return ends.select(*keys, "lo", F.when(span == 0, flat).otherwise(span).alias("span"))


def with_ends(joined: DataFrame, fn) -> DataFrame:
    """Tiles with ``fn(values, lo, span)`` in place of their values, after a join with ``plane_ends``."""
    keys, dims = [c for c in _keys(joined) if c not in ("lo", "span")], axes(joined)
    names = [*keys, *_numbers(dims)]

    def run(batches):
        for rows in batches:
            data = [fn(np.frombuffer(d.as_buffer(), "<f8"), lo.as_py(), span.as_py()).tobytes() for d, lo, span in zip(rows.column("data"), rows.column("lo"), rows.column("span"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(data, pa.binary())], [*names, "data"])

    return joined.select(*names, "data", "lo", "span").mapInArrow(run, _fields(joined, keys) + _body(dims))


def total_variation(tiles: DataFrame, weight: float = 0.1, max_num_iter: int = 200) -> DataFrame:
    return apply_whole(tiles, lambda a: _unit(a, lambda u: k.total_variation(u, weight, max_num_iter)))


def wavelet(tiles: DataFrame, method: str = "BayesShrink", mode: str = "soft", wavelet_name: str = "db1", sigma: float | None = None) -> DataFrame:
    return apply_whole(tiles, lambda a: _unit(a, lambda u: k.wavelet(u, method, mode, wavelet_name, sigma)))


def butterworth(tiles: DataFrame, cutoff: float = 0.05, order: float = 2, high_pass: bool = False) -> DataFrame:
    return apply_whole(tiles, lambda a: k.butterworth(a, cutoff, order, high_pass))


def edges(tiles: DataFrame, kind: str = "sobel") -> DataFrame:
    """sobel, scharr, prewitt, farid or roberts; the last two on planes only."""
    if kind in ("farid", "roberts"):
        _planes_only(tiles)
    if kind == "roberts":
        return apply_halo(tiles, k.roberts, 1)
    return apply_halo(tiles, lambda a: k.gradient(a, kind), 2 if kind == "farid" else 1)


def laplace(tiles: DataFrame, ksize: int = 3) -> DataFrame:
    return apply_halo(tiles, lambda a: k.laplace(a, ksize), ksize // 2)


def difference_of_gaussians(tiles: DataFrame, low_sigma: float = 1.0, high_sigma: float = 4.0) -> DataFrame:
    if high_sigma <= low_sigma:
        raise ValueError("high_sigma is more than low_sigma")
    return apply_halo(tiles, lambda a: k.difference_of_gaussians(a, low_sigma, high_sigma), math.ceil(4 * high_sigma))


def unsharp(tiles: DataFrame, radius: float = 1.0, amount: float = 1.0) -> DataFrame:
    return apply_halo(tiles, lambda a: k.unsharp(a, radius, amount), math.ceil(4 * radius))


def ridges(tiles: DataFrame, kind: str = "frangi", sigma_min: float = 1, sigma_max: float = 10, step: float = 2, black_ridges: bool = True, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """frangi, sato or meijering; the largest responses that two of them divide by are found over the whole plane or volume first."""
    sigmas = k.scales(sigma_min, sigma_max, step)
    halo, n = math.ceil(4 * sigmas.max()) + 2, len(sigmas)
    if kind == "sato":
        return apply_halo(tiles, lambda a: k.ridges(a, kind, sigmas, ([], []), black_ridges, alpha, beta), halo)
    normed = tiles.join(largest(tiles, lambda a: k.structure(a, sigmas, black_ridges), halo), _keys(tiles))
    return apply_halo(normed, lambda a, most: k.ridges(a, kind, sigmas, (most[:n], most[n:]), black_ridges, alpha, beta), halo, extra="largest")


def morphology(tiles: DataFrame, kind: str = "erosion", radius: int = 1, shape: str = "ball") -> DataFrame:
    """erosion, dilation, opening, closing, white_tophat or black_tophat."""
    k.offsets(radius, len(axes(tiles)), shape)
    return apply_halo(tiles, lambda a: k.morphology(a, kind, radius, shape), radius if kind in ("erosion", "dilation") else 2 * radius)
