"""Global thresholds from one histogram a key; value > cut is foreground."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("otsu", "isodata", "li", "mean", "minimum", "triangle", "yen")
FLOAT_BINS = 256


def _ends(pixels: DataFrame, per: list[str], integer: bool | None) -> DataFrame:
    """(key, lo, hi, whole): a key's least and largest value, and whether it has a bin for each value."""
    whole = F.bool_and(F.col("value") == F.floor("value")) if integer is None else F.lit(integer)
    return pixels.groupBy(*per).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), whole.alias("whole"))


def _by_value(pixels: DataFrame, integer: bool | None) -> bool | None:
    """``integer``, or True where the type of the column has whole numbers alone."""
    kinds = ("tinyint", "smallint", "int", "bigint")
    return True if integer is None and pixels.schema["value"].dataType.simpleString() in kinds else integer


def histogram(pixels: DataFrame, per: list[str], integer: bool | None = None, bins: int = FLOAT_BINS) -> DataFrame:
    """(key, b, n): a row for each value that occurs, or for float images for each of ``bins`` equal bins, at its centre.

    Without ``integer`` a key whose values are all whole has a bin for each value.
    Null values count in no bin.
    """
    pixels, integer = pixels.where("value IS NOT NULL"), _by_value(pixels, integer)
    if integer:
        return pixels.groupBy(*per, F.col("value").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width))).otherwise(0)
    b = F.when(F.col("whole"), F.col("value").cast("double")).otherwise(_centre(place, width))
    return pixels.join(_ends(pixels, per, integer), per).groupBy(*per, b.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _centre(place: Column, width: Column) -> Column:
    return F.when(width > 0, F.col("lo") + (place + 0.5) * width).otherwise(F.col("lo"))


def full_histogram(pixels: DataFrame, per: list[str], integer: bool | None = None, bins: int = FLOAT_BINS) -> DataFrame:
    """``histogram`` with its empty bins; values that aren't whole are an error if ``integer``."""
    pixels, integer = pixels.where("value IS NOT NULL"), _by_value(pixels, integer)
    hist = histogram(pixels, per, integer, bins)
    if integer:
        whole = F.when(F.col("b") == F.floor("b"), F.col("b")).otherwise(F.raise_error(F.lit("values are not whole: use integer=False")).cast("double"))
        hist = hist.withColumn("b", whole)
        ends = hist.groupBy(*per).agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.lit(True).alias("whole"))
    else:
        ends = _ends(pixels, per, integer)
    width = (F.col("hi") - F.col("lo")) / bins
    last = F.when(F.col("whole"), F.col("hi") - F.col("lo")).when(width > 0, bins - 1).otherwise(0).cast("long")
    b = F.when(F.col("whole"), (F.col("lo") + F.col("i")).cast("double")).otherwise(_centre(F.col("i"), width))
    every = ends.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*per, b.alias("b"))
    return every.join(hist, [*per, "b"], "left").select(*per, "b", F.coalesce("n", F.lit(0)).alias("n"))


def _first_best(hist: DataFrame, per: list[str], score: Column) -> DataFrame:
    """The least bin of the best score; a key without any score (one value) has that value as its cut."""
    best = F.max(F.when(score.isNotNull(), F.struct(score.alias("s"), (-F.col("b")).alias("m"))))
    return hist.groupBy(*per).agg(F.coalesce(-best["m"], F.max("b")).alias("cut"))


def _running(hist: DataFrame, per: list[str]) -> DataFrame:
    """Counts n0, sums s0 and squares q0 up to each bin, and n1, s1, q1 above it."""
    upto = Window.partitionBy(*per).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*per)
    n, s, q = F.col("n").cast("double"), F.col("n") * F.col("b"), (F.col("n") * F.col("n")).cast("double")
    out = hist
    for name, x in (("n", n), ("s", s), ("q", q)):
        out = out.withColumn(f"{name}0", F.sum(x).over(upto)).withColumn(f"{name}1", F.sum(x).over(whole) - F.col(f"{name}0"))
    return out


def _loop(name: str):
    """Cuts that need a loop over one histogram."""

    def li(b: np.ndarray, n: np.ndarray) -> float:
        low = b.min()
        v = b - low
        if len(b) == 1:
            return float(b[0])
        tolerance = np.diff(v).min() / 2
        new, old = float((v * n).sum() / n.sum()), -1.0
        while abs(new - old) > tolerance:
            old = new
            above = v > old
            fore, back = (v * n)[above].sum() / n[above].sum(), (v * n)[~above].sum() / n[~above].sum()
            if back <= 0:
                break
            new = (back - fore) / (np.log(back) - np.log(fore))
        return float(new + low)

    def minimum(b: np.ndarray, n: np.ndarray) -> float:
        smooth = n.astype(float)
        for _ in range(10_000):
            padded = np.pad(smooth, 1, mode="edge")
            smooth = (padded[:-2] + padded[1:-1] + padded[2:]) / 3
            rise = np.sign(np.diff(np.concatenate([[0.0], smooth, [0.0]])))
            moves = rise[rise != 0]
            places = np.flatnonzero(rise != 0)
            peaks = places[:-1][(moves[:-1] > 0) & (moves[1:] < 0)]
            if len(peaks) == 2:
                return float(b[peaks[0] + np.argmin(smooth[peaks[0] : peaks[1] + 1])])
            if len(peaks) < 2:
                break
        return float("nan")

    return {"li": li, "minimum": minimum}[name]


def cuts(pixels: DataFrame, method: str = "otsu", per: list[str] | None = None, integer: bool | None = None, strict: bool = False) -> DataFrame:
    """(key, cut). The minimum method has a null cut for a key that never has two peaks, or an error if ``strict``."""
    per = per or ["image_id"]
    if method == "mean":
        return pixels.groupBy(*per).agg(F.avg("value").alias("cut"))
    hist = histogram(pixels, per, integer)
    n0, n1, s0, s1 = (F.col(c) for c in ("n0", "n1", "s0", "s1"))
    if method == "otsu":
        d = (s0 + s1) * n0 - (n0 + n1) * s0
        return _first_best(_running(hist, per), per, F.when(n1 > 0, d * d / F.nullif(n0 * n1, F.lit(0.0))))
    if method == "yen":
        return _first_best(_running(hist, per), per, F.when(n1 > 0, (n0 * n1) * (n0 * n1) / F.nullif(F.col("q0") * F.col("q1"), F.lit(0.0))))
    if method == "isodata":
        after = F.lead("b").over(Window.partitionBy(*per).orderBy("b"))
        twice = s0 / n0 + s1 / F.nullif(n1, F.lit(0.0))
        ok = (twice >= 2 * F.col("b")) & (twice < 2 * F.col("after"))
        rows = _running(hist, per).withColumn("after", after)
        return rows.groupBy(*per).agg(F.coalesce(F.min(F.when(ok, F.col("b"))), F.max("b")).alias("cut"))
    if method == "triangle":
        rows = full_histogram(pixels, per, integer)
        whole = Window.partitionBy(*per)
        peak = F.max(F.struct("n", (-F.col("b")).alias("m"))).over(whole)
        rows = rows.withColumn("top", peak["n"]).withColumn("peak", -peak["m"]).withColumn("lo", F.min("b").over(whole)).withColumn("hi", F.max("b").over(whole))
        b, top, at, lo, hi = (F.col(c) for c in ("b", "top", "peak", "lo", "hi"))
        left = (at - lo) > (hi - at)
        far = F.when(left & (b < at), top * (b - lo) - (at - lo) * F.col("n")).when(~left & (b > at), top * (hi - b) - (hi - at) * F.col("n"))
        # from the tail's end on, the first of equal distances
        best = F.max(F.when(far.isNotNull(), F.struct(far.alias("d"), F.when(left, -b).otherwise(b).alias("m"), b.alias("b"))))
        return rows.groupBy(*per).agg(F.coalesce(best["b"], F.max("b")).alias("cut"))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    find = _loop(method)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b")
        cut = find(rows["b"].to_numpy(), rows["n"].to_numpy())
        if cut != cut and strict:
            raise ValueError(f"image {key}: the histogram never has two peaks")
        return pd.DataFrame([[*key, None if cut != cut else cut]], columns=[*per, "cut"])

    rows = full_histogram(pixels, per, integer) if method == "minimum" else hist
    fields = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in per)
    return rows.groupBy(*per).applyInPandas(one, f"{fields}, cut double")


def apply_cut(pixels: DataFrame, cut: DataFrame, per: list[str] | None = None, invert: bool = False) -> DataFrame:
    """Pixels with value 1 above the cut and else 0; inverted, the other way round."""
    per = per or ["image_id"]
    above = F.col("value") <= F.col("cut") if invert else F.col("value") > F.col("cut")
    return pixels.join(cut, per).withColumn("value", F.when(above, 1).otherwise(0)).drop("cut")


def threshold(pixels: DataFrame, method: str = "otsu", per: list[str] | None = None, invert: bool = False, label_objects: bool = True, integer: bool | None = None) -> DataFrame:
    """Mask of a method's foreground, or its objects as labels. Colour is averaged to gray first, which makes it a float image."""
    from pixelweave.operators.components import label
    from pixelweave.operators.intensity import to_gray

    if "c" in pixels.columns and "c" not in (per or []):
        pixels, integer = to_gray(pixels), False
    per = per or ["image_id"]
    mask = apply_cut(pixels, cuts(pixels, method, per, integer), per, invert)
    return label(mask.where("value = 1").drop("value"), per) if label_objects else mask


def multiotsu_cuts(pixels: DataFrame, classes: int = 3, per: list[str] | None = None, integer: bool | None = None) -> DataFrame:
    """(key, cuts): the classes - 1 cuts of the largest between-class variance; null for fewer values than classes."""
    if classes < 2:
        raise ValueError("two classes at least")
    per = per or ["image_id"]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b")
        b, n = rows["b"].to_numpy(), rows["n"].to_numpy().astype(float)
        return pd.DataFrame([[*key, best_cuts(b, n, classes)]], columns=[*per, "cuts"])

    fields = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in per)
    return histogram(pixels, per, integer).groupBy(*per).applyInPandas(one, f"{fields}, cuts array<double>")


def best_cuts(b: np.ndarray, n: np.ndarray, classes: int) -> list[float] | None:
    """By dynamic programming: the best score of k classes up to each bin, from that of k - 1.

    The best begin of the last class never falls as its end grows, so the ends are
    halved: those in between look only between the begins of their neighbours. Then the
    choices whose score is the best but for rounding are gone through: of equal sums of the
    classes in their order, the one with the least first cut, then second, counts. Memory
    is in proportion to the number of bins.
    """
    if len(b) < classes:
        return None
    c, s, size = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * b)]), len(b)

    def part(i: np.ndarray, j: np.ndarray) -> np.ndarray:  # class of bins [i, j)
        return (s[j] - s[i]) ** 2 / (c[j] - c[i])

    ends = np.arange(1, size + 1)
    scores = [np.full(size + 1, -np.inf), score := np.concatenate([[-np.inf], part(np.zeros_like(ends), ends)])]
    for made in range(1, classes):
        best = np.full(size + 1, -np.inf)
        # intervals of ends, each with the begins that its ends may have
        todo = np.array([[made + 1, size, made, size - 1]])
        while len(todo):
            low, high, first, last = todo.T
            end = (low + high) // 2
            upto = np.minimum(last, end - 1)
            count = upto - first + 1
            cut = np.cumsum(count) - count
            i = np.arange(count.sum()) - np.repeat(cut - first, count)
            value = score[i] + part(i, np.repeat(end, count))
            top = np.maximum.reduceat(value, cut)
            hit = np.flatnonzero(value == np.repeat(top, count))
            at = i[hit[np.searchsorted(hit, cut)]]
            best[end] = top
            todo = np.concatenate([np.stack([low, end - 1, first, at], 1)[low < end], np.stack([end + 1, high, at, last], 1)[end < high]])
        scores.append(score := best)
    least, found = score[size] - 4 * classes * np.spacing(abs(score[size])), []

    def look(made: int, cuts: list[int], rest: float) -> None:
        """Cuts before those found from the end on, whose classes have the score ``rest``."""
        i = np.arange(made, cuts[0])
        last = part(i, np.full_like(i, cuts[0]))
        for k in np.flatnonzero(scores[made][i] + last + rest >= least):
            if made > 1:
                look(made - 1, [i[k], *cuts], rest + last[k])
                continue
            every = np.array([0, i[k], *cuts])
            choice = (-float(sum(part(every[:-1], every[1:]))), [int(x) for x in every[1:-1]])
            found[:] = [min([*found, choice])]

    look(classes - 1, [size], 0.0)
    return [float(b[x - 1]) for x in found[0][1]]


def multiotsu(pixels: DataFrame, classes: int = 3, per: list[str] | None = None, label_objects: bool = False, integer: bool | None = None) -> DataFrame:
    """Class 0 to classes - 1 of each pixel (a value at a cut is below it), or the objects of the brightest class."""
    from pixelweave.operators.components import label

    per = per or ["image_id"]
    found = pixels.join(multiotsu_cuts(pixels, classes, per, integer), per)
    kind = F.aggregate("cuts", F.lit(0), lambda acc, t: acc + F.when(F.col("value") > t, 1).otherwise(0))
    out = found.withColumn("value", kind).drop("cuts")
    return label(out.where(F.col("value") == classes - 1).drop("value"), per) if label_objects else out
