"""Label tables: overlaps and links between slices, statistics, sizes, boxes and counts. Background rows are absent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.graph import components
from pixelweave.functions.ranks import ranked
from pixelweave.functions.staging import staged


def areas(labels: DataFrame, per: list[str]) -> DataFrame:
    return labels.where("label <> 0").groupBy(*per, "label").agg(F.count(F.lit(1)).alias("area"))


def overlaps(labels: DataFrame, axis: str = "z", key: str = "image_id") -> DataFrame:
    """Pairs of objects that share pixels on adjacent slices: (key, axis of the first, a, b, both, area_a, area_b, iou, iop)."""
    px = labels.where("label <> 0").select(key, axis, "y", "x", "label")
    size = areas(px, [key, axis])
    after = px.select(key, (F.col(axis) - 1).alias(axis), "y", "x", F.col("label").alias("b"))
    # the position leads the join, so one deep volume spreads over all tasks
    shared = px.withColumnRenamed("label", "a").join(after, [key, "y", "x", axis]).groupBy(key, axis, "a", "b").agg(F.count(F.lit(1)).alias("both"))
    first = size.select(key, axis, F.col("label").alias("a"), F.col("area").alias("area_a"))
    second = size.select(key, (F.col(axis) - 1).alias(axis), F.col("label").alias("b"), F.col("area").alias("area_b"))
    out = shared.join(first, [key, axis, "a"]).join(second, [key, axis, "b"])
    return out.select(
        key, axis, "a", "b", "both", "area_a", "area_b", (F.col("both") / (F.col("area_a") + F.col("area_b") - F.col("both"))).alias("iou"), (F.col("both") / F.least("area_a", "area_b")).alias("iop")
    )


def assignment(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a one-to-one choice with the largest total score (shortest augmenting paths)."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score).astype(float)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reach = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reach < least[free]
            least[free[better]] = reach[better]
            way[free[better]] = j0
            j1 = free[least[free].argmin()]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    columns = np.flatnonzero(match[1:])
    rows = match[columns + 1] - 1
    return (columns, rows) if flip else (rows, columns)


def links(labels: DataFrame, axis: str = "z", threshold: float = 0.1, criterion: str = "iou", key: str = "image_id") -> DataFrame:
    """(key, axis, a, b): the best one-to-one links of adjacent slices that reach the threshold.

    Pairs that share nothing add nothing to a total, so each connected block of
    overlaps is solved alone.
    """
    if criterion not in ("iou", "iop"):
        raise ValueError(f"criterion is iou or iop, not {criterion!r}")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold lies in [0, 1]")
    pairs = overlaps(labels, axis, key).select(key, axis, "a", "b", F.col(criterion).alias("score"))

    def solve(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, ia = np.unique(rows["a"], return_inverse=True)
        b, ib = np.unique(rows["b"], return_inverse=True)
        block = _blocks(ia, ib + len(a), len(a) + len(b))[ia]
        kept = []
        for one in np.unique(block):
            at = np.flatnonzero(block == one)
            ra, ja = np.unique(ia[at], return_inverse=True)
            rb, jb = np.unique(ib[at], return_inverse=True)
            score = np.zeros((len(ra), len(rb)))
            score[ja, jb] = rows["score"].to_numpy()[at]
            r, c = assignment(score)
            good = (score[r, c] >= threshold) & (score[r, c] > 0)
            kept += list(zip(a[ra[r[good]]], b[rb[c[good]]], strict=True))
        out = pd.DataFrame(kept, columns=["a", "b"])
        out[key], out[axis] = keys
        return out[[key, axis, "a", "b"]]

    kinds = {c: labels.schema[c].dataType.simpleString() for c in (key, axis, "label")}
    return pairs.groupBy(key, axis).applyInPandas(solve, f"{key} {kinds[key]}, {axis} {kinds[axis]}, a {kinds['label']}, b {kinds['label']}")


def _blocks(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not (root == root[root]).all():
            root = root[root]


def chains(pairs: DataFrame, axis: str = "z", key: str = "image_id") -> DataFrame:
    """(key, axis, label, root_axis, root_label): the first object of the chain of links that each linked object is in."""
    end = lambda x, name: F.struct(F.col(key).alias("k"), x.alias("z"), F.col(name).alias("l"))
    edges = pairs.select(end(F.col(axis), "a").alias("a"), end(F.col(axis) + 1, "b").alias("b"))
    found = components(edges)
    return found.select(F.col("v.k").alias(key), F.col("v.z").alias(axis), F.col("v.l").alias("label"), F.col("root.z").alias("root_axis"), F.col("root.l").alias("root_label"))


def connect(labels: DataFrame, axis: str = "z", threshold: float = 0.1, criterion: str = "iou", key: str = "image_id") -> DataFrame:
    """Labels with one id along each chain: 1..n by first slice, then by label there. A gap starts a new id."""
    labels = labels.where("label <> 0")
    pairs = staged(links(labels, axis, threshold, criterion, key), "links")
    objects = labels.select(key, axis, "label").distinct()
    rooted = objects.join(chains(pairs, axis, key), [key, axis, "label"], "left")
    rooted = rooted.withColumn("root_axis", F.coalesce("root_axis", axis)).withColumn("root_label", F.coalesce("root_label", "label"))
    ids = ranked(rooted.select(key, "root_axis", "root_label").distinct(), [key], ["root_axis", "root_label"], "id")
    named = rooted.join(ids, [key, "root_axis", "root_label"]).select(key, axis, "label", "id")
    return labels.join(named, [key, axis, "label"]).drop("label").withColumnRenamed("id", "label")


def boxes_from_labels(labels: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Half-open boxes of the objects."""
    per = per or ["image_id"]
    ends = (F.min("y").alias("min_y"), F.min("x").alias("min_x"), (F.max("y") + 1).alias("max_y"), (F.max("x") + 1).alias("max_x"))
    return labels.where("label <> 0").groupBy(*per, "label").agg(*ends)


def masks_from_labels(labels: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, mask_id, y, x): objects as masks, numbered from 0 by label."""
    ids = ranked(labels.where("label <> 0").select(key, "label").distinct(), [key], ["label"], "mask_id").withColumn("mask_id", F.col("mask_id") - 1)
    return labels.join(ids, [key, "label"]).select(key, "mask_id", "y", "x")


def object_counts(labels: DataFrame, per: list[str] | None = None) -> DataFrame:
    per = per or ["image_id"]
    return labels.where("label <> 0").groupBy(*per).agg(F.countDistinct("label").alias("objects"))


def object_statistics(labels: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Number of objects and mean, deviation, least and largest of their areas."""
    per = per or ["image_id"]
    size = areas(labels, per)
    return size.groupBy(*per).agg(
        F.count(F.lit(1)).alias("objects"), F.avg("area").alias("mean_area"), F.stddev_pop("area").alias("std_area"), F.min("area").alias("min_area"), F.max("area").alias("max_area")
    )


def drop_small(labels: DataFrame, min_size: int = 15, per: list[str] | None = None) -> DataFrame:
    """Without objects of fewer pixels; -1 keeps all."""
    per = per or ["image_id"]
    if min_size < 0:
        return labels
    return labels.join(areas(labels, per).where(F.col("area") >= min_size), [*per, "label"], "left_semi")


def centres(labels: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Centroids of the objects as points."""
    per = per or ["image_id"]
    dims = [c for c in ("z", "y", "x") if c in labels.columns and c not in per]
    return labels.where("label <> 0").groupBy(*per, "label").agg(*(F.avg(c).alias(c) for c in dims))
