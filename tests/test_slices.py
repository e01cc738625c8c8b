"""Stacks through the model-free detector and masker, float images without a flag, and the grid of boxes."""

import random

import pytest
from pyspark.sql import functions as F

from pixelweave.operators import boxes, models, threshold


def two_planes(spark):
    rows = [(1, z, y, x, 9.0 if z == 0 and y < 4 and x < 4 else 7.0 if z == 1 and y > 6 and x > 5 else 1.0) for z in (0, 1) for y in range(10) for x in range(10)]
    return spark.createDataFrame(rows, "image_id long, z int, y int, x int, value double")


def test_detector_and_masker_keep_planes_apart(spark):
    px = two_planes(spark)
    found = models.classical_boxes(px, 3)
    got = {(r["z"], r["min_y"], r["min_x"], r["max_y"], r["max_x"]): r["score"] for r in found.collect()}
    assert got == {(0, 0, 0, 4, 4): 1.0, (1, 7, 6, 10, 10): 1.0}
    wide = found.withColumns({"min_y": F.greatest(F.col("min_y") - 1, F.lit(0)), "min_x": F.greatest(F.col("min_x") - 1, F.lit(0)), "max_y": F.col("max_y") + 1, "max_x": F.col("max_x") + 1})
    masks = models.classical_masks(px, wide).groupBy("z", "mask_id").count().collect()
    assert {(r["z"], r["mask_id"]): r["count"] for r in masks} == {(0, 0): 16, (1, 0): 12}
    with pytest.raises(ValueError, match="slices by"):
        models.classical_masks(px, wide.drop("z"))


def test_float_images_have_256_bins_and_whole_ones_a_bin_for_each_value(spark):
    rng = random.Random(4)
    rows = [(0, rng.random()) for _ in range(4000)] + [(1, float(rng.randrange(1000))) for _ in range(4000)] + [(0, None), (2, None)]
    px = spark.createDataFrame(rows, "image_id long, value double")
    bins = {r["image_id"]: r["n"] for r in threshold.histogram(px, ["image_id"]).groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    assert bins[0] <= 256 and bins[1] > 900 and 2 not in bins
    for method in threshold.METHODS:
        if method != "mean":
            both = threshold.cuts(px, method).collect()
            alone = {i: threshold.cuts(px.where(f"image_id = {i}"), method, integer=bool(i)).collect()[0]["cut"] for i in (0, 1)}
            assert {r["image_id"]: r["cut"] for r in both} == alone, method
    assert threshold.histogram(px.withColumn("value", F.col("value").cast("int")), ["image_id"]).where("image_id = 0").count() == 1


def test_grid_of_boxes_gives_all_pairs_and_pixels(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        y, x, h, w = rng.randrange(-30, 200), rng.randrange(-30, 200), rng.choice([1, 3, 17, 64, 250]), rng.choice([1, 5, 16, 90, 300])
        rows.append((rng.randrange(2), i, float(y), float(x), float(y + h - rng.choice([0, 0.5])), float(x + w)))
    rows.append((0, 99, -10.0, -10.0, 20000.0, 30000.0))
    bx = spark.createDataFrame(rows, "image_id long, box_id int, min_y double, min_x double, max_y double, max_x double")
    want = {}
    for i, a, t, u, v, w in rows:
        for j, b, p, q, r, s in rows:
            if i == j and a < b:
                h, wd = min(v, r) - max(t, p), min(w, s) - max(u, q)
                if h > 0 and wd > 0:
                    want[i, a, b] = h * wd / ((v - t) * (w - u) + (r - p) * (s - q) - h * wd)
    got = [((r["image_id"], r["a"], r["b"]), r["iou"]) for r in boxes.iou_pairs(bx).collect()]
    assert len(got) == len(dict(got)) == len(want) and all(abs(dict(got)[k] - v) < 1e-9 for k, v in want.items())
    px = spark.createDataFrame([(i, y, x, 1.0) for i in (0, 1) for y in range(0, 230, 7) for x in range(0, 230, 5)], "image_id long, y int, x int, value double")
    inside = sorted((i, a, y, x) for i, a, t, u, v, w in rows for y in range(0, 230, 7) for x in range(0, 230, 5) if t <= y < v and u <= x < w)
    assert sorted((r["image_id"], r["box_id"], r["y"], r["x"]) for r in boxes.box_pixels(bx, px).collect()) == inside
    placed = boxes._placed(bx.withColumn("level", boxes._level())).groupBy("box_id").count()
    assert placed.agg(F.max("count")).collect()[0][0] <= 4
