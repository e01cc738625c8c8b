"""Models with two stages: one encoding a plane, whatever the batches."""

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import models
from pixelweave.sources import tiles as t


def counting():
    """A kind of model that leaves a file for each call."""

    class Counting:
        def __init__(self, folder):
            self.folder = folder

        def mark(self, what):
            open(os.path.join(self.folder, f"{what}-{uuid.uuid4().hex}"), "w").close()

        def encode(self, plane):
            self.mark("encode")
            return plane * 2

        def decode(self, encoded, boxes):
            self.mark("decode")
            return [encoded[int(y0) : int(y1), int(x0) : int(x1)] > 6 for y0, x0, y1, x1 in boxes]

    return Counting


def test_one_encoding_a_plane_and_no_effect_of_the_batches(spark, tmp_path):
    rng, kind = np.random.default_rng(2), counting()
    rows = [(i, z, y, x, float(rng.integers(0, 6))) for i in (1, 2) for z in (0, 1) for y in range(9) for x in range(8)]
    tiles = t.to_tiles(spark.createDataFrame(rows, "image_id long, z int, y int, x int, value double"), 16)
    found = [(i, z, b, float(b % 4), float(b % 3), b % 4 + 5.0, b % 3 + 4.0, 0.9) for i, z in ((1, 0), (1, 1), (2, 1)) for b in range(23)]
    boxes = spark.createDataFrame(found, "image_id long, z int, box_id int, min_y double, min_x double, max_y double, max_x double, score double")
    value = {r[:4]: r[4] for r in rows}
    want = {(i, z, b, y, x) for i, z, b, y0, x0, y1, x1, _ in found for y in range(int(y0), int(y1)) for x in range(int(x0), int(x1)) if value[i, z, y, x] > 3}
    for size, calls in ((1, 69), (10, 9), (100, 3)):
        folder = tmp_path / str(size)
        folder.mkdir()
        masks, kept = models.mask_with(tiles, boxes, lambda folder=str(folder), kind=kind: kind(folder), size)
        assert {tuple(r) for r in masks.select("image_id", "z", "mask_id", "y", "x").collect()} == want
        names = os.listdir(folder)
        assert sum(n.startswith("encode") for n in names) == 3 and sum(n.startswith("decode") for n in names) == calls
    assert kept.count() == len({w[:3] for w in want})
    plain = models.mask_with(tiles, boxes, lambda: lambda plane, sides: [plane[int(a) : int(c), int(b) : int(d)] > 3 for a, b, c, d in sides], 7)[0]
    assert {tuple(r) for r in plain.select("image_id", "z", "mask_id", "y", "x").collect()} == want
    assert models.mask_with(tiles, boxes.where(F.lit(False)), lambda kind=kind: kind("nowhere"))[0].count() == 0
