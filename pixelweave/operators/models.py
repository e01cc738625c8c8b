"""Batch inference with any model, and model-free stand-ins for detectors and maskers.

A model is made once for all rows that a Python worker gets in a task. Slice columns
(z, c, t) of the tiles stay in the results.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.ranks import ranked
from pixelweave.functions.staging import staged
from pixelweave.operators import labels, threshold
from pixelweave.operators.boxes import SIDES, box_pixels, equals, nms, slices
from pixelweave.operators.components import label, sparse_roots
from pixelweave.sources.tiles import _fields, _keys, _numbers, axes, whole_blocks


def segment_with(tiles: DataFrame, model_factory: Callable, normalize: bool = True) -> DataFrame:
    """Labels (image_id, slice columns, axes, label) of a model from a plane or volume to a mask or label image; masks become their objects.

    With ``normalize`` a plane or volume is scaled by its percentiles 1 and 99.8 first.
    """
    keys, dims = _keys(tiles), axes(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()
        for rows in batches:
            for i, block in enumerate(whole_blocks(rows, dims)):
                if normalize:
                    low, high = np.percentile(block, (1.0, 99.8))
                    block = (block - low) / (high - low + 1e-20)
                made = np.asarray(model(block))
                spots = np.nonzero(made)
                found = made[spots].astype(np.int64)
                if made.dtype == bool and len(found):
                    found = np.unique(sparse_roots(np.stack(spots, axis=1)), return_inverse=True)[1] + 1
                row = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays([*(rows.column(k).take(row) for k in keys), *(pa.array(s, pa.int32()) for s in spots), pa.array(found, pa.int64())], [*keys, *dims, "label"])

    return tiles.select(*keys, *_numbers(dims), "data").mapInArrow(run, _fields(tiles, keys) + "".join(f"{c} int, " for c in dims) + "label long")


_BOX = "box_id int, min_y float, min_x float, max_y float, max_x float, score double"


def detect_with(tiles: DataFrame, model_factory: Callable, conf: float = 0.4, iou: float = 0.9, max_det: int = 300) -> DataFrame:
    """Boxes (image_id, slice columns, box) of a model from a plane to rows (x0, y0, x1, y1, score), filtered, suppressed and capped a plane."""
    keys = _keys(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()
        for rows in batches:
            found = [np.asarray(model(block), float).reshape(-1, 5) for block in whole_blocks(rows, ("y", "x"))]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            sides = np.concatenate(found) if found else np.zeros((0, 5))
            numbers = np.concatenate([np.arange(len(f)) for f in found]) if found else np.zeros(0)
            columns = [pa.array(numbers, pa.int32()), *(pa.array(sides[:, c], pa.float32()) for c in (1, 0, 3, 2)), pa.array(sides[:, 4])]
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(row) for k in keys), *columns], [*keys, *(x.split()[0] for x in _BOX.split(", "))])

    return nms(tiles.select(*keys, *_numbers(("y", "x")), "data").mapInArrow(run, _fields(tiles, keys) + _BOX), conf, iou, max_det, keys)


def mask_with(tiles: DataFrame, boxes: DataFrame, model_factory: Callable, batch_size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(masks, surviving boxes) of a model from a plane and boxes to one mask a box, relative to the box's corner.

    A model has ``encode(plane)``, called once for each plane that has boxes, and ``decode(encoded, boxes)``,
    called for ``batch_size`` boxes at a time; encodings (arrays) are staged, and the batches of one plane
    are decoded in parallel tasks. A plain function of (plane, boxes) is a model whose encoding is the plane itself. Boxes
    are ranked by ranges, so a plane may have any number of them; the batch size has no effect on the result.
    """
    keys, names = _keys(tiles), _numbers(("y", "x"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()
        for rows in batches:
            made = [model.encode(block) if hasattr(model, "encode") else block for block in whole_blocks(rows, ("y", "x"))]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), pa.array([_saved(m) for m in made], pa.binary())], [*keys, "encoded"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()
        call = model.decode if hasattr(model, "decode") else model
        for rows in batches:
            for i in range(rows.num_rows):
                found, own = rows.column("found").slice(i, 1).flatten(), rows.slice(i, 1)
                sides = np.stack([found.field(c).to_numpy(zero_copy_only=False).astype(float) for c in SIDES], axis=1)
                ids, parts = found.field("box_id").to_pylist(), []
                for (y0, x0, _, _), box, made in zip(sides, ids, call(_loaded(own.column("encoded")[0].as_py()), sides), strict=True):
                    y, x = np.nonzero(made)
                    parts.append((np.full(len(y), box), y + int(y0), x + int(x0)))
                spots = [np.concatenate(p) for p in zip(*parts, strict=True)]
                row = pa.array(np.zeros(len(spots[0]), np.int64))
                yield pa.RecordBatch.from_arrays([*(own.column(k).take(row) for k in keys), *(pa.array(v, pa.int32()) for v in spots)], [*keys, "mask_id", "y", "x"])

    fields = _fields(tiles, keys)
    asked = tiles.join(boxes.select(*keys).distinct(), keys, "left_semi").select(*keys, *names, "data")
    encoded = staged(asked.mapInArrow(encode, fields + "encoded binary"), "encoded")
    batch = F.floor((F.col("rank") - 1) / batch_size).alias("batch")
    listed = F.array_sort(F.collect_list(F.struct("box_id", *SIDES))).alias("found")  # of a batch's boxes
    batches = ranked(boxes.select(*keys, "box_id", *SIDES), keys, ["box_id"]).groupBy(*keys, batch).agg(listed)
    masks = encoded.join(batches, keys).select(*keys, "encoded", "found").mapInArrow(decode, fields + "mask_id int, y int, x int")
    kept = masks.select(*keys, F.col("mask_id").alias("box_id")).distinct()
    return masks, boxes.join(kept, [*keys, "box_id"], "left_semi")


def _saved(made) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(made), allow_pickle=False)
    return out.getvalue()


def _loaded(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def classical_boxes(pixels: DataFrame, min_size: int = 15) -> DataFrame:
    """Boxes of the objects above Otsu's cut of each plane; the score is the object's mean over the plane's largest value.

    Slice columns (t, c, z) part an image into planes and stay in the boxes.
    """
    per = slices(pixels)
    cut = threshold.apply_cut(pixels, threshold.cuts(pixels, per=per), per)
    objects = labels.drop_small(label(cut.where("value = 1").select(*per, "y", "x"), per), min_size, per)
    peak = pixels.groupBy(*per).agg(F.greatest(F.max("value"), F.lit(1e-20)).alias("peak"))
    score = objects.join(pixels, [*per, "y", "x"]).join(peak, per).groupBy(*per, "label").agg((F.avg("value") / F.max("peak")).alias("score"))
    found = labels.boxes_from_labels(objects, per).join(score, [*per, "label"])
    return found.withColumn("label", F.col("label") - 1).withColumnRenamed("label", "box_id")


def classical_masks(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """In each box, the pixels of its plane above Otsu's cut of the box. Planes that the boxes don't tell apart are an error."""
    if apart := [c for c in slices(pixels) if c not in boxes.columns]:
        raise ValueError(f"pixels have slices by {apart}, boxes don't")
    planes = slices(pixels)
    per = [*planes, "box_id"]
    # equal boxes have one mask, found once
    firsts, members = equals(boxes, planes)
    inside = staged(box_pixels(firsts, pixels), "inside")
    found = inside.join(threshold.cuts(inside, "otsu", per), per).where(F.col("value") > F.col("cut")).select(*planes, F.col("box_id").alias("first"), "y", "x")
    return members.join(found, [*planes, "first"]).select(*planes, F.col("box_id").alias("mask_id"), "y", "x")
