"""Image operators on Spark: fixtures with known results, and results that don't depend on tiles."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import kernels as k
from pixelweave.operators import axes, boxes, filters, labels, masks, threshold
from pixelweave.operators.components import label
from pixelweave.sources import tiles as t


def pixels(spark, planes, names=("image_id", "y", "x", "value")):
    rows = [(i, *map(int, at), float(v)) for i, a in planes.items() for at, v in np.ndenumerate(a)]
    return spark.createDataFrame([(r[0], *r[1][:], r[2]) if isinstance(r[1], tuple) else r for r in rows], list(names)).withColumns({c: F.col(c).cast("int") for c in names[1:-1]})


def squares():
    a = np.zeros((64, 64))
    a[10:25, 10:25], a[40:55, 40:55] = 200, 220
    return a


def test_every_threshold_finds_two_squares(spark):
    px = pixels(spark, {1: squares()}).cache()
    for method in threshold.METHODS:
        found = threshold.threshold(px, method, label_objects=False)
        area = found.agg(F.sum("value")).first()[0]
        assert area == 450, (method, area)
    assert threshold.threshold(px, "otsu").agg(F.max("label")).first()[0] == 2


def test_labels_and_filters_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(2)
    a = rng.random((23, 31))
    px = pixels(spark, {1: np.rint(a * 9)})
    mask = px.where("value > 4").drop("value")
    want = sorted(map(tuple, label(mask, tile=100).collect()))
    assert sorted(map(tuple, label(mask, tile=5).collect())) == want
    full = k.gaussian(np.rint(a * 9), 1.0)
    for side in (7, 16, 40):
        out = np.zeros(a.shape)
        for r in t.from_tiles(filters.gaussian(t.to_tiles(px, side))).collect():
            out[r.y, r.x] = r.value
        assert np.allclose(out, full), side


def stack(planes):
    out = []
    for z, parts in enumerate(planes):
        for (y0, y1, x0, x1), v in parts:
            out += [(1, z, y, x, v) for y in range(y0, y1) for x in range(x0, x1)]
    return out


@pytest.mark.parametrize(
    "planes, options, ids",
    [
        ([[((0, 9, 0, 9), 1)], [((8, 16, 8, 16), 1)]], {}, 2),
        ([[((0, 9, 0, 9), 1)], [((8, 16, 8, 16), 1)]], {"threshold": 0.0}, 1),
        ([[((0, 12, 0, 12), 1)], [((0, 3, 0, 3), 1)]], {}, 2),
        ([[((0, 12, 0, 12), 1)], [((0, 3, 0, 3), 1)]], {"criterion": "iop"}, 1),
        ([[((2, 8, 2, 8), 1)], [], [((2, 8, 2, 8), 1)]], {}, 2),
    ],
)
def test_connect(spark, planes, options, ids):
    rows = spark.createDataFrame(stack(planes), "image_id long, z int, y int, x int, label int")
    assert labels.connect(rows, **options).agg(F.countDistinct("label")).first()[0] == ids


def test_renumber_and_empty_inputs(spark):
    rows = spark.createDataFrame([(1, z, 0, q, q + 1) for z in range(3) for q in range(4)], "image_id long, z int, y int, x int, label int")
    assert sorted(r.label for r in axes.renumber(rows).collect()) == list(range(1, 13))
    none = rows.where("false")
    assert not axes.renumber(none).collect() and not labels.connect(none).collect() and not label(none.drop("label", "z")).collect()
    with pytest.raises(ValueError):
        axes.plan_axes(["z", "y", "x"], ["y", "x"])
    with pytest.raises(ValueError):
        labels.connect(rows, criterion="dice")


def test_masks_and_boxes(spark):
    cells = [(1, 0, y, x) for y in range(8) for x in range(8)] + [(1, 1, y, x) for y in range(2, 5) for x in range(2, 5)]
    m = spark.createDataFrame(cells, "image_id long, mask_id int, y int, x int")
    at = lambda s, y, x: masks.to_labels_2d(m, s).where(f"y = {y} AND x = {x}").collect()
    assert at("min", 3, 3)[0].label == 1 and at("max", 3, 3)[0].label == 2 and not at("min", 9, 9)
    assert masks.from_runs(masks.to_runs(m)).count() == m.count()
    with pytest.raises(ValueError):
        masks.to_labels_2d(m, "mean")
    b = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 0.9), (1, 1, 1, 1, 11, 11, 0.8), (1, 2, 20, 20, 30, 30, 0.5), (1, 3, 0, 0, 9, 9, 0.1)], "image_id long, box_id int, min_y int, min_x int, max_y int, max_x int, score double")
    assert sorted(r.box_id for r in boxes.nms(b, 0.4, 0.5).collect()) == [0, 2]
    assert boxes.nms(b, 0.4, 0.9, 1).collect()[0].box_id == 0 and not boxes.nms(b.where("false")).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
