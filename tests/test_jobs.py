"""Thresholds on colour and floats, models over stacks, suppression, tissue masks and workflows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import kernels as k
from pixelweave.jobs import workflows
from pixelweave.operators import axes, boxes, filters, intensity, labels, models, threshold, tissue
from pixelweave.sources import tiles as t

RNG = np.random.default_rng(6)


def table(spark, a, names):
    spots = np.indices(a.shape).reshape(a.ndim, -1)
    rows = [(*map(int, s), float(v)) for *s, v in zip(*spots, a.reshape(-1), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'image_id' else 'int'}" for c in names) + ", value double")


def two_levels(*shape):
    a = RNG.normal(40, 4, shape)
    a[..., 4:12, 3:9] += 100
    return a


@pytest.mark.parametrize("method", threshold.METHODS)
def test_every_method_finds_the_square_in_colour_and_floats(spark, method):
    colour = np.rint(two_levels(1, 3, 16, 16))
    for px in (table(spark, colour, ["image_id", "c", "y", "x"]), table(spark, two_levels(1, 16, 16) / 7, ["image_id", "y", "x"])):
        mask = threshold.threshold(px, method, label_objects=False, integer="c" in px.columns)
        rows = mask.toPandas()
        square = rows.y.between(4, 11) & rows.x.between(3, 8)
        assert (rows.value[square] == 1).all() and len(rows) == 256
        # a cut is a bin's centre, so a few of the cut's own bin may pass; some methods cut lower
        assert method in ("mean", "triangle", "li", "yen") or rows.value[~square].sum() <= 6


def test_full_histogram_loses_nothing(spark):
    px = table(spark, two_levels(1, 16, 16), ["image_id", "y", "x"])
    hist = threshold.full_histogram(px, ["image_id"], integer=False)
    assert hist.count() == 256 and hist.agg(F.sum("n")).first()[0] == 256
    with pytest.raises(Exception, match="not whole"):
        threshold.cuts(px, "triangle", integer=True).collect()


def test_best_cuts_against_all_choices_and_at_16_bits():
    import itertools

    for _ in range(30):
        m, classes = RNG.integers(4, 12), RNG.integers(2, 5)
        b, n = np.sort(RNG.choice(60, m, replace=False)).astype(float), RNG.integers(1, 9, m).astype(float)

        def score(cut):
            ends = [0, *cut, m]
            return sum((n[i:j] * b[i:j]).sum() ** 2 / n[i:j].sum() for i, j in itertools.pairwise(ends))

        found = threshold.best_cuts(b, n, classes)
        at = [int(np.searchsorted(b, c)) + 1 for c in found]
        assert np.isclose(score(at), max(score(c) for c in itertools.combinations(range(1, m), classes - 1)))
    b = np.arange(65536.0)
    n = np.exp(-((b[:, None] - [9000, 30000, 52000]) ** 2) / 2e7).sum(axis=1) * 1000 + 1
    low, high = threshold.best_cuts(b, n, 3)
    assert 17_000 < low < 22_000 and 38_000 < high < 44_000


def test_models_keep_slices_and_are_made_once_a_worker(spark):
    stack = two_levels(2, 3, 16, 16)
    tiles = t.to_tiles(table(spark, stack, ["image_id", "z", "y", "x"]))
    found = models.segment_with(tiles, lambda: lambda a: a > 0.5).toPandas()
    assert set(found.columns) == {"image_id", "z", "y", "x", "label"} and len(found.drop_duplicates(["image_id", "z", "y", "x"])) == len(found)
    assert (found.groupby(["image_id", "z"]).size() >= 48).all() and len(found.groupby(["image_id", "z"])) == 6
    box = lambda: lambda a: [[0, 0, 8, 8, 0.9], [1, 0, 8, 8, 0.8], [4, 4, 16, 16, 0.5]]
    detected = models.detect_with(tiles, box, 0.4, 0.5)
    assert detected.count() == 12 and {r.z for r in detected.collect()} == {0, 1, 2}
    made = spark.sparkContext.accumulator(0)

    def masker():
        made.add(1)
        return lambda plane, sides: [plane[int(y0) : int(y1), int(x0) : int(x1)] > 90 for y0, x0, y1, x1 in sides]

    results = []
    for size in (100, 1):
        masks, kept = models.mask_with(tiles.coalesce(1), detected.coalesce(1), masker, size)
        results.append(sorted(map(tuple, masks.collect())))
        assert kept.count() == 12
    assert results[0] == results[1] and made.value <= 2 * 4


def test_solid_models(spark):
    stack = two_levels(1, 3, 16, 16)
    tiles = t.to_tiles(table(spark, stack, ["image_id", "z", "y", "x"]), volume=True)
    found = models.segment_with(tiles, lambda: lambda a: a > 90, normalize=False).toPandas()
    assert len(found) == 3 * 48 and set(found.label) == {1}


def test_suppression_in_rounds_against_the_greedy_loop(spark):
    rows = []
    for image in range(3):
        for i in range(60):
            y, x, s = RNG.integers(0, 40), RNG.integers(0, 40), RNG.integers(8, 20)
            rows.append((image, i, float(y), float(x), float(y + s), float(x + s), float(RNG.integers(1, 9)) / 10))
    frame = spark.createDataFrame(rows, "image_id long, box_id int, min_y float, min_x float, max_y float, max_x float, score double")
    want = set()
    for image in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == image and r[6] >= 0.3), key=lambda r: (-r[6], r[1])):
            def iou(q, r=r):
                h, w = min(q[4], r[4]) - max(q[2], r[2]), min(q[5], r[5]) - max(q[3], r[3])
                both = max(h, 0) * max(w, 0)
                return both / ((q[4] - q[2]) * (q[5] - q[3]) + (r[4] - r[2]) * (r[5] - r[3]) - both)
            if all(iou(q) <= 0.3 for q in kept):
                kept.append(r)
        want |= {(image, r[1]) for r in kept[:12]}
    assert {(r.image_id, r.box_id) for r in boxes.nms(frame, 0.3, 0.3, 12).collect()} == want


def test_tissue_background_by_marker(spark):
    rows = spark.createDataFrame([(1, 0, x, x / 10, 1 - x / 10, True, True, True, True) for x in range(10)], "image_id long, y int, x int, p0 double, p1 double, local0 boolean, local1 boolean, global0 boolean, global1 boolean")
    out = {r.x: (r.global0, r.global1) for r in tissue.remove_background(rows, (0.35, 0.75)).collect()}
    assert [x for x in out if out[x][0]] == [4, 5, 6, 7, 8, 9] and [x for x in out if out[x][1]] == [0, 1, 2]
    free = {r.x: r.global0 for r in tissue.remove_background(rows, None).collect()}
    assert not free[0] and free[9]


def test_local_masks_in_parts(spark):
    channels = table(spark, np.stack([two_levels(16, 16), two_levels(16, 16)])[None] / 150, ["image_id", "c", "y", "x"])
    one = sorted(map(tuple, tissue.local_masks(channels, 3).collect()))
    assert sorted(map(tuple, tissue.local_masks(channels, 3, side=5).collect())) == one and any(r[-1] for r in one)


def test_butterworth_and_gray(spark):
    a = two_levels(1, 16, 16)
    px = table(spark, a, ["image_id", "y", "x"])
    low, high = (t.from_tiles(filters.butterworth(t.to_tiles(px), 0.2, high_pass=h)).toPandas().sort_values(["y", "x"])["value"].to_numpy() for h in (False, True))
    assert np.allclose(low + high, a.reshape(-1)) and np.isclose(low.mean(), a.mean())
    there = intensity.to_gray(table(spark, np.stack([a[0], a[0] + 3, a[0] - 3])[None], ["image_id", "c", "y", "x"])).toPandas().sort_values(["y", "x"])
    assert np.allclose(there["value"], a.reshape(-1))


def test_workflows_take_functions(spark):
    stack = np.where(two_levels(1, 3, 16, 16) > 90, 100.0, 0.0)
    px = table(spark, stack, ["image_id", "z", "y", "x"])
    normalized, linked = workflows.connect_2d_in_3d(px)
    assert {r.label for r in linked.collect()} == {1} and normalized.count() == px.count()
    calls = []

    def own(name):
        def run(rows, **kw):
            calls.append((name, kw))
            return rows if name == "n" else labels.connect(rows) if name == "c" else threshold.threshold(rows, "mean", ["image_id", "z"], integer=False)

        return run

    workflows.connect_2d_in_3d(px, own("n"), own("s"), own("c"), {"a": 1}, None, {"b": 2})
    assert calls == [("n", {"a": 1}), ("s", {}), ("c", {"b": 2})]
    plane = table(spark, two_levels(1, 16, 16), ["image_id", "y", "x"])
    found, masked = workflows.detect_then_mask(plane)
    assert found.count() >= 1 and masked.count() > 0
    none, empty = workflows.detect_then_mask(plane, lambda p: boxes.nms(models.classical_boxes(p), 2.0))
    assert none.count() == empty.count() == 0
    tiles = t.to_tiles(plane)
    box = lambda: lambda a: [[2, 3, 12, 14, 0.9]]
    mask = lambda: lambda plane, sides: [plane[int(a) : int(c), int(b) : int(d)] > 90 for a, b, c, d in sides]
    found, masked = workflows.detect_then_mask(tiles, models.detect_with, models.mask_with, {"model_factory": box}, {"model_factory": mask})
    assert found.count() == 1 and {(r.y, r.x) for r in masked.collect()} == {(y, x) for y in range(4, 12) for x in range(3, 9)}
    smooth = workflows.smooth_threshold_label(tiles)
    # the square, and at most a few pixels of the cut's own bin
    sizes = sorted(smooth.groupBy("label").count().toPandas()["count"])
    assert sizes[-1] >= 40 and sum(sizes[:-1]) <= 6
    assert {r.label for r in workflows.threshold_planes_then_connect(table(spark, np.rint(stack), ["image_id", "z", "y", "x"])).collect()} == {1}


def test_planes_of_a_function(spark):
    stack = np.arange(24.0).reshape(1, 2, 3, 4)
    out = axes.apply_planes(table(spark, stack, ["image_id", "z", "y", "x"]), lambda a: a.max() - a, ["image_id", "z"], "image").toPandas()
    assert (out.groupby("z")["value"].max() == 11).all()


def test_streams_take_row_local_steps(spark, tmp_path):
    from pixelweave.streaming import rowlocal

    a = two_levels(1, 16, 16)
    table(spark, a, ["image_id", "y", "x"]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("image_id long, y int, x int, value double").parquet(f"{tmp_path}/in")
    query = rowlocal.threshold_stream(rowlocal.scaled_stream(stream, 2.0), 180.0).writeStream.format("memory").queryName("scaled").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(60)
    assert spark.table("scaled").agg(F.sum("value")).first()[0] == (2 * a > 180).sum() == 48


def test_kuwahara_against_a_plain_loop():
    a = RNG.normal(size=(9, 8))
    p, out = np.pad(a, 2, mode="reflect"), np.empty(a.shape)
    for y in range(9):
        for x in range(8):
            windows = [p[y + i : y + i + 3, x + j : x + j + 3] for i in (0, 2) for j in (0, 2)]
            out[y, x] = min(windows, key=lambda w: round(w.var(), 9)).mean()
    assert np.allclose(k.kuwahara(a, 2), out)
