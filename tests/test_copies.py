"""Equal boxes, unused PSFs and other input that grows without growing in kind."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweave.jobs import relational, workflows
from pixelweave.operators import boxes, components, masks, models, psf
from pixelweave.operators.deconvolve import packed_psf, richardson_lucy
from pixelweave.sources import tiles as tiles_module
from pixelweave.sources.tiles import to_tiles


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_psfs_in_use_are_packed_and_none_is_broadcast(spark):
    settings = spark.range(50).selectExpr("cast(id as int) psf_id", "3 xy_dim", "1.0 xy_sigma")
    tiles = to_tiles(spark.range(64).selectExpr("id div 16 image_id", "cast(id % 16 div 4 as int) y", "cast(id % 4 as int) x", "cast(id as double) value"))
    tiles = tiles.withColumn("psf_id", (F.col("image_id") % 2 * 7).cast("int"))
    assert {r.psf_id for r in psf.used(settings, tiles).collect()} == {0, 7}
    every = psf.gaussian(settings)
    assert {r.psf_id for r in packed_psf(every, tiles).collect()} == {0, 7}
    out = richardson_lucy(tiles, every, 2)
    assert not any("BroadcastExchange" in line and "binary" in line for line in _plan(out).splitlines())
    assert sorted(out.collect()) == sorted(richardson_lucy(tiles, psf.gaussian(psf.used(settings, tiles)), 2).collect())


def test_recentring_holds_where_counts_outgrow_the_middle_plane(spark, tmp_path):
    spark.range(60).selectExpr("0L l_suppkey", "1 l_linenumber", "5L l_partkey", "3.0D l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = relational.QUERIES["D5_recenter"](spark, str(tmp_path))
    found = {(r.z, r.n, r.s) for r in out.where("psf_id = 0").groupBy("z").agg(F.count("value").alias("n"), F.sum("value").alias("s")).collect()}
    assert found == {(0, 1024, 0.0), (1, 1024, 10240.0), (2, 1024, 0.0)}
    with pytest.raises(Exception, match="too near"):
        psf.recenter(relational._psf_stack(spark, str(tmp_path)), 3).collect()


def _copies(spark, n=240):
    rng = np.random.default_rng(3)
    kinds = [tuple(int(v) for v in (y, x, y + h, x + w)) for y, x, h, w in rng.integers([0, 0, 0, 1], [30, 30, 25, 25], (30, 4))]
    rows = [(int(i % 2), i, *kinds[rng.integers(len(kinds))], float(rng.integers(9)) / 8) for i in range(n)]
    return rows, spark.createDataFrame(rows, "image_id long, box_id int, min_y int, min_x int, max_y int, max_x int, score double").repartition(3)


def _iou(p, q):
    h, w = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
    size = lambda b: (b[4] - b[2]) * (b[5] - b[3])
    return h * w / (size(p) + size(q) - h * w) if h > 0 and w > 0 else 0.0


def test_pairs_of_copies_are_whole_and_compared_once(spark):
    rows, table = _copies(spark)
    want = sorted((p[0], p[1], q[1], round(_iou(p, q), 9)) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and _iou(p, q) > 0.3)
    assert sorted((r.image_id, r.a, r.b, round(r.iou, 9)) for r in boxes.iou_pairs(table, 0.3).collect()) == want
    firsts, members = boxes.equals(table, ["image_id"])
    assert firsts.count() == len({(r[0], *r[2:6]) for r in rows}) and members.count() == len(rows)


def test_pairs_are_made_behind_the_last_shuffle(spark, monkeypatch):
    """Lists of members move, and never a row for a member and each set that it overlaps; sets of many lists meet in parts, each pair once."""
    rows, table = _copies(spark)
    want = sorted((p[0], p[1], q[1], round(_iou(p, q), 9)) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and _iou(p, q) > 0.3)
    for listed, together in ((1024, 8192), (2, 3)):
        monkeypatch.setattr(boxes, "LISTED", listed, raising=False)
        monkeypatch.setattr(boxes, "TOGETHER", together, raising=False)
        found = boxes.iou_pairs(table, 0.3)
        plan = _plan(found)
        assert "explode(ids_b" in plan and plan.index("explode(ids_b") < plan.index("explode(ids_a") < plan.index("Exchange")
        assert sorted((r.image_id, r.a, r.b, round(r.iou, 9)) for r in found.collect()) == want


@pytest.mark.parametrize("iou", [0.5, 0.0, 1.0])
def test_suppression_of_copies_is_the_greedy_one(spark, iou):
    rows, table = _copies(spark)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if r[6] >= 0.2 and all(k[0] != r[0] or _iou(k, r) <= iou for k in kept):
            kept.append(r)
    assert sorted(tuple(r) for r in boxes.nms(table, 0.2, iou, None).collect()) == sorted(kept)


def test_copies_of_boxes_get_the_same_mask(spark):
    rows, table = _copies(spark)
    pixels = spark.range(2 * 32 * 32).selectExpr("id div 1024 image_id", "cast(id % 1024 div 32 as int) y", "cast(id % 32 as int) x", "cast(id * 37 % 11 as double) value")
    found = {}
    for r in models.classical_masks(pixels, table).collect():
        found.setdefault((r.image_id, r.mask_id), set()).add((r.y, r.x))
    sides = {(r[0], r[1]): r[2:6] for r in rows}
    for k, spots in found.items():
        assert all(found.get(other) == spots for other, s in sides.items() if other[0] == k[0] and s == sides[k])
    alone = models.classical_masks(pixels, table.where("box_id = 17")).collect()
    assert {(r.y, r.x) for r in alone} == found.get((17 % 2, 17), set())


def test_order_by_area_leaves_ranks_out_of_the_driver(spark):
    rows = spark.range(60).selectExpr("id % 2 image_id", "cast(id div 2 as int) mask_id", "posexplode(sequence(0, cast(id * 7 % 5 as int))) as (x, v)").selectExpr("image_id", "mask_id", "0 y", "x")
    out = masks.order_by_area(rows)
    assert re.search(r"SortMergeJoin \[image_id#\w+, mask_id", _plan(out))
    size = {}
    for r in rows.collect():
        size[r.image_id, r.mask_id] = size.get((r.image_id, r.mask_id), 0) + 1
    want = {(i, k): n for i in (0, 1) for k, n in enumerate(n for _, n in sorted(((m, n) for (j, m), n in size.items() if j == i), key=lambda p: (-p[1], p[0])))}
    assert {(r.image_id, r.mask_id): r["n"] for r in out.groupBy("image_id", "mask_id").agg(F.count("x").alias("n")).collect()} == want


def test_runs_are_sorted_in_parts_that_spark_does_not_merge(spark):
    rows = spark.range(500).selectExpr("0L image_id", "cast(id % 50 as int) mask_id", "cast(id div 100 as int) y", "cast(id % 100 div 50 * 2 + id % 3 as int) x").distinct()
    assert "REPARTITION_BY_NUM" in _plan(masks.to_runs(rows))
    assert sorted(masks.from_runs(masks.to_runs(rows)).collect()) == sorted(rows.collect())


def test_a_value_at_the_mean_is_not_above_it(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        v = rng.integers(60, 186, 64)
        v[:8] = 120
        v[8:36] = 240 - v[36:]
        rows += [(i, k // 8, k % 8, float(x)) for k, x in enumerate(v)]
    table = spark.createDataFrame(rows, "image_id long, y int, x int, value double")
    want = sorted(r[:3] for r in rows if r[3] > 120)
    assert sorted((r.image_id, r.y, r.x) for r in models.segment_with(to_tiles(table, 8), workflows._mean_model).collect()) == want


def test_tiles_are_worked_on_by_a_bounded_number_of_pixels(monkeypatch):
    monkeypatch.setattr(tiles_module, "TOGETHER", 100)
    sides = pa.array([5, 5, 5, 20, 3, 3], pa.int32())
    batch = pa.RecordBatch.from_arrays([sides, sides, pa.array(range(6))], ["dy", "dx", "i"])
    parts = [p.column("i").to_pylist() for p in tiles_module._some([batch, batch.slice(0, 0)], ("y", "x"))]
    assert sum(parts, []) == list(range(6)) and parts[0] == [0, 1, 2] and len(parts) > 1
    table, cuts = pa.Table.from_batches([batch]), np.array([0, 2, 3, 4, 6])
    some = list(tiles_module._few([(table, cuts)], lambda t: np.prod(tiles_module._ints(t, ["dy", "dx"]), axis=0)))
    assert sum((t.column("i").to_pylist() for t, _ in some), []) == list(range(6)) and sum(len(c) - 1 for _, c in some) == 4 and len(some) > 1


def test_objects_of_many_images_in_one_batch_stay_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(y), int(x)) for i in range(80) for y, x in np.argwhere(rng.random((9, 11)) < 0.45) + rng.integers(0, 40)]
    table = spark.createDataFrame(rows, "image_id long, y int, x int")
    got = {(r.image_id, r.y, r.x): r.label for r in components.label(table, ["image_id"], tile=8).collect()}
    for i in range(80):
        spots = np.array(sorted(r[1:] for r in rows if r[0] == i))
        want = np.unique(components.sparse_roots(spots), return_inverse=True)[1] + 1
        assert [got[i, int(y), int(x)] for y, x in spots] == want.tolist()
