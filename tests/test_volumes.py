"""Volumes: tiles with three axes, filters on them, deconvolution and labels of large volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import kernels as k
from pixelweave.operators import deconvolve, filters, psf
from pixelweave.operators.components import label
from pixelweave.sources import tiles as t

RNG = np.random.default_rng(4)
SOLID = RNG.normal(100, 20, (7, 19, 23))


def pixels(spark, a, **more):
    spots = np.indices(a.shape).reshape(a.ndim, -1)
    names = ["z", "y", "x"][-a.ndim :]
    rows = [(1, *map(int, s), float(v)) for *s, v in zip(*spots, a.reshape(-1), strict=True)]
    return spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{c} int" for c in names) + ", value double")


def array(frame, shape):
    out = np.full(shape, np.nan)
    names = ["z", "y", "x"][-len(shape) :]
    rows = frame.toPandas()
    out[tuple(rows[c].to_numpy() for c in names)] = rows["value"].to_numpy()
    return out


@pytest.mark.parametrize(
    "run, kernel",
    [
        (lambda x: filters.gaussian(x, 0.7), lambda a: k.gaussian(a, 0.7)),
        (lambda x: filters.kuwahara(x, 2), lambda a: k.kuwahara(a, 2)),
        (lambda x: filters.morphology(x, "opening", 2, "ball"), lambda a: k.morphology(a, "opening", 2, "ball")),
        (lambda x: filters.edges(x, "scharr"), lambda a: k.gradient(a, "scharr")),
        (lambda x: filters.ridges(x, "sato", 1, 2, 1), lambda a: k.ridges(a, "sato", k.scales(1, 2, 1), ([], []))),
    ],
)
def test_parts_of_a_volume_give_what_the_whole_gives(spark, run, kernel):
    px = pixels(spark, SOLID)
    for side in (64, 8):
        assert np.allclose(array(t.from_tiles(run(t.to_tiles(px, side, volume=True))), SOLID.shape), kernel(SOLID)), side


def test_ridges_of_parts_divide_by_the_maximum_of_the_whole(spark):
    plane = SOLID[0]
    for kind in ("frangi", "meijering"):
        whole, parts = (array(t.from_tiles(filters.ridges(t.to_tiles(pixels(spark, plane), side), kind, 1, 2, 1)), plane.shape) for side in (64, 9))
        assert np.allclose(whole, parts) and whole.max() > 0


def test_border_of_non_local_means_does_not_depend_on_the_tile(spark):
    plane = SOLID[0]
    whole, parts = (array(t.from_tiles(filters.non_local_means(t.to_tiles(pixels(spark, plane), side), 3, 4)), plane.shape) for side in (64, 6))
    assert np.allclose(whole, parts)


def test_planes_of_a_stack_stay_apart(spark):
    out = array(t.from_tiles(filters.gaussian(t.to_tiles(pixels(spark, SOLID), 8), 1.0)), SOLID.shape)
    assert np.allclose(out, np.stack([k.gaussian(a, 1.0) for a in SOLID]))
    with pytest.raises(ValueError):
        filters.edges(t.to_tiles(pixels(spark, SOLID), volume=True), "farid")


def test_solid_deconvolution(spark):
    true = np.zeros((9, 16, 16))
    true[4, 8, 8], true[3, 4, 11] = 1000, 600
    settings = spark.createDataFrame([(0, 7, 1.5, 5, 1.0)], "psf_id int, xy_dim int, xy_sigma double, z_dim int, z_sigma double")
    table = psf.gaussian(settings)
    point = array(table.where("psf_id = 0").drop("psf_id"), (5, 7, 7))
    blurred = k.Blur(k.pad_centred(point, true.shape))(true[None])[0]
    rows = t.to_tiles(pixels(spark, blurred), volume=True).withColumn("psf_id", F.lit(0))
    out = array(deconvolve.richardson_lucy(rows, table, 30), true.shape)
    assert np.allclose(out, k.richardson_lucy(blurred, point, 30)) and out.max() > 2 * blurred.max()
    assert ((out - true) ** 2).mean() < ((blurred - true) ** 2).mean()
    with pytest.raises(Exception, match="tiles of volumes"):
        deconvolve.richardson_lucy(t.to_tiles(pixels(spark, blurred)).withColumn("psf_id", F.lit(0)), table).collect()


def test_a_stack_is_deconvolved_like_each_of_its_planes():
    point = k.gaussian(np.pad([[1.0]], 3), 1.2)
    mask = RNG.random(SOLID.shape) > 0.1
    for noncirc in (False, True):
        both = k.richardson_lucy(SOLID, point, 5, noncirc, mask)
        assert np.allclose(both, np.stack([k.richardson_lucy(a, point, 5, noncirc, m) for a, m in zip(SOLID, mask, strict=True)])) and (both[~mask] == SOLID[~mask]).all()


def test_labels_of_a_large_volume(spark):
    far = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 0, 8192), (1, 0, 0, 8193), (1, 100_000, 3, 4)], "image_id long, z int, y int, x int")
    got = {(r.z, r.y, r.x): r.label for r in label(far).collect()}
    assert got[0, 0, 8192] == got[0, 0, 8193] == 1 and got[0, 1, 0] == 2 and got[100_000, 3, 4] == 3
    with pytest.raises(Exception, match="not in"):
        label(spark.createDataFrame([(1, 0, 0, 1 << 22)], "image_id long, z int, y int, x int")).collect()


def test_pictures(spark, tmp_path):
    import base64

    # a 2 x 1 PNG: a red and a blue pixel
    data = "iVBORw0KGgoAAAANSUhEUgAAAAIAAAABCAIAAAB7QOjdAAAAD0lEQVR4nGP4z8DAAMQACAACAWR7jLAAAAAASUVORK5CYII="
    (tmp_path / "a.png").write_bytes(base64.b64decode(data))
    rows = {(r.c, r.y, r.x): r.value for r in t.read_pictures(spark, str(tmp_path)).collect()}
    assert len(rows) in (0, 6) and (not rows or {v for v in rows.values()} <= {0.0, 255.0})
