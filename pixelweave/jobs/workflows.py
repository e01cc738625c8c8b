"""Workflows over image tables, and the queries whose results are beyond SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import kernels
from pixelweave.operators import axes, boxes, filters, intensity, labels, masks, models, psf, threshold, tissue
from pixelweave.operators.components import label
from pixelweave.operators.deconvolve import richardson_lucy, richardson_lucy_tiles
from pixelweave.sources import derived as d
from pixelweave.sources import tiles as t


def otsu_planes(pixels: DataFrame) -> DataFrame:
    """Objects above Otsu's cut of each plane, the segmenter that needs no model."""
    return threshold.threshold(pixels, "otsu", ["image_id", "z"], integer=False)


def connect_2d_in_3d(
    pixels: DataFrame, normalizer: Callable = intensity.normalize_percentile, segmenter: Callable = otsu_planes, connector: Callable = labels.connect,
    normalizer_args: dict | None = None, segmenter_args: dict | None = None, connector_args: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Normalise each volume as a whole, find objects plane by plane, and link them through z. (normalized, labels)

    Each step is a function of a table and its own arguments: pixels to pixels, pixels
    to labels by plane, labels with ids of their own on each plane to labels.
    """
    normalized = normalizer(pixels, **(normalizer_args or {}))
    found = segmenter(normalized, **(segmenter_args or {}))
    return normalized, connector(axes.renumber(found), **(connector_args or {}))


def bright_objects(pixels: DataFrame, min_size: int = 4, conf: float = 0.0, iou: float = 0.9, max_det: int = 300) -> DataFrame:
    """Boxes of bright objects of each plane, the detector that needs no model."""
    return boxes.nms(models.classical_boxes(pixels, min_size), conf, iou, max_det, boxes.slices(pixels))


def detect_then_mask(
    pixels: DataFrame, detector: Callable = bright_objects, masker: Callable = models.classical_masks, detector_args: dict | None = None, masker_args: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """(boxes, masks): a detector's boxes, and in each box a masker's mask; boxes whose mask is empty go. Nothing found gives no rows.

    The masker gets what the detector got and the boxes; one that returns (masks, boxes), as ``models.mask_with`` does, is taken at its word.
    """
    found = detector(pixels, **(detector_args or {}))
    masked = masker(pixels, found, **(masker_args or {}))
    if isinstance(masked, tuple):
        return masked[1], masked[0]
    return masks.drop_empty(found, masked), masked


def deconvolve_with_psf(
    tiles: DataFrame, settings: DataFrame, psf_op: Callable = psf.gaussian, decon_op: Callable = richardson_lucy, psf_args: dict | None = None, decon_args: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """(psf, pixels): a PSF table from its settings, and every plane or volume of ``tiles`` (with psf_id) deconvolved with it."""
    made, needed = (psf_op(s, **(psf_args or {})) for s in (settings, psf.used(settings, tiles)))
    return made, decon_op(tiles, needed, **(decon_args or {}))


def smooth_threshold_label(tiles: DataFrame, radius: int = 2) -> DataFrame:
    """Kuwahara, Otsu, objects."""
    return threshold.threshold(t.from_tiles(filters.kuwahara(tiles, radius)), "otsu", integer=False)


def threshold_planes_then_connect(pixels: DataFrame) -> DataFrame:
    return labels.connect(axes.renumber(threshold.threshold(pixels, "otsu", ["image_id", "z"])))


def _tiles(spark, sf_dir, side: int = 8) -> DataFrame:
    return t.to_tiles(d.px8(spark, sf_dir), side)


def _with_psf(spark, sf_dir) -> DataFrame:
    # every table has at least 200 parts, and so settings
    return _tiles(spark, sf_dir).withColumn("psf_id", (F.col("image_id") % 200).cast("int"))


def _grid_with_psf(spark, sf_dir) -> DataFrame:
    """The planes of the volumes in 4 x 4 tiles each."""
    return t.to_tiles(d.vol(spark, sf_dir), 8).withColumn("psf_id", (F.col("image_id") % 200).cast("int"))


def _settings(spark, sf_dir) -> DataFrame:
    return d.psf_settings(spark, sf_dir)


def _psf_of(tiles: DataFrame, settings: DataFrame) -> DataFrame:
    return psf.gaussian(psf.used(settings, tiles))


def _solid(spark, sf_dir) -> DataFrame:
    """The volumes as tiles of volumes, each with a PSF of three planes or more."""
    return t.to_tiles(_from_zero(d.vol(spark, sf_dir)), volume=True).withColumn("psf_id", (F.col("image_id") % 200).cast("int"))


def _from_zero(volumes: DataFrame) -> DataFrame:
    return volumes.withColumn("z", F.col("z") - 1)


def _solid_settings(spark, sf_dir) -> DataFrame:
    return _settings(spark, sf_dir).withColumn("z_dim", (F.col("psf_id") % 2 * 2 + 3).cast("int")).withColumn("z_sigma", F.lit(1.0))


def _tissue(spark, sf_dir) -> DataFrame:
    return d.rgb(spark, sf_dir)


def _mean_model():
    """A model for the batch hooks: foreground above the mean; a value at the mean, which scaling rounds to either side of it, isn't."""
    return lambda plane: plane - plane.mean() > 1e-9 * np.ptp(plane)


def _one_box_model():
    return lambda plane: np.array([[0, 0, plane.shape[1], plane.shape[0], float(plane.std())]])


def _box_mask_model():
    return lambda plane, found: [plane[int(y0) : int(y1), int(x0) : int(x1)] > plane.mean() for y0, x0, y1, x1 in found]


def _objects(rows: DataFrame, per: list[str]) -> DataFrame:
    return rows.groupBy(*per).agg(F.count(F.lit(1)).alias("pixels"), F.countDistinct("label").alias("objects"))


QUERIES = {
    "A9_apply_planes": lambda s, p: axes.apply_planes(d.vol(s, p), lambda a: (a > 1).astype(int), ["image_id", "z"], "labels"),
    "L1_components": lambda s, p: label(d.vol(s, p).where("value > 1").drop("value"), ["image_id", "z"], tile=16),
    "L1_components_3d": lambda s, p: label(d.vol(s, p).where("value > 2").drop("value"), ["image_id"], tile=16),
    "L3_connect": lambda s, p: labels.connect(d.disc_stack(s, p)),
    "T8_multiotsu_classes": lambda s, p: threshold.multiotsu(d.px8(s, p)),
    "D10_richardson_lucy": lambda s, p: richardson_lucy(_with_psf(s, p), _psf_of(_with_psf(s, p), _settings(s, p)), 10),
    "D10_tiles": lambda s, p: t.from_tiles(richardson_lucy_tiles(_grid_with_psf(s, p), _psf_of(_grid_with_psf(s, p), _settings(s, p)), 3, 8).drop("psf_id")),
    "N1_segment": lambda s, p: models.segment_with(_tiles(s, p), _mean_model),
    "N2_detect": lambda s, p: models.detect_with(_tiles(s, p), _one_box_model),
    "N3_mask": lambda s, p: models.mask_with(_tiles(s, p), models.detect_with(_tiles(s, p), _one_box_model), _box_mask_model)[0],
    "N4_classical_boxes": lambda s, p: models.classical_boxes(d.px8(s, p), 2),
    "N4_classical_boxes_stack": lambda s, p: models.classical_boxes(d.vol(s, p), 3).withColumn("score", F.round("score", 6)),
    "N5_classical_masks_stack": lambda s, p: models.classical_masks(d.vol(s, p), _plane_boxes(s, p)),
    "U2_foreground": lambda s, p: tissue.foreground_probability(tissue.two_channels(_tissue(s, p), 2, 0)),
    "U4_local_masks": lambda s, p: tissue.local_masks(tissue.two_channels(_tissue(s, p), 2, 0), 3),
    "U9_nuclei_of_marks": lambda s, p: tissue.nuclei(tissue.ternary(tissue.posterior(tissue.likelihood(_marks(s, p)))), 3, 3),
    "U9_nuclei": lambda s, p: tissue.nuclei(tissue.tissue_masks(_tissue(s, p), 2, 0, 3), 2),
    "W1_connect_2d_in_3d": lambda s, p: connect_2d_in_3d(d.vol(s, p))[1],
    "W2_detect_then_mask": lambda s, p: detect_then_mask(d.px8(s, p), detector_args={"min_size": 2})[0],
    "W3_deconvolve_with_psf": lambda s, p: deconvolve_with_psf(_with_psf(s, p), _settings(s, p), decon_args={"num_iters": 5, "noncirc": True})[1],
    "D10_richardson_lucy_3d": lambda s, p: richardson_lucy(_solid(s, p), _psf_of(_solid(s, p), _solid_settings(s, p)), 5),
    "N1_segment_stack": lambda s, p: models.segment_with(t.to_tiles(d.vol(s, p)), _mean_model, False),
    "W4_smooth_threshold_label": lambda s, p: _objects(smooth_threshold_label(_tiles(s, p)), ["image_id"]),
    "W5_threshold_connect": lambda s, p: _objects(threshold_planes_then_connect(d.vol(s, p)), ["image_id", "z"]),
    "N5_classical_masks": lambda s, p: models.classical_masks(_by_plane(d.vol(s, p)), _part_boxes(s, p)),
    "U1_channels": lambda s, p: tissue.two_channels(_tissue(s, p), 2, 0).withColumn("value", F.round("value", 6)),
    "U3_mean_suppression": lambda s, p: tissue.global_masks(tissue.two_channels(_tissue(s, p), 2, 0), (2,), 0.9),
    "U6_likelihood": lambda s, p: tissue.likelihood(_marks(s, p)).select("image_id", "y", "x", F.round("likelihood", 6).alias("likelihood")),
    "U5_background": lambda s, p: tissue.remove_background(_marks(s, p), 0.3).select("image_id", "y", "x", "local0", "global0", "local1", "global1"),
    "U7_posterior": lambda s, p: tissue.posterior(tissue.likelihood(_marks(s, p))).select("image_id", "y", "x", F.round("post0", 6).alias("post0"), F.round("post1", 6).alias("post1")),
    "U8_ternary": lambda s, p: tissue.ternary(tissue.posterior(tissue.likelihood(_marks(s, p)))).select("image_id", "y", "x", "kind"),
}


def _by_plane(volumes: DataFrame) -> DataFrame:
    """Each plane of the volumes as an image of its own."""
    return volumes.withColumn("image_id", F.col("image_id") * 7 + F.col("z") - 1).drop("z")


def _part_boxes(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    rows = d.table(spark, sf_dir, "part")
    return rows.select((p % 70).cast("long").alias("image_id"), F.expr("p_partkey div 70").cast("int").alias("box_id"), (p * 7 % 20).cast("int").alias("min_y"), (p * 5 % 20).cast("int").alias("min_x"),
                       (p * 7 % 20 + 10).cast("int").alias("max_y"), (p * 5 % 20 + 12).cast("int").alias("max_x"))


def _plane_boxes(spark, sf_dir) -> DataFrame:
    return _part_boxes(spark, sf_dir).select((F.expr("image_id div 7")).alias("image_id"), (F.col("image_id") % 7 + 1).cast("int").alias("z"), "box_id", "min_y", "min_x", "max_y", "max_x")


def _marks(spark, sf_dir) -> DataFrame:
    """A wide table of two channels with simple masks and probabilities, as input of the later tissue stages."""
    wide = tissue.widened(tissue.two_channels(_tissue(spark, sf_dir), 2, 0))
    return (
        wide.withColumn("p0", F.col("v0") * F.col("v0")).withColumn("p1", F.col("v1") * F.col("v1"))
        .withColumn("local0", F.col("v0") > 0.5).withColumn("local1", F.col("v1") > 0.5).withColumn("global0", F.col("v0") > 0.25).withColumn("global1", F.col("v1") > 0.25)
    )


_UNIT = """, ch AS (SELECT image_id, CASE WHEN c = 2 THEN 0 ELSE 1 END AS c, y, x, value FROM rgb WHERE c IN (0, 2)),
e AS (SELECT image_id, c, min(value) AS lo, max(value) AS hi FROM ch GROUP BY ALL),
u AS (SELECT image_id, c, y, x, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END AS value FROM ch JOIN e USING (image_id, c)),
wd AS (SELECT image_id, y, x, max(value) FILTER (c = 0) AS v0, max(value) FILTER (c = 1) AS v1 FROM u GROUP BY ALL),
mk AS (SELECT *, v0 * v0 AS p0, v1 * v1 AS p1, v0 > 0.5 AS local0, v1 > 0.5 AS local1, v0 > 0.25 AS global0, v1 > 0.25 AS global1 FROM wd),
im AS (SELECT image_id, min(v0) FILTER (local0) AS m0, min(v1) FILTER (local1) AS m1 FROM mk GROUP BY ALL),
rl AS (SELECT mk.*, CASE WHEN v0 > m0 OR v1 > m1 THEN -(v0 - v1) / (v0 + v1) ELSE 0 END AS l FROM mk JOIN im USING (image_id)),
lk AS (SELECT *, CASE WHEN (l < 0 AND NOT global0) OR (l > 0 AND NOT global1) THEN 0 ELSE l END AS likelihood FROM rl),
po AS (SELECT *, CASE WHEN likelihood < 0 THEN q0 + abs(likelihood) - q0 * abs(likelihood) ELSE 0 END AS post0, CASE WHEN likelihood > 0 THEN q1 + abs(likelihood) - q1 * abs(likelihood) ELSE 0 END AS post1
  FROM (SELECT *, CASE WHEN local0 THEN 1 ELSE p0 END AS q0, CASE WHEN local1 THEN 1 ELSE p1 END AS q1 FROM lk))
"""
_BX = """, bx AS (SELECT p_partkey % 70 AS image_id, (p_partkey // 70)::INT AS box_id, p_partkey * 7 % 20 AS y0, p_partkey * 5 % 20 AS x0, p_partkey * 7 % 20 + 10 AS y1, p_partkey * 5 % 20 + 12 AS x1 FROM part),
px AS (SELECT b.image_id, b.box_id, v.y, v.x, v.value FROM bx b JOIN vol v ON v.image_id * 7 + z - 1 = b.image_id AND y >= y0 AND y < y1 AND x >= x0 AND x < x1),
h AS (SELECT image_id, box_id, value AS b, count(*) AS n FROM px GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS n0, sum(n * b) OVER w AS s0, sum(n) OVER v - sum(n) OVER w AS n1, sum(n * b) OVER v - sum(n * b) OVER w AS s1
  FROM h WINDOW w AS (PARTITION BY image_id, box_id ORDER BY b ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY image_id, box_id)),
sc AS (SELECT *, CASE WHEN n1 > 0 THEN pow((s0 + s1) * n0 - (n0 + n1) * s0, 2) / (n0 * n1)::DOUBLE END AS s FROM r),
cut AS (SELECT image_id, box_id, coalesce(arg_min(b, (-s, b)) FILTER (s IS NOT NULL), max(b)) AS cut FROM sc GROUP BY ALL)
"""
_MEAN5 = ", ".join(str((y, x)) for y in range(-2, 3) for x in range(-2, 3))
SQL = {
    "U1_channels": d.with_sql("rgb", _UNIT + "SELECT image_id, c, y, x, round(value, 6) AS value FROM u"),
    "U3_mean_suppression": d.with_sql("rgb", _UNIT + f""", mn AS (SELECT p.image_id, p.c, p.y, p.x, avg(q.value) AS m, any_value(p.value) AS value FROM u p CROSS JOIN (VALUES {_MEAN5}) t(dy, dx)
  JOIN u q ON q.image_id = p.image_id AND q.c = p.c AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.image_id, p.c, p.y, p.x)
SELECT image_id, c, y, x, (value <> 0 AND value >= 0.9::DOUBLE * m - 1e-12) AS value FROM mn"""),
    "U5_background": d.with_sql("rgb", _UNIT + "SELECT image_id, y, x, local0 AND global0 AND p0 > 0.3 AS local0, global0 AND p0 > 0.3 AS global0, local1 AND global1 AND p1 > 0.3 AS local1, global1 AND p1 > 0.3 AS global1 FROM mk"),
    "U6_likelihood": d.with_sql("rgb", _UNIT + "SELECT image_id, y, x, round(likelihood, 6) AS likelihood FROM lk"),
    "U7_posterior": d.with_sql("rgb", _UNIT + "SELECT image_id, y, x, round(post0, 6) AS post0, round(post1, 6) AS post1 FROM po"),
    "U8_ternary": d.with_sql("rgb", _UNIT + "SELECT image_id, y, x, CASE WHEN post0 + post1 = 0 THEN 0 WHEN post0 >= post1 THEN 1 ELSE 2 END AS kind FROM po"),
    "N5_classical_masks": d.with_sql("vol", _BX + "SELECT image_id, box_id AS mask_id, y, x FROM px JOIN cut USING (image_id, box_id) WHERE value > cut"),
    "N5_classical_masks_stack": d.with_sql("vol", _BX + "SELECT image_id // 7 AS image_id, (image_id % 7 + 1)::INT AS z, box_id AS mask_id, y, x FROM px JOIN cut USING (image_id, box_id) WHERE value > cut"),
}


def _components_sql(source: str, keys: str, axes_: str, order: str) -> str:
    """Labels 1..n in raster order of set pixels ``source`` (keys, axes), touching also at corners, by least numbers walked along neighbours."""
    near = " AND ".join(f"q.{c} BETWEEN p.{c} - 1 AND p.{c} + 1" for c in axes_.split(", "))
    return f""", cn AS (SELECT *, row_number() OVER (ORDER BY {keys}, {order}) AS i FROM {source}),
ce AS (SELECT p.i AS a, q.i AS b FROM cn p JOIN cn q USING ({keys}) WHERE {near}),
walk AS (SELECT a, b FROM ce UNION SELECT w.a, ce.b FROM walk w JOIN ce ON ce.a = w.b),
root AS (SELECT a AS i, min(b) AS r FROM walk GROUP BY a),
SELECTED AS (SELECT cn.*, dense_rank() OVER (PARTITION BY {keys} ORDER BY r) AS label FROM cn JOIN root USING (i))"""


def _recursive(query: str) -> str:
    return "WITH RECURSIVE" + query.removeprefix("WITH").replace("SELECTED AS", "labelled AS")


_ABOVE_MEAN = """, m AS (SELECT image_id, avg(value) AS cut FROM px8 GROUP BY ALL), s AS (SELECT image_id, y, x FROM px8 JOIN m USING (image_id) WHERE value > cut)"""
SQL |= {
    "N1_segment": _recursive(d.with_sql("px8", _ABOVE_MEAN + _components_sql("s", "image_id", "y, x", "y, x") + " SELECT image_id, y, x, label FROM labelled")),
    "N2_detect": d.with_sql("px8", """SELECT image_id, 0 AS box_id, 0::FLOAT AS min_y, 0::FLOAT AS min_x, 8::FLOAT AS max_y, 8::FLOAT AS max_x, stddev_pop(value) AS score FROM px8 GROUP BY image_id HAVING stddev_pop(value) >= 0.4"""),
    "N3_mask": d.with_sql("px8", _ABOVE_MEAN + " SELECT image_id, 0 AS mask_id, y, x FROM s"),
}
_CLAMP8, _MIRROR8 = "greatest(0, least(7, {v}))", "CASE WHEN {v} < 0 THEN -1 - {v} WHEN {v} > 7 THEN 15 - {v} ELSE {v} END"


def _near(name: str, source: str, value: str, taps, place: str | None) -> str:
    """Sums over offsets of a plane of a channel; without ``place`` what lies outside counts nothing."""
    rows = ", ".join(f"({dy}, {dx}, {float(w)!r}::DOUBLE)" for dy, dx, w in taps)
    at = lambda c: place.format(v=f"(p.{c} + d{c})") if place else f"p.{c} + d{c}"
    return f""", {name} AS (SELECT p.image_id, p.c, p.y, p.x, {value} AS value FROM {source} p CROSS JOIN (VALUES {rows}) t(dy, dx, w)
  JOIN {source} q ON q.image_id = p.image_id AND q.c = p.c AND q.y = {at("y")} AND q.x = {at("x")} GROUP BY p.image_id, p.c, p.y, p.x)"""


def _scaled_sql(name: str, source: str) -> str:
    return f""", {name}_e AS (SELECT image_id, c, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY ALL),
{name} AS (SELECT image_id, c, y, x, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END AS value FROM {source} JOIN {name}_e USING (image_id, c))"""


_G3 = kernels.gaussian_taps(3.0)
_SOFT_Y, _SOFT_X = [(i - 12, 0, a) for i, a in enumerate(_G3)], [(0, i - 12, a) for i, a in enumerate(_G3)]
_S = [1, 2, 1]
_GY, _GX = [(i - 1, j - 1, (i - 1) / 2 * _S[j] / 4) for i in (0, 2) for j in range(3)], [(i - 1, j - 1, (j - 1) / 2 * _S[i] / 4) for i in range(3) for j in (0, 2)]
_NINE = [(dy, dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
SQL |= {
    "U2_foreground": d.with_sql("rgb", _UNIT + _near("s1", "u", "sum(w * q.value)", _SOFT_Y, _CLAMP8) + _near("sm", "s1", "sum(w * q.value)", _SOFT_X, _CLAMP8) + _scaled_sql("so", "sm") + """,
be AS (SELECT image_id, c, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 256 AS wd FROM so GROUP BY ALL),
bn AS (SELECT image_id, c, CASE WHEN wd > 0 THEN lo + (least(255, floor((value - lo) / nullif(wd, 0))) + 0.5::DOUBLE) * wd ELSE lo END AS b FROM so JOIN be USING (image_id, c)),
hs AS (SELECT image_id, c, b, count(*) AS n FROM bn GROUP BY ALL),
rn AS (SELECT *, sum(n) OVER w AS n0, sum(n * b) OVER w AS s0, sum(n) OVER v - sum(n) OVER w AS n1, sum(n * b) OVER v - sum(n * b) OVER w AS s1
  FROM hs WINDOW w AS (PARTITION BY image_id, c ORDER BY b ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY image_id, c)),
mo AS (SELECT i.image_id, i.c, i.b AS cut, row_number() OVER (PARTITION BY i.image_id, i.c ORDER BY i.s0 * i.s0 / i.n0 + (j.s0 - i.s0) * (j.s0 - i.s0) / (j.n0 - i.n0) + j.s1 * j.s1 / j.n1 DESC, i.b, j.b) AS k
  FROM rn i JOIN rn j ON i.image_id = j.image_id AND i.c = j.c AND i.b < j.b AND j.n1 > 0),
fg AS (SELECT u.image_id, u.c, floor(u.value * 255) AS level FROM u JOIN so USING (image_id, c, y, x) JOIN mo ON mo.image_id = u.image_id AND mo.c = u.c AND k = 1 WHERE so.value > cut)
SELECT p.image_id, p.c, p.y, p.x, coalesce((SELECT count(*) FILTER (f.level <= floor(p.value * 255)) / count(*) FROM fg f WHERE f.image_id = p.image_id AND f.c = p.c), 0)::DOUBLE AS value FROM u p"""),
    "U4_local_masks": d.with_sql("rgb", _UNIT + _near("gy", "u", "sum(w * q.value)", _GY, _MIRROR8) + _near("gx", "u", "sum(w * q.value)", _GX, _MIRROR8) + """,
ww AS (SELECT image_id, c, y, x, exp(-((gy.value * gy.value + gx.value * gx.value) / 2) / 2) AS value FROM gy JOIN gx USING (image_id, c, y, x)),
wv AS (SELECT image_id, c, y, x, ww.value * u.value AS value FROM ww JOIN u USING (image_id, c, y, x))""" + _near("aw", "ww", "sum(q.value)", _NINE, None) + _near("av", "wv", "sum(q.value)", _NINE, None) + """,
sp AS (SELECT image_id, c, y, x, av.value / aw.value AS value FROM av JOIN aw USING (image_id, c, y, x))""" + _scaled_sql("ss", "sp") + """,
lv AS (SELECT image_id, c, y, x, round_even(value * 255, 0)::INT AS level FROM ss),
dk AS (SELECT p.image_id, p.c, p.y, p.x, p.level AS own, q.level AS b, count(*) AS n FROM lv p CROSS JOIN (SELECT * FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= 9) t
  JOIN lv q ON q.image_id = p.image_id AND q.c = p.c AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL),
rs AS (SELECT *, sum(n) OVER w AS n0, sum(n * b) OVER w AS s0, sum(n) OVER v AS nn, sum(n * b) OVER v AS st
  FROM dk WINDOW w AS (PARTITION BY image_id, c, y, x ORDER BY b ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY image_id, c, y, x)),
sc AS (SELECT *, CASE WHEN n0 < nn THEN pow((st * n0 - nn * s0)::DOUBLE, 2) / (n0 * (nn - n0))::DOUBLE END AS s FROM rs)
SELECT image_id, c, y, x, any_value(own) > coalesce(arg_min(b, (-s, b)) FILTER (s IS NOT NULL), max(b)) AS value FROM sc GROUP BY image_id, c, y, x"""),
}
_OTSU_PLANES = """, h AS (SELECT image_id, z, value AS b, count(*) AS n FROM vol GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS n0, sum(n * b) OVER w AS s0, sum(n) OVER v - sum(n) OVER w AS n1, sum(n * b) OVER v - sum(n * b) OVER w AS s1
  FROM h WINDOW w AS (PARTITION BY image_id, z ORDER BY b ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY image_id, z)),
sc AS (SELECT *, CASE WHEN n1 > 0 THEN pow((s0 + s1) * n0 - (n0 + n1) * s0, 2) / (n0 * n1)::DOUBLE END AS s FROM r),
cut AS (SELECT image_id, z, coalesce(arg_min(b, (-s, b)) FILTER (s IS NOT NULL), max(b)) AS cut FROM sc GROUP BY ALL),
s AS (SELECT image_id, z, y, x, value FROM vol JOIN cut USING (image_id, z) WHERE value > cut)"""
SQL |= {
    "N4_classical_boxes_stack": _recursive(d.with_sql("vol", _OTSU_PLANES + _components_sql("s", "image_id, z", "y, x", "y, x") + """, pk AS (SELECT image_id, z, greatest(max(value), 1e-20) AS peak FROM vol GROUP BY ALL)
SELECT image_id, z, (label - 1)::INT AS box_id, min(y) AS min_y, min(x) AS min_x, max(y) + 1 AS max_y, max(x) + 1 AS max_x, round(avg(value) / max(peak), 6) AS score
FROM labelled JOIN pk USING (image_id, z) GROUP BY image_id, z, label HAVING count(*) >= 3""")),
}
SQL |= {
    "L1_components": _recursive(d.with_sql("vol", ", s AS (SELECT image_id, z, y, x FROM vol WHERE value > 1)" + _components_sql("s", "image_id, z", "y, x", "y, x") + " SELECT image_id, z, y, x, label::INT AS label FROM labelled")),
    "L1_components_3d": _recursive(d.with_sql("vol", ", s AS (SELECT image_id, z, y, x FROM vol WHERE value > 2)" + _components_sql("s", "image_id", "z, y, x", "z, y, x") + " SELECT image_id, z, y, x, label::INT AS label FROM labelled")),
    "U9_nuclei_of_marks": _recursive(d.with_sql("rgb", _UNIT + ", s AS (SELECT image_id, y, x FROM po WHERE post0 + post1 <> 0 AND post0 >= post1)" + _components_sql("s", "image_id", "y, x", "y, x") + """,
bx AS (SELECT image_id, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS area FROM labelled GROUP BY ALL),
fr AS (SELECT b.image_id, b.label, g.y, h.x, g.y = y0 OR g.y = y1 OR h.x = x0 OR h.x = x1 AS side FROM bx b, range(8) g(y), range(8) h(x)
  WHERE g.y BETWEEN y0 AND y1 AND h.x BETWEEN x0 AND x1 AND NOT EXISTS (SELECT 1 FROM labelled l WHERE l.image_id = b.image_id AND l.label = b.label AND l.y = g.y AND l.x = h.x)),
op AS (SELECT image_id, label, y, x FROM fr WHERE side UNION SELECT f.image_id, f.label, f.y, f.x FROM op JOIN fr f ON f.image_id = op.image_id AND f.label = op.label AND abs(f.y - op.y) + abs(f.x - op.x) = 1),
fl AS (SELECT b.image_id, b.label, area, area + (SELECT count(*) FROM fr f WHERE f.image_id = b.image_id AND f.label = b.label) - (SELECT count(*) FROM op WHERE op.image_id = b.image_id AND op.label = b.label) AS filled FROM bx b)
SELECT image_id, label::INT AS label, area, filled, count(*) OVER (PARTITION BY image_id) AS n_nuclei FROM fl WHERE filled >= 3""")),
}
