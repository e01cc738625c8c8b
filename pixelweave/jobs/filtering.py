"""Queries of the filters over tiles, with SQL forms as joins over offsets."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import functions as F

from pixelweave.functions import kernels as k
from pixelweave.functions.staging import shared_folder
from pixelweave.operators import filters
from pixelweave.sources import derived as d
from pixelweave.sources import stacks
from pixelweave.sources import tiles as t

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Parts of the 8 x 8 images; the smaller ones exercise the halo.
PART, WHOLE = 5, 8


def _query(fn, side: int):
    def run(spark, sf_dir):
        out = t.from_tiles(fn(t.to_tiles(d.px8(spark, sf_dir), side)))
        return out.withColumn("value", F.round("value", 6) + 0.0)

    return run


def _add(name: str, fn, sql: str | None = None, side: int = PART) -> None:
    QUERIES[name] = _query(fn, side)
    if sql:
        SQL[name] = d.with_sql("px8", sql)


_EDGE = {
    "edge": "greatest(0, least(7, {v}))",
    "symmetric": "CASE WHEN {v} < 0 THEN -1 - {v} WHEN {v} > 7 THEN 15 - {v} ELSE {v} END",
}


def _taps(*axes: np.ndarray) -> list[tuple[int, int, float]]:
    ty, tx = axes
    return [(i - len(ty) // 2, j - len(tx) // 2, float(a * b)) for i, a in enumerate(ty) for j, b in enumerate(tx) if a * b]


def _conv(name: str, taps: list[tuple[int, int, float]], mode: str, source: str = "px8") -> str:
    rows = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for dy, dx, w in taps)
    at = lambda c: _EDGE[mode].format(v=f"(p.{c} + d{c})")
    return f""", {name} AS (SELECT p.image_id, p.y, p.x, sum(w * q.value) AS value FROM {source} p CROSS JOIN (VALUES {rows}) t(dy, dx, w)
  JOIN {source} q ON q.image_id = p.image_id AND q.y = {at("y")} AND q.x = {at("x")} GROUP BY p.image_id, p.y, p.x)"""


_ONE = np.array([1.0])
_OUT = " SELECT image_id, y, x, round({v}, 6) + 0.0::DOUBLE AS value FROM {t}"

_add("F1_gaussian", filters.gaussian, _conv("g", _taps(k.gaussian_taps(1), k.gaussian_taps(1)), "edge") + _OUT.format(v="value", t="g"))
_ball = ", ".join(str(o) for o in k.offsets(1, 2))
_add("F2_median", filters.median, f""", m AS (SELECT p.image_id, p.y, p.x, median(q.value) AS value FROM px8 p CROSS JOIN (VALUES {_ball}) t(dy, dx)
  JOIN px8 q ON q.image_id = p.image_id AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)) GROUP BY ALL)""" + _OUT.format(v="value", t="m"))
_third = np.full(3, 1 / 3)
_add("F3_mean", filters.mean, _conv("g", _taps(_third, _third), "symmetric") + _OUT.format(v="value", t="g"))
_add("F4_kuwahara", filters.kuwahara)
_add("F5_bilateral", filters.bilateral)
_add("F6_total_variation", filters.total_variation, side=WHOLE)
_add("F7_wavelet", filters.wavelet, side=WHOLE)
_add("F8_non_local_means", lambda x: filters.non_local_means(x, 3, 3), side=PART)
_add("F9_butterworth", lambda x: filters.butterworth(x, 0.2), side=WHOLE)

_slope = np.array([-0.5, 0, 0.5])
for _i, _kind in enumerate(("sobel", "scharr", "prewitt", "farid"), 1):
    _s, _d = (np.array(k.FARID[0]), -np.array(k.FARID[1])) if _kind == "farid" else (np.array(k.SMOOTH[_kind]), _slope)
    _sql = _conv("gy", _taps(_d, _s), "symmetric") + _conv("gx", _taps(_s, _d), "symmetric")
    _add(f"E{_i}_{_kind}", lambda x, kind=_kind: filters.edges(x, kind), _sql + " SELECT image_id, y, x, round(sqrt((gy.value * gy.value + gx.value * gx.value) / 2), 6) + 0.0::DOUBLE AS value FROM gy JOIN gx USING (image_id, y, x)")
_sql = _conv("a", [(0, 0, 1.0), (-1, -1, -1.0)], "symmetric") + _conv("b", [(-1, 0, 1.0), (0, -1, -1.0)], "symmetric")
_add("E5_roberts", lambda x: filters.edges(x, "roberts"), _sql + " SELECT image_id, y, x, round(sqrt((a.value * a.value + b.value * b.value) / 2), 6) + 0.0::DOUBLE AS value FROM a JOIN b USING (image_id, y, x)")
_add("E6_laplace", filters.laplace, _conv("g", [(0, 0, 4.0), (1, 0, -1.0), (-1, 0, -1.0), (0, 1, -1.0), (0, -1, -1.0)], "symmetric") + _OUT.format(v="value", t="g"))
_low, _high = k.gaussian_taps(0.5), k.gaussian_taps(1)
_sql = _conv("a", _taps(_low, _low), "edge") + _conv("b", _taps(_high, _high), "edge")
_add("E7_difference_of_gaussians", lambda x: filters.difference_of_gaussians(x, 0.5, 1.0), _sql + " SELECT image_id, y, x, round(a.value - b.value, 6) + 0.0::DOUBLE AS value FROM a JOIN b USING (image_id, y, x)")
_add("E8_unsharp", filters.unsharp, _conv("g", _taps(_high, _high), "edge") + " SELECT image_id, y, x, round(p.value + (p.value - g.value), 6) + 0.0::DOUBLE AS value FROM px8 p JOIN g USING (image_id, y, x)")
for _i, _kind in ((9, "frangi"), (10, "sato"), (11, "meijering")):
    _add(f"E{_i}_{_kind}", lambda x, kind=_kind: filters.ridges(x, kind, 1, 2, 1), side=WHOLE)


def _rank(name: str, largest: bool, source: str, radius: int, shape: str) -> str:
    rows = ", ".join(str(o) for o in k.offsets(radius, 2, shape))
    return f""", {name} AS (SELECT p.image_id, p.y, p.x, {"max" if largest else "min"}(q.value) AS value FROM {source} p CROSS JOIN (VALUES {rows}) t(dy, dx)
  JOIN {source} q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)"""


_FROM = " SELECT image_id, y, x, {v} + 0.0::DOUBLE AS value FROM {t}"
for _i, (_kind, _shape) in enumerate((("erosion", "ball"), ("dilation", "diamond"), ("opening", "ball"), ("closing", "box"), ("white_tophat", "ball"), ("black_tophat", "diamond")), 1):
    _first = _kind in ("dilation", "closing", "black_tophat")
    _sql = _rank("a", _first, "px8", 2, _shape)
    if _i > 2:
        _sql += _rank("b", not _first, "a", 2, _shape)
    _join = " SELECT image_id, y, x, {v} + 0.0::DOUBLE AS value FROM px8 p JOIN b USING (image_id, y, x)"
    _sql += {5: _join.format(v="(p.value - b.value)"), 6: _join.format(v="(b.value - p.value)")}.get(_i, _FROM.format(v="value", t="a" if _i < 3 else "b"))
    _add(f"P{_i}_{_kind}", lambda x, kind=_kind, shape=_shape: filters.morphology(x, kind, 2, shape), _sql)

# ---- the same on volumes of 7 x 32 x 32, in parts that exercise the halo along y and x

PART_3D = 20


def _volumes(spark, sf_dir):
    return d.vol(spark, sf_dir).withColumn("z", F.col("z") - 1)


def _add_3d(name: str, fn, sql: str) -> None:
    def run(spark, sf_dir):
        out = t.from_tiles(fn(t.to_tiles(_volumes(spark, sf_dir), PART_3D, volume=True)))
        return out.withColumn("value", F.round("value", 6) + 0.0)

    QUERIES[name] = run
    SQL[name] = d.with_sql("vol", ", v AS MATERIALIZED (SELECT image_id, z - 1 AS z, y, x, value FROM vol)" + sql)


def _taps_3d(*lines: np.ndarray) -> list[tuple]:
    return [(*(i - len(t_) // 2 for i, t_ in zip(at, lines, strict=True)), float(np.prod([t_[i] for i, t_ in zip(at, lines, strict=True)]))) for at in itertools.product(*(range(len(t_)) for t_ in lines))]


def _join_3d(name: str, how: str, taps: list[tuple], place: dict[str, str] | None, source: str = "v") -> str:
    rows = ", ".join(f"({dz}, {dy}, {dx}, {w!r}::DOUBLE)" for dz, dy, dx, w in taps if w)
    there = ", ".join((place[c].format(v=f"(p.{c} + d{c})") if place else f"p.{c} + d{c}") + f" AS n{c}" for c in "zyx")
    return f""", {name}_at AS MATERIALIZED (SELECT p.image_id, p.z, p.y, p.x, w, {there} FROM {source} p CROSS JOIN (VALUES {rows}) t(dz, dy, dx, w)),
{name} AS (SELECT p.image_id, p.z, p.y, p.x, {how} AS value FROM {name}_at p
  JOIN {source} q ON q.image_id = p.image_id AND q.z = p.nz AND q.y = p.ny AND q.x = p.nx GROUP BY p.image_id, p.z, p.y, p.x)"""


_TOP = {"z": 6, "y": 31, "x": 31}
_CLAMP = {c: f"greatest(0, least({m}, {{v}}))" for c, m in _TOP.items()}
_MIRROR = {c: f"CASE WHEN {{v}} < 0 THEN -1 - {{v}} WHEN {{v}} > {m} THEN {2 * m + 1} - {{v}} ELSE {{v}} END" for c, m in _TOP.items()}
_SUM, _OUT_3D = "sum(p.w * q.value)", " SELECT image_id, z, y, x, round({v}, 6) + 0.0::DOUBLE AS value FROM {t}"
_soft = k.gaussian_taps(0.5)
_near = [(*o, 1.0) for o in k.offsets(1, 3)]
_add_3d("F1_gaussian_3d", lambda x: filters.gaussian(x, 0.5), _join_3d("g", _SUM, _taps_3d(_soft, _soft, _soft), _CLAMP) + _OUT_3D.format(v="value", t="g"))
_add_3d("F2_median_3d", filters.median, _join_3d("g", "median(q.value)", _near, _CLAMP) + _OUT_3D.format(v="value", t="g"))
_add_3d("F3_mean_3d", filters.mean, _join_3d("g", _SUM, _taps_3d(_third, _third, _third), _MIRROR) + _OUT_3D.format(v="value", t="g"))
for _i, _kind in enumerate(("sobel", "scharr", "prewitt"), 1):
    _s = np.array(k.SMOOTH[_kind])
    _sql = "".join(_join_3d(f"g{c}", _SUM, _taps_3d(*(_slope if c == a else _s for a in "zyx")), _MIRROR) for c in "zyx")
    _root = "sqrt((gz.value * gz.value + gy.value * gy.value + gx.value * gx.value) / 3)"
    _add_3d(f"E{_i}_{_kind}_3d", lambda x, kind=_kind: filters.edges(x, kind), _sql + f" SELECT image_id, z, y, x, round({_root}, 6) + 0.0::DOUBLE AS value FROM gz JOIN gy USING (image_id, z, y, x) JOIN gx USING (image_id, z, y, x)")
_star = [(0, 0, 0, 6.0), *((*o, -1.0) for o in k.offsets(1, 3) if any(o))]
_add_3d("E6_laplace_3d", filters.laplace, _join_3d("g", _SUM, _star, _MIRROR) + _OUT_3D.format(v="value", t="g"))
_fine = k.gaussian_taps(0.3)
_sql = _join_3d("a", _SUM, _taps_3d(_fine, _fine, _fine), _CLAMP) + _join_3d("b", _SUM, _taps_3d(_soft, _soft, _soft), _CLAMP)
_add_3d("E7_difference_of_gaussians_3d", lambda x: filters.difference_of_gaussians(x, 0.3, 0.5), _sql + " SELECT image_id, z, y, x, round(a.value - b.value, 6) + 0.0::DOUBLE AS value FROM a JOIN b USING (image_id, z, y, x)")
_add_3d("E8_unsharp_3d", lambda x: filters.unsharp(x, 0.5), _join_3d("g", _SUM, _taps_3d(_soft, _soft, _soft), _CLAMP) + " SELECT image_id, z, y, x, round(2 * v.value - g.value, 6) + 0.0::DOUBLE AS value FROM v JOIN g USING (image_id, z, y, x)")
for _i, (_kind, _shape) in enumerate((("erosion", "ball"), ("dilation", "box"), ("opening", "ball"), ("closing", "diamond"), ("white_tophat", "box"), ("black_tophat", "ball")), 1):
    _hows = ("max(q.value)", "min(q.value)") if _kind in ("dilation", "closing", "black_tophat") else ("min(q.value)", "max(q.value)")
    _at = [(*o, 1.0) for o in k.offsets(1, 3, _shape)]
    _sql = _join_3d("a", _hows[0], _at, None) + (_join_3d("b", _hows[1], _at, None, "a") if _i > 2 else "")
    _last = {5: "v.value - b.value", 6: "b.value - v.value"}.get(_i, "a.value" if _i < 3 else "b.value")
    _sql += f" SELECT image_id, z, y, x, {_last} + 0.0::DOUBLE AS value FROM v JOIN {'a' if _i < 3 else 'b'} USING (image_id, z, y, x)"
    _add_3d(f"P{_i}_{_kind}_3d", lambda x, kind=_kind, shape=_shape: filters.morphology(x, kind, 1, shape), _sql)


def _ridges_3d(kind: str):
    return lambda s, p: t.from_tiles(filters.ridges(t.to_tiles(_volumes(s, p), volume=True), kind, 1, 2, 1))


QUERIES |= {f"E{i}_{kind}_3d": _ridges_3d(kind) for i, kind in ((9, "frangi"), (10, "sato"), (11, "meijering"))}

QUERIES["S2_table"] = lambda s, p: t.round_trip(d.px8(s, p), "px8")
SQL["S2_table"] = d.with_sql("px8", "SELECT * FROM px8")
QUERIES["S4_tiles"] = lambda s, p: t.from_tiles(t.to_tiles(d.vol(s, p), 20))
SQL["S4_tiles"] = d.with_sql("vol", "SELECT * FROM vol")


def _stacks(spark, sf_dir):
    """The volumes written as 16-bit stacks, one a file, and read back by bands."""
    folder = f"{shared_folder(spark)}/stacks-{uuid.uuid4().hex}"
    stacks.write_stacks(t.to_tiles(_volumes(spark, sf_dir)), folder, "u2", rows=10).count()
    back = t.from_tiles(stacks.read_stacks(spark, folder, 16).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long")).drop("path", "t", "c"))
    return back.withColumn("z", F.col("z") + 1)


QUERIES["S1_stacks"] = _stacks
SQL["S1_stacks"] = d.with_sql("vol", "SELECT * FROM vol")
