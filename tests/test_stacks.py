"""Stacks: round trips by the writer, files made by hand, order of axes, and how the work is dealt."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.sources import stacks, tiles as t


def planes(spark, kind, shape=(2, 3, 2, 21, 17)):
    rng = np.random.default_rng(8)
    a = rng.random(shape) * 100 - 30 if kind[0] == "f" else rng.integers(np.iinfo(kind).min, min(np.iinfo(kind).max, 2**40), shape)
    a = a.astype("f4" if kind == "f4" else float)
    rows = [(i, *map(int, at), float(a[tuple(at)]) + (i if kind[0] == "f" else 0)) for i in (3, 4) for at in np.ndindex(*shape)]
    return spark.createDataFrame(rows, "image_id long, t int, z int, c int, y int, x int, value double").withColumn("value", F.col("value").cast("float").cast("double") if kind == "f4" else F.col("value"))


def as_set(df):
    return {tuple(r) for r in df.select("image_id", "t", "z", "c", "y", "x", "value").collect()}


@pytest.mark.parametrize("kind,deflate", [("u1", True), ("u2", False), ("i4", True), ("f4", False), ("f8", True)])
def test_round_trip(spark, tmp_path, kind, deflate):
    px = planes(spark, kind)
    made = stacks.write_stacks(t.to_tiles(px, 64), str(tmp_path / "s"), kind, deflate, rows=5).collect()
    assert {(r["image_id"], r["pages"]) for r in made} == {(3, 12), (4, 12)}
    found = stacks.read_stacks(spark, str(tmp_path / "s"), side=8)
    assert found.rdd.getNumPartitions() == 2 * 12 * 3  # a band of 8 rows each
    named = found.withColumn("image_id", F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long")).drop("path")
    assert as_set(t.from_tiles(named)) == as_set(px)
    assert stacks.read_stacks(spark, str(tmp_path / "s")).rdd.getNumPartitions() == 2 * 12  # a partition a plane


def by_hand(pages, order=">", description=b"", compression=1, rows=4, samples=1, planar=1, predictor=1, repeat=1):
    """A 32-bit file of 16-bit pages (h, w[, samples])."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    last = 4
    for page in pages:
        h, w = page.shape[:2]
        layers = [page[..., s] for s in range(samples)] if planar == 2 else [page.reshape(h, -1)]
        strips = []
        for layer in layers:
            for y in range(0, h, rows):
                part = layer[y : y + rows].astype(order + "u2")
                if predictor == 2:
                    wide = part.reshape(len(part), -1, 1 if planar == 2 else samples).astype("u2")
                    part = np.concatenate([wide[:, :1], np.diff(wide, axis=1)], axis=1).reshape(len(part), -1).astype(order + "u2")
                raw = part.tobytes()
                strips.append(zlib.compress(raw) if compression == 8 else raw)
        where = []
        for s in strips:
            where.append(len(out))
            out += s
        arrays = {}
        for name, values, letter in (("where", where, "I"), ("count", [len(s) for s in strips], "I"), ("bits", [16] * samples, "H")):
            arrays[name] = len(out)
            out += struct.pack(f"{order}{len(values)}{letter}", *values)
        text = len(out)
        out += description + b"\0"
        one = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
        many = lambda tag, kind, n, at, v: struct.pack(order + "HHII", tag, kind, n, at) if n * (4 if kind == 4 else 2) > 4 else struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "I", v) if kind == 4 else struct.pack(order + "2H", v, v))
        tags = [one(256, w), one(257, h), many(258, 3, samples, arrays["bits"], 16), one(259, compression)]
        tags += [struct.pack(order + "HHII", 270, 2, len(description) + 1, text)] if description else []
        tags += [many(273, 4, len(where), arrays["where"], where[0]), one(277, samples), one(278, rows), many(279, 4, len(where), arrays["count"], len(strips[0])), one(284, planar), one(317, predictor)]
        at = len(out)
        out[last : last + 4] = struct.pack(order + "I", at)
        out += struct.pack(order + "H", len(tags)) + b"".join(tags)
        last = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@pytest.mark.parametrize("order,compression,planar,predictor", [(">", 1, 1, 1), ("<", 8, 1, 2), (">", 8, 2, 2), ("<", 1, 2, 1)])
def test_colour_pages_of_both_byte_orders(spark, tmp_path, order, compression, planar, predictor):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 65536, (10, 7, 3)) for _ in range(2)]
    (tmp_path / "a.tif").write_bytes(by_hand(pages, order, b"", compression, 4, 3, planar, predictor))
    got = {(r["z"], r["c"], r["y"], r["x"]): r["value"] for r in t.from_tiles(stacks.read_stacks(spark, str(tmp_path), side=6).drop("path")).collect()}
    assert got == {(z, c, y, x): float(pages[z][y, x, c]) for z in range(2) for c in range(3) for y in range(10) for x in range(7)}


def test_order_of_axes_comes_from_the_description_or_the_caller(spark, tmp_path):
    pages = [np.full((2, 2), k) for k in range(12)]
    want = {"czt": lambda k: (k // 6, k // 2 % 3, k % 2), "tzc": lambda k: (k % 2, k // 2 % 3, k // 6)}
    notes = {"czt": b"ImageJ=1.5\nimages=12\nchannels=2\nslices=3\nframes=2\n", "tzc": b'<OME><Pixels DimensionOrder="XYTZC" SizeX="2" SizeY="2" SizeC="2" SizeZ="3" SizeT="2"/></OME>'}
    for name, note in notes.items():
        path = tmp_path / f"{name}.tif"
        path.write_bytes(by_hand(pages, description=note))
        rows = t.from_tiles(stacks.read_stacks(spark, str(path)).drop("path")).where("y = 0 AND x = 0").collect()
        assert {(r["t"], r["z"], r["c"]): int(r["value"]) for r in rows} == {want[name](k): k for k in range(12)}
    (tmp_path / "plain.tif").write_bytes(by_hand(pages))
    rows = stacks.list_planes(spark, str(tmp_path / "plain.tif"), "tzc", {"t": 2, "z": 3, "c": 2}).collect()
    assert {r["page"]: (r["t"], r["z"], r["c"]) for r in rows} == {k: want["tzc"](k) for k in range(12)}


def test_one_directory_for_all_planes_and_files_that_are_not_read(spark, tmp_path):
    pages = np.arange(5 * 4 * 3).reshape(5, 4, 3)
    (tmp_path / "raw.tif").write_bytes(by_hand([pages.reshape(20, 3)], "<", b"ImageJ=1.5\nimages=5\nslices=5\n", rows=20))
    raw = bytearray((tmp_path / "raw.tif").read_bytes())
    at = raw.index(struct.pack("<HHIHH", 257, 3, 1, 20, 0))
    raw[at : at + 12] = struct.pack("<HHIHH", 257, 3, 1, 4, 0)
    (tmp_path / "raw.tif").write_bytes(bytes(raw))
    got = {(r["z"], r["y"], r["x"]): int(r["value"]) for r in t.from_tiles(stacks.read_stacks(spark, str(tmp_path / "raw.tif")).drop("path")).collect()}
    assert got == {k: int(pages[k]) for k in np.ndindex(5, 4, 3)}
    (tmp_path / "bad.tif").write_bytes(b"something else than a stack")
    with pytest.raises(Exception, match="not a stack"):
        stacks.list_planes(spark, str(tmp_path / "bad.tif")).collect()
    with pytest.raises(Exception, match="lacks planes"):
        px = planes(spark, "u1").where("NOT (z = 1 AND c = 0)")
        stacks.write_stacks(t.to_tiles(px, 64), str(tmp_path / "x"), "u1").collect()
