"""Picture stacks (TIFF, also of the 64-bit kind): 8 to 64-bit integers and floats, plain or deflated, in strips.

Files are listed by Spark, their directories are read in parallel, and pixels are read by
bands: each band of a plane is a row of its own, so neither a stack nor a plane is ever
held whole. Executors open files by ``pyarrow.fs`` (local, HDFS, S3 and the like).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.sources.tiles import SIDE, _ints, _keys, _numbers, array_of, axes, whole_blocks

#: Tags of a directory that are read (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILED, FORMAT = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284, 317, 322, 339
#: Bytes and letter of each kind of entry (fixed values).
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946

PLANES = "path string, page int, t int, z int, c int, h int, w int, samples int, planar boolean, kind string, compression int, predictor int, rows int, offsets array<long>, counts array<long>"


def _open(uri: str):
    where, path = fs.FileSystem.from_uri(uri if re.match(r"\w+://", uri) else "file://" + uri.removeprefix("file:"))
    return where, path


def _entries(f, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """Tags of the directory at ``at``, and where the next one is (0: nowhere)."""
    f.seek(at)
    (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
    size, inline = (20, 8) if big else (12, 4)
    raw = f.read(n * size + (8 if big else 4))
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), raw[i * size : i * size + size - inline])
        if kind not in KINDS or tag not in (WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILED, FORMAT):
            continue
        letter = KINDS[kind]
        need = count * struct.calcsize("=" + letter)
        data = raw[i * size + size - inline : i * size + size]
        if need > inline:
            f.seek(struct.unpack(order + ("Q" if big else "I"), data)[0])
            data = f.read(need)
        tags[tag] = (data[:need].rstrip(b"\0"),) if letter == "s" else struct.unpack(f"{order}{count}{letter}", data[:need])
    return tags, struct.unpack(order + ("Q" if big else "I"), raw[n * size :])[0]


def directories(f) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each page of an open file."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a stack of this format")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    while at:
        tags, at = _entries(f, at, order, big)
        yield order, tags


def page_axes(description: str, pages: int) -> tuple[str, dict[str, int]]:
    """Order of the axes over the pages, the fastest first, and their extents, from the two common kinds of description; else pages are planes along z."""
    named = dict(re.findall(r"^(\w+)=(\d+)\s*$", description, re.M))
    if description.startswith("ImageJ="):
        sizes = {a: int(named.get(n, 1)) for a, n in (("c", "channels"), ("z", "slices"), ("t", "frames"))}
        if sizes["c"] * sizes["z"] * sizes["t"] == 1 and int(named.get("images", 1)) > 1:
            sizes["z"] = int(named["images"])
        return "czt", sizes
    if found := re.search(r'DimensionOrder="XY(\w{3})"', description):
        return found[1].lower(), {a.lower(): int(n) for a, n in re.findall(r'\bSize([CZT])="(\d+)"', description)}
    return "zct", {"z": pages, "c": 1, "t": 1}


def _place(page: int, order: str, sizes: dict[str, int]) -> dict[str, int]:
    out = {}
    for a in order:
        out[a], page = page % sizes[a], page // sizes[a]
    return out


def planes_of(path: str, order: str | None = None, sizes: dict[str, int] | None = None) -> list[dict]:
    """A row a page of one file; only its directories are read."""
    where, name = _open(path)
    with where.open_input_file(name) as f:
        pages = list(directories(f))
    described = (pages[0][1].get(DESCRIPTION) or (b"",))[0].decode("utf-8", "replace") if pages else ""
    repeated = re.search(r"^images=(\d+)\s*$", described, re.M)
    out = []
    for k, (endian, tags) in enumerate(pages):
        if TILED in tags:
            raise ValueError(f"{path}: pages in squares are not read, only those in strips")
        samples, bits, kind = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (1,)), tags.get(FORMAT, (1,))[0]
        compression, h, w = tags.get(COMPRESSION, (1,))[0], tags[HEIGHT][0], tags[WIDTH][0]
        if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or kind not in (1, 2, 3) or compression not in (PLAIN, DEFLATE, OLD_DEFLATE):
            raise ValueError(f"{path}: page {k} has bits {bits}, sample format {kind} and compression {compression}")
        rows = min(h, tags.get(ROWS, (h,))[0])
        n = -(-h // rows) * (samples if tags.get(PLANAR, (1,))[0] == 2 else 1)
        own = {
            "path": path, "page": k, "h": h, "w": w, "samples": samples, "planar": tags.get(PLANAR, (1,))[0] == 2, "kind": endian + {1: "u", 2: "i", 3: "f"}[kind] + str(bits[0] // 8),
            "compression": compression, "predictor": tags.get(PREDICTOR, (1,))[0], "rows": rows, "offsets": list(tags[OFFSETS][:n]), "counts": list(tags[COUNTS][:n]),
        }
        out.append(own)
    if len(out) == 1 and repeated and int(repeated[1]) > 1 and out[0]["compression"] == PLAIN:  # one directory for all planes, which lie one after the other
        one, size = out[0], out[0]["h"] * out[0]["w"] * out[0]["samples"] * int(out[0]["kind"][2:])
        out = [one | {"page": k, "rows": one["h"], "offsets": [one["offsets"][0] + k * size], "counts": [size]} for k in range(int(repeated[1])) if not one["planar"]]
    by, extent = (order, sizes) if order else page_axes(described, len(out))
    return [one | _place(one["page"], by, extent) for one in out]


def list_planes(spark: SparkSession, path: str, order: str | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """A row a page of all files at ``path`` (as Spark lists it), with its place along t, z and c.

    ``order`` and ``sizes`` say what the pages are where the files don't (the fastest axis first, as 'czt'). Files are not opened by the driver.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                rows = planes_of(name, order, sizes)
                if rows:
                    yield pd.DataFrame(rows)[[x.split()[0] for x in PLANES.split(", ")]]

    return files.repartition(F.col("path")).mapInPandas(run, PLANES)


def _strip(f, one: dict, index: int, width: int, rows: int) -> np.ndarray:
    f.seek(one["offsets"][index])
    raw = f.read(one["counts"][index])
    if one["compression"] != PLAIN:
        raw = zlib.decompress(raw)
    values = np.frombuffer(raw, one["kind"], rows * width).reshape(rows, width)
    if one["predictor"] == 2:  # differences along a row, by sample
        step = 1 if one["planar"] else one["samples"]
        values = np.cumsum(values.reshape(rows, -1, step), axis=1, dtype=values.dtype.newbyteorder("=")).reshape(rows, width)
    elif one["predictor"] != 1:
        raise ValueError(f"{one['path']}: predictor {one['predictor']} is not read")
    return values


def read_band(f, one: dict, y0: int, y1: int) -> np.ndarray:
    """Rows ``y0`` to ``y1`` of a page of an open file: (samples, rows, width); only the strips that hold them are read."""
    h, w, n, per = one["h"], one["w"], one["samples"], one["rows"]
    out, strips = np.zeros((n, y1 - y0, w)), -(-h // per)
    for k in range(y0 // per, -(-y1 // per)):
        begin, rows = k * per, min(per, h - k * per)
        a, b = max(y0, begin), min(y1, begin + rows)
        if one["planar"]:
            for s in range(n):
                out[s, a - y0 : b - y0] = _strip(f, one, s * strips + k, w, rows)[a - begin : b - begin]
        else:
            out[:, a - y0 : b - y0] = _strip(f, one, k, w * n, rows)[a - begin : b - begin].reshape(b - a, w, n).transpose(2, 0, 1)
    return out


def read_stacks(spark: SparkSession, path: str, side: int = SIDE, order: str | None = None, sizes: dict[str, int] | None = None, partitions: int | None = None) -> DataFrame:
    """Tiles of planes of all files at ``path``: image_id (hash of the file's path), path, t, z, c and the tile.

    Samples of a pixel (colours) follow each other along c. A task reads bands of ``side`` rows one at a
    time; bands are dealt to ``partitions`` tasks (as many as bands are in all unless given, a partition
    a plane where planes are at most ``side`` high). An empty folder gives no rows; other files are an error.
    """
    planes = list_planes(spark, path, order, sizes)
    bands = planes.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(side))))
    n = partitions or max(1, bands.count())
    dims = ("y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                where, name = _open(one["path"])
                y0, y1 = one["y0"], min(one["h"], one["y0"] + side)
                with where.open_input_file(name) as f:
                    band = read_band(f, one, y0, y1)
                rows = []
                for s in range(one["samples"]):
                    for x0 in range(0, one["w"], side):
                        block = band[s, :, x0 : x0 + side]
                        rows.append((one["image_id"], one["path"], one["t"], one["z"], one["c"] * one["samples"] + s, y0, x0, *block.shape, one["h"], one["w"], side, np.ascontiguousarray(block, "<f8").tobytes()))
                kinds = [pa.int64(), pa.string(), *[pa.int32()] * (len(names) - 3), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["image_id", "path", "t", "z", "c", *_numbers(dims), "data"]
    dealt = bands.withColumn("image_id", F.xxhash64("path")).repartitionByRange(n, "path", "page", "y0")
    return dealt.mapInArrow(run, "image_id long, path string, " + ", ".join(f"{c} int" for c in names[2:-1]) + ", data binary")


def _page(block: np.ndarray, kind: str, deflate: bool, rows: int, at: int, last: bool, text: bytes) -> bytes:
    """The bytes of a page at ``at`` of a 64-bit file: its directory, its arrays, then its strips."""
    h, w = block.shape
    values = block.astype("<" + kind)
    strips = [values[y : y + rows].tobytes() for y in range(0, h, rows)]
    if deflate:
        strips = [zlib.compress(s, 1) for s in strips]
    n = len(strips)
    entries = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * int(kind[1:])]), (COMPRESSION, 3, [DEFLATE if deflate else PLAIN]), (262, 3, [1])]
    entries += [(DESCRIPTION, 2, text + b"\0")] if text else []
    entries += [(OFFSETS, 16, [0] * n), (SAMPLES, 3, [1]), (ROWS, 4, [rows]), (COUNTS, 16, [len(s) for s in strips]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[kind[0]]])]
    head, letters = 8 + 20 * len(entries) + 8, {2: "s", 3: "H", 4: "I", 16: "Q"}
    packed = lambda kind_, v: v if kind_ == 2 else struct.pack(f"<{len(v)}{letters[kind_]}", *v)
    apart = sum(len(packed(t, v)) for _, t, v in entries if len(packed(t, v)) > 8)
    first = at + head + apart
    where = np.cumsum([0, *(len(s) for s in strips)]) + first
    entries = [(tag, t, where[:-1].tolist() if tag == OFFSETS else v) for tag, t, v in entries]
    body, extra, free = struct.pack("<Q", len(entries)), b"", at + head
    for tag, t, v in entries:
        raw = packed(t, v)
        body += struct.pack("<HHQ", tag, t, len(v))
        if len(raw) <= 8:
            body += raw.ljust(8, b"\0")
        else:
            body += struct.pack("<Q", free + len(extra))
            extra += raw
    end = int(where[-1])
    return body + struct.pack("<Q", 0 if last else end) + extra + b"".join(strips)


def write_stacks(tiles: DataFrame, folder: str, kind: str = "u2", deflate: bool = True, rows: int = 64) -> DataFrame:
    """(image_id, path, pages): a stack a file from tiles that are whole planes, pages in the order of c, then z, then t (absent columns are 0).

    ``kind``: u1, u2, u4, i1, i2, i4, f4 or f8. A file is written by one task, page by page, under another name until it is whole.
    """
    given = [c for c in _keys(tiles) if c in ("t", "z", "c")]
    if unknown := [c for c in _keys(tiles) if c not in ("image_id", *given)]:
        raise ValueError(f"stacks have no axes {unknown}")
    dims, order = axes(tiles), ["image_id", "t", "z", "c"]
    laid = tiles.select("image_id", *((F.col(c) if c in given else F.lit(0)).cast("int").alias(c) for c in ("t", "z", "c")), *_numbers(dims), "data")
    size = laid.groupBy("image_id").agg(*(F.countDistinct(c).cast("int").alias(f"n_{c}") for c in ("c", "z", "t")), F.count(F.lit(1)).cast("int").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        where, top = _open(folder)
        where.create_dir(top)
        image, out, done = None, None, []
        for batch in batches:
            for i, block in enumerate(whole_blocks(pa.Table.from_batches([batch]), dims)):
                own, nc, nz, nt, n = (batch.column(c)[i].as_py() for c in ("image_id", "n_c", "n_z", "n_t", "n"))
                if n != nc * nz * nt:
                    raise ValueError(f"image {own} lacks planes: {n} of {nc} x {nz} x {nt}")
                if out is None:
                    image, page, path, draft = own, 0, f"{top}/{own}.tif", f"{top}/.{own}-{uuid.uuid4().hex}"
                    out = where.open_output_stream(draft)
                    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
                text = f"ImageJ=1.54\nimages={n}\nchannels={nc}\nslices={nz}\nframes={nt}\nhyperstack=true\n".encode() if page == 0 else b""
                out.write(_page(block, kind, deflate, rows, out.tell(), page + 1 == n, text))
                page += 1
                if page == n:
                    out.close()
                    where.move(draft, path)
                    done.append((image, path, n))
                    out = None
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32()))], ["image_id", "path", "pages"])

    dealt = laid.join(size, "image_id").repartition("image_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "image_id long, path string, pages int")
