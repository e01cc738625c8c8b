"""Tiles: one row a plane, a volume or a part of it, and kernels over them with halo exchange.

Tiles of planes: image_id, further slice columns, y0, x0, dy, dx, h, w, side, data
(little-endian doubles in row order). h and w are the extents of the whole plane, side
the spacing of its tiles. Tiles of volumes also have z0, dz and d, and z is no slice
column. Coordinates begin at 0. Rows of a tile are brought together by sorting within
partitions and read as a stream; all tiles of a batch are packed and unpacked at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.staging import shared_folder

#: Sides of tiles of planes and of volumes.
SIDE, SIDE_3D = 1024, 128
_SIZE = {"z": "d", "y": "h", "x": "w"}


def axes(tiles: DataFrame) -> tuple[str, ...]:
    """The axes that a kernel sees: y and x, or z, y and x."""
    return ("z", "y", "x") if "z0" in tiles.columns else ("y", "x")


def _numbers(dims: tuple[str, ...]) -> list[str]:
    return [f"{c}0" for c in dims] + [f"d{c}" for c in dims] + [_SIZE[c] for c in dims] + ["side"]


def _keys(df: DataFrame) -> list[str]:
    dims = axes(df)
    return [c for c in df.columns if c not in (*dims, "value", *_numbers(dims), "data")]


def _fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)


def _body(dims: tuple[str, ...]) -> str:
    return ", ".join(f"{c} int" for c in _numbers(dims)) + ", data binary"


def array_of(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(shape)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    if column.null_count:
        v = column.to_pylist()
        return np.fromiter((a is not b and a != b for a, b in itertools.pairwise(v)), bool, len(v) - 1)
    v = column.to_numpy()
    return v[1:] != v[:-1]


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows with the starts of their runs of equal keys, and the end; a run is never split."""

    def cuts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows - 1, bool)
        for c in by:
            new |= _changes(table.column(c))
        return np.flatnonzero(np.concatenate([[True], new]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = held and any(held[0].column(held[0].schema.get_field_index(c))[0] != batch.column(batch.schema.get_field_index(c))[batch.num_rows - 1] for c in by)
        held.append(batch)
        if ends or len(held) == 1:
            table = pa.Table.from_batches(held)
            at = cuts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at
                held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(cuts(table), table.num_rows)


#: Pixels of tiles that a task packs, unpacks or filters at a time, as a batch may hold many tiles or large ones.
TOGETHER = 1 << 18


def _some(batches: Iterator[pa.RecordBatch], dims: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of batches of tiles by ``TOGETHER`` pixels, one tile at least."""
    for rows in batches:
        n = np.prod(_ints(rows, [f"d{c}" for c in dims]), axis=0)
        part = np.cumsum(n) // TOGETHER
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(n) else []
        for a, b in itertools.pairwise(cuts):
            yield rows.slice(a, b - a)


def _few(runs: Iterator[tuple[pa.Table, np.ndarray]], size: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of equal keys by ``TOGETHER`` pixels, one run at least; ``size`` gives a row's pixels."""
    for rows, cuts in runs:
        part = np.concatenate([[0], np.cumsum(np.add.reduceat(size(rows), cuts[:-1]))[:-1] // TOGETHER])
        ends = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(cuts) - 1)
        for a, b in itertools.pairwise(ends):
            yield rows.slice(cuts[a], cuts[b] - cuts[a]), cuts[a : b + 1] - cuts[a]


def _ints(table, names) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of ``flat`` (doubles), without copying each."""
    flat = np.ascontiguousarray(flat, "<f8")
    if flat.nbytes >= 1 << 31:
        return pa.array([flat[a:b].tobytes() for a, b in itertools.pairwise(ends)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(flat)])


def to_tiles(pixels: DataFrame, side: int | None = None, volume: bool = False) -> DataFrame:
    """Dense pixels as tiles of at most ``side`` along each axis; ``volume``: z is an axis of the tiles and no slice column."""
    dims = ("z", "y", "x") if volume else ("y", "x")
    side = side or (SIDE_3D if volume else SIDE)
    keys = [c for c in pixels.columns if c not in (*dims, "value")]
    size = pixels.groupBy(*keys).agg(*((F.max(c) + 1).alias(_SIZE[c]) for c in dims))
    placed = pixels.join(size, keys).withColumns({f"{c}0": (F.expr(f"{c} div {side}") * side).cast("int") for c in dims})
    at = [*keys, *(f"{c}0" for c in dims)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _runs(batches, at):
            heads, n = rows.take(cuts[:-1]), np.diff(cuts)
            low, whole = _ints(heads, [f"{c}0" for c in dims]), _ints(heads, [_SIZE[c] for c in dims])
            shape = [np.minimum(side, w - a) for a, w in zip(low, whole, strict=True)]
            ends = np.concatenate([[0], np.cumsum(np.prod(shape, axis=0))])
            spot = np.zeros(rows.num_rows, np.int64)
            for c, a, s in zip(dims, low, shape, strict=True):
                spot = spot * np.repeat(s, n) + rows.column(c).to_numpy() - np.repeat(a, n)
            flat = np.zeros(ends[-1])
            flat[np.repeat(ends[:-1], n) + spot] = rows.column("value").to_numpy()
            columns = [*(heads.column(k).combine_chunks() for k in keys), *(pa.array(v, pa.int32()) for v in (*low, *shape, *whole, np.full(len(n), side))), _binary(flat, ends)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *_numbers(dims), "data"])

    dealt = placed.select(*at, *dims, *(_SIZE[c] for c in dims), F.col("value").cast("double").alias("value")).repartition(*(F.col(c) for c in at)).sortWithinPartitions(*at)
    return dealt.mapInArrow(pack, _fields(pixels, keys) + _body(dims))


def from_tiles(tiles: DataFrame) -> DataFrame:
    keys, dims = _keys(tiles), axes(tiles)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches, dims):
            low, shape = (_ints(rows, [c.format(x) for x in dims]) for c in ("{}0", "d{}"))
            n = np.prod(shape, axis=0)
            first = np.cumsum(n) - n
            spot, out = np.arange(n.sum()) - np.repeat(first, n), {}
            for c, a, s in reversed(list(zip(dims, low, shape, strict=True))):
                s = np.repeat(s, n)
                out[c], spot = spot % s + np.repeat(a, n), spot // s
            values = np.concatenate([np.frombuffer(x.as_buffer(), "<f8") for x in rows.column("data")]) if rows.num_rows else np.zeros(0)
            row = pa.array(np.repeat(np.arange(rows.num_rows), n))
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(row) for k in keys), *(pa.array(out[c], pa.int32()) for c in dims), pa.array(values)], [*keys, *dims, "value"])

    return tiles.select(*keys, *_numbers(dims), "data").mapInArrow(unpack, _fields(tiles, keys) + ", ".join(f"{c} int" for c in dims) + ", value double")


def _made(heads, keys: list[str], dims: tuple[str, ...], numbers: list[tuple], blocks: list[np.ndarray]) -> pa.RecordBatch:
    data = pa.array([np.ascontiguousarray(b, "<f8").tobytes() for b in blocks], pa.binary())
    return pa.RecordBatch.from_arrays([*(heads.column(k) for k in keys), *(pa.array(c, pa.int32()) for c in zip(*numbers, strict=True)), data], [*keys, *_numbers(dims), "data"])


def apply_whole(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel on tiles that are whole planes or volumes; one in parts is an error."""
    keys, dims = _keys(tiles), axes(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches, dims):
            numbers = list(zip(*(x.tolist() for x in _ints(rows, _numbers(dims))), strict=True))
            blocks = [np.asarray(kernel(block)) for block in whole_blocks(rows, dims)]
            if blocks:
                yield _made(rows, keys, dims, numbers, blocks)

    return tiles.select(*keys, *_numbers(dims), "data").mapInArrow(run, _fields(tiles, keys) + _body(dims))


def whole_blocks(rows, dims: tuple[str, ...]) -> Iterator[np.ndarray]:
    """The arrays of tiles that are whole; one in parts is an error."""
    shape, whole = (np.stack(_ints(rows, names), axis=1) for names in ([f"d{c}" for c in dims], [_SIZE[c] for c in dims]))
    if (shape != whole).any():
        raise ValueError("this operator needs whole planes or volumes: make tiles of at least their size")
    return (array_of(x.as_buffer(), *s) for x, s in zip(rows.column("data"), shape.tolist(), strict=True))


def _assembled(tiles: DataFrame, halo: int, extra: str | None, make: Callable, schema: str, layers: int = 1) -> DataFrame:
    """Tiles with their halo, brought together; ``make(heads, keys, dims, numbers, blocks, insides, extras)`` turns each batch of them into rows.

    Each tile is sent to itself, and the part of it within the halo of a neighbour to
    that neighbour, so the shuffle carries the data and the rims. ``extra`` is a column
    that goes along with a tile to itself. With ``layers`` the data of a tile are that
    many arrays, and blocks have them along a first axis.
    """
    dims, lead = axes(tiles), (layers,) * (layers > 1)
    keys = [k for k in _keys(tiles) if k != extra]
    more = [extra] if extra else []
    to, names = [f"t{c}" for c in dims], _numbers(dims)
    at = [*keys, *to]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches, dims):
            source, own, numbers, data = [], [], [], []
            heads = zip(*(x.tolist() for x in _ints(rows, names)), strict=True)
            for i, (head, raw) in enumerate(zip(heads, rows.column("data"), strict=True)):
                k = len(dims)
                low, shape, whole, side = head[:k], head[k : 2 * k], head[2 * k : 3 * k], head[-1]
                if tuple(shape) == tuple(whole):
                    source.append(i)
                    own.append(i)
                    numbers.append((*low, *head))
                    data.append(raw.as_py())
                    continue
                block = array_of(raw.as_buffer(), *lead, *shape)
                near = [range(max(0, a - halo) // side * side, min(w, a + s + halo), side) for a, s, w in zip(low, shape, whole, strict=True)]
                for there in itertools.product(*near):
                    begin = [max(a, t - halo) for a, t in zip(low, there, strict=True)]
                    end = [min(a + s, t + side + halo) for a, s, t in zip(low, shape, there, strict=True)]
                    if all(a < b for a, b in zip(begin, end, strict=True)):
                        piece = block[(..., *(slice(a - o, b - o) for a, b, o in zip(begin, end, low, strict=True)))]
                        source.append(i)
                        own.append(i if there == tuple(low) else None)
                        numbers.append((*there, *begin, *piece.shape[-k:], *whole, side))
                        data.append(piece.tobytes())
            if source:
                columns = [*(rows.column(c).take(pa.array(source)) for c in keys), *(rows.column(c).take(pa.array(own, pa.int64())) for c in more), *(pa.array(c, pa.int32()) for c in zip(*numbers, strict=True)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *more, *to, *names, "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _few(_runs(_some(batches, dims), at), lambda t: np.prod(_ints(t, [f"d{c}" for c in dims]), axis=0)):
            k, numbers, blocks, insides, own = len(dims), [], [], [], []
            parts = list(zip(*(x.tolist() for x in _ints(rows, [*to, *names])), strict=True))
            data = rows.column("data")
            for a, b in itertools.pairwise(cuts.tolist()):
                there, whole, side = parts[a][:k], parts[a][3 * k : 4 * k], parts[a][-1]
                low, high = [max(0, t - halo) for t in there], [min(w, t + side + halo) for t, w in zip(there, whole, strict=True)]
                block = np.zeros([*lead, *(h - o for o, h in zip(low, high, strict=True))])
                for i in range(a, b):
                    begin, shape = parts[i][k : 2 * k], parts[i][2 * k : 3 * k]
                    block[(..., *(slice(p - o, p - o + s) for p, o, s in zip(begin, low, shape, strict=True)))] = array_of(data[i].as_buffer(), *lead, *shape)
                    if begin == there:
                        own.append(i)
                shape = [min(side, w - t) for t, w in zip(there, whole, strict=True)]
                numbers.append((*there, *shape, *whole, side))
                blocks.append(block)
                insides.append(tuple(slice(t - o, t - o + s) for t, o, s in zip(there, low, shape, strict=True)))
            heads = rows.take(cuts[:-1]).combine_chunks()
            yield make(heads, keys, dims, numbers, blocks, insides, rows.column(extra).take(pa.array(own)).to_pylist() if extra else [None] * len(blocks))

    fields = _fields(tiles, [*keys, *more])
    sent = tiles.select(*keys, *more, *names, "data").mapInArrow(spread, fields + "".join(f"{c} int, " for c in to) + _body(dims))
    return sent.repartition(*(F.col(c) for c in at)).sortWithinPartitions(*at).mapInArrow(run, _fields(tiles, keys) + schema)


#: Pixels of blocks that a kernel of stacks gets at once, so that its arrays stay in the processor's cache.
STACKED = 1 << 15


def _stacks(blocks: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of blocks of one size, by ``STACKED`` pixels, one block at least."""
    alike: dict[tuple, list[int]] = {}
    for i, b in enumerate(blocks):
        alike.setdefault(b.shape, []).append(i)
    for shape, at in alike.items():
        n = max(1, STACKED // max(1, int(np.prod(shape))))
        yield from (at[k : k + n] for k in range(0, len(at), n))


def apply_halo(tiles: DataFrame, kernel: Callable[..., np.ndarray], halo: int, extra: str | None = None, stacked: bool = False) -> DataFrame:
    """A kernel that looks ``halo`` far along each axis, on tiles of any size.

    The kernel pads true borders by its own rule; what it makes up inside is cut off.
    With ``extra`` it also gets the tile's value of that column. With ``stacked`` it gets
    blocks of one size along a first axis and their values of ``extra`` (numbers) as an
    array, as a call for each of many small tiles takes longer than its pixels do.
    """

    def make(heads, keys, dims, numbers, blocks, insides, extras) -> pa.RecordBatch:
        if stacked:
            done = [None] * len(blocks)
            for at in _stacks(blocks):
                more = [np.array([extras[i] for i in at], float)] if extra else []
                for i, a in zip(at, kernel(np.stack([blocks[i] for i in at]), *more), strict=True):
                    done[i] = a[insides[i]]
        else:
            done = [np.asarray(kernel(b, e) if extra else kernel(b))[i] for b, i, e in zip(blocks, insides, extras, strict=True)]
        return _made(heads.combine_chunks().to_batches()[0], keys, dims, numbers, done)

    return _assembled(tiles, halo, extra, make, _body(axes(tiles)))


def largest(tiles: DataFrame, kernel: Callable[[np.ndarray], list[np.ndarray]], halo: int) -> DataFrame:
    """(keys, largest): the maximum over the whole plane or volume of each array that the kernel makes."""

    def make(heads, keys, dims, numbers, blocks, insides, extras) -> pa.RecordBatch:
        most = [[float(a[i].max()) for a in kernel(b)] for b, i in zip(blocks, insides, strict=True)]
        return pa.RecordBatch.from_arrays([*(heads.column(k).combine_chunks() for k in keys), pa.array(most, pa.list_(pa.float64()))], [*keys, "largest"])

    keys = _keys(tiles)
    each = _assembled(tiles, halo, None, make, "largest array<double>").select(*keys, F.posexplode("largest").alias("i", "v"))
    tops = each.groupBy(*keys, "i").agg(F.max("v").alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("largest"))
    return tops.withColumn("largest", F.col("largest.v"))


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Picture files as pixels (image_id: hash of the path, c, y, x, value); blue-green-red order becomes red-green-blue."""
    files = spark.read.format("image").option("dropInvalid", True).load(path).select(F.xxhash64("image.origin").alias("image_id"), "image.width", "image.nChannels", "image.data")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                one, width, n, data = (rows.column(i)[k].as_py() for i in range(4))
                values = np.frombuffer(data, np.uint8).astype(float)
                i = np.arange(len(values))
                c = i % n if n == 1 else np.where(i % n < 3, 2 - i % n, 3)
                columns = [pa.array(np.full(len(i), one)), *(pa.array(v, pa.int32()) for v in (c, i // (n * width), i // n % width)), pa.array(values)]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "c", "y", "x", "value"])

    return files.mapInArrow(unpack, "image_id long, c int, y int, x int, value double")


def write_table(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet, in folders by a hash bucket of image_id."""
    df.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def round_trip(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, for checks of the table format."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return read_table(df.sparkSession, path)
