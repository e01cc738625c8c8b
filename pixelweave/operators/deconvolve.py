"""Richardson-Lucy deconvolution with a PSF table: whole planes or volumes, or those beyond one task in overlapping blocks."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import kernels
from pixelweave.sources.tiles import _assembled, _fields, _ints, _keys, _numbers, _runs, array_of, axes, whole_blocks

#: Pixels that are deconvolved together.
_TOGETHER = 1 << 20


def packed_psf(psf: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """(psf_id, pd, ph, pw, kernel): a PSF in one row, as little-endian doubles; pd is 1 for a plane.

    With ``tiles``, only the PSFs that they name are packed. The table asks to be joined by a shuffle, as Spark
    guesses the size of a table made by ``explode`` too low and would gather any number of kernels in the driver.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        solid = np.zeros([rows[c].max() + 1 for c in ("z", "y", "x")])
        solid[rows["z"], rows["y"], rows["x"]] = rows["value"]
        return pd.DataFrame({"psf_id": [rows["psf_id"].iloc[0]], **{n: [s] for n, s in zip(("pd", "ph", "pw"), solid.shape, strict=True)}, "kernel": [solid.astype("<f8").tobytes()]})

    own = psf if "z" in psf.columns else psf.withColumn("z", F.lit(0))
    if tiles is not None:
        own = own.join(tiles.select("psf_id").distinct(), "psf_id", "left_semi")
    packed = own.groupBy("psf_id").applyInPandas(pack, f"psf_id {psf.schema['psf_id'].dataType.simpleString()}, pd int, ph int, pw int, kernel binary")
    return packed.hint("merge")


def _solid(kernel, shape: list[int], dims: tuple[str, ...]) -> np.ndarray:
    solid = array_of(kernel.as_buffer(), *shape)
    if len(dims) == 3:
        return solid
    if shape[0] != 1:
        raise ValueError("a PSF with more than one plane needs tiles of volumes")
    return solid[0]


def richardson_lucy(tiles: DataFrame, psf: DataFrame, num_iters: int = 10, noncirc: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """Pixels (image_id, slice columns, axes, value) of the deconvolved planes or volumes of ``tiles`` (with psf_id).

    One plane or volume a row, all iterations in its task; those of one shape and with PSFs of one
    shape in a batch go together, each with its own. A PSF with more than one plane needs volumes.
    ``mask``: tiles of weights with the same keys, 0 for pixels to leave out, which come back
    unchanged. A plane in parts is an error: see ``richardson_lucy_tiles``.
    """
    dims, keys = axes(tiles), [k for k in _keys(tiles) if k != "psf_id"]
    rows = tiles.join(packed_psf(psf, tiles), "psf_id")
    if mask is not None:
        rows = rows.join(mask.select(*(k for k in _keys(mask) if k != "psf_id"), F.col("data").alias("seen")), [k for k in _keys(mask) if k in keys])
    else:
        rows = rows.withColumn("seen", F.lit(None).cast("binary"))

    def run(batches):
        for part in batches:
            groups: dict[tuple, list[int]] = {}
            blocks = list(whole_blocks(part, dims))
            reach = list(zip(*(part.column(c).to_pylist() for c in ("pd", "ph", "pw")), strict=True))
            for i, block in enumerate(blocks):
                groups.setdefault((block.shape, part.column("seen")[i].is_valid, reach[i]), []).append(i)
            for (shape, masked, solid), members in groups.items():
                step = max(1, _TOGETHER // int(np.prod(np.maximum(shape, solid[-len(dims) :]))))
                for at in range(0, len(members), step):
                    some = members[at : at + step]
                    seen = np.stack([array_of(part.column("seen")[i].as_buffer(), *shape) for i in some]) if masked else None
                    own = np.stack([_solid(part.column("kernel")[i], list(solid), dims) for i in some])
                    out = kernels.richardson_lucy(np.stack([blocks[i] for i in some]), own, num_iters, noncirc, seen, dims=len(dims))
                    spots = np.unravel_index(np.tile(np.arange(int(np.prod(shape))), len(some)), shape)
                    row = pa.array(np.repeat(some, int(np.prod(shape))))
                    columns = [*(part.column(k).take(row) for k in keys), *(pa.array(s, pa.int32()) for s in spots), pa.array(out.reshape(-1))]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, *dims, "value"])

    columns = [*keys, "psf_id", *_numbers(dims), "data", "pd", "ph", "pw", "kernel", "seen"]
    return rows.select(*columns).mapInArrow(run, _fields(tiles, keys) + ", ".join(f"{c} int" for c in dims) + ", value double")


def richardson_lucy_tiles(tiles: DataFrame, psf: DataFrame, num_iters: int = 10, overlap: int = 16, mask: DataFrame | None = None) -> DataFrame:
    """Tiles like ``tiles`` (with psf_id), deconvolved in blocks that overlap, for planes or volumes beyond one task.

    Each tile gets ``overlap`` pixels of its neighbours on every side and is deconvolved as an image
    whose surroundings aren't seen (``noncirc`` of ``richardson_lucy``), from the flat guess of the
    whole image. Results of neighbours meet in a cross-fade over half the overlap, by weights that add
    up to 1. A step carries what it sees a PSF's width further, so the difference to the whole image
    falls as the overlap grows, and is rounding from 2 * num_iters * (PSF's extent // 2) and the fade on.
    A task holds one block with its overlap and a few arrays of that size; a block's transfer functions
    are made once for a PSF and a shape in a task. ``overlap`` is at most a tile's side. Masks as in ``richardson_lucy``, as tiles of
    the same grid.
    """
    dims = axes(tiles)
    keys = [k for k in _keys(tiles) if k != "psf_id"]
    names, at, n = _numbers(dims), [f"{c}0" for c in dims], len(dims)
    size = names[2 * n : 3 * n]
    ramp = overlap // 4
    rows = tiles
    if mask is not None:
        seen = mask.select(*(k for k in _keys(mask) if k != "psf_id"), *at, F.col("data").alias("seen"))
        rows = rows.join(seen, [*(k for k in _keys(mask) if k in keys), *at])
        # two layers, the image and its mask, lie in a tile's data one after the other
        rows = rows.withColumn("data", F.concat("data", "seen")).drop("seen")
    layers = 1 if mask is None else 2

    def summed(batches):
        """What is seen of a tile."""
        for part in batches:
            each = [np.frombuffer(raw.as_buffer(), "<f8").reshape(layers, -1) for raw in part.column("data")]
            total = pa.array([float(v.prod(axis=0).sum()) for v in each], pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keys, "psf_id", *size)), total], [*keys, "psf_id", *size, "total"])

    totals = rows.select(*keys, "psf_id", *size, "data").mapInArrow(summed, _fields(tiles, [*keys, "psf_id"]) + "".join(f"{c} int, " for c in size) + "total double")
    whole = totals.groupBy(*keys, "psf_id", *size).agg(F.sum("total").alias("total")).join(packed_psf(psf, tiles), "psf_id")
    extra = F.struct("total", *size, "pd", "ph", "pw", "kernel")
    # one row an image: its sum and its PSF go along to every block
    rows = rows.join(whole.select(*keys, extra.alias("known")), keys)

    def block_of(values: np.ndarray, seen: np.ndarray | None, known: dict, cache: dict) -> np.ndarray:
        solid = [known[c] for c in ("pd", "ph", "pw")]
        kernel = _solid(pa.scalar(known["kernel"], pa.binary()), solid, dims)
        start = known["total"] / float(np.prod(kernels.frame_of(tuple(known[c] for c in size), kernel.shape, True)))
        key = (known["kernel"], values.shape)
        if key not in cache:
            if len(cache) >= 8:
                cache.pop(next(iter(cache)))
            cache[key] = kernels.Blur(kernels.pad_centred(kernel, kernels.frame_of(values.shape, kernel.shape, True)))
        return kernels.richardson_lucy(values, kernel, num_iters, True, seen, start, cache[key])

    to = [f"t{c}" for c in dims]

    def make(heads, keys_, dims_, numbers, blocks, insides, extras) -> pa.RecordBatch:
        """Weighted parts of each block's result for the tile itself and the neighbours that its fade reaches."""
        source, found, data, cache = [], [], [], {}
        for i, (number, block, inside, known) in enumerate(zip(numbers, blocks, insides, extras, strict=True)):
            low, shape, full, side = number[:n], number[n : 2 * n], number[2 * n : 3 * n], number[-1]
            values, seen = (block[0], block[1]) if layers == 2 else (block, None)
            out = block_of(values, seen, known, cache)
            begin = [a - s.start for a, s in zip(low, inside, strict=True)]  # of the block in the image
            for axis in range(n):
                w = kernels.fade(low[axis], low[axis] + shape[axis], ramp, full[axis])
                first = max(0, low[axis] - ramp) - begin[axis]
                out = np.take(out, range(first, first + len(w)), axis) * w.reshape([-1 if k == axis else 1 for k in range(n)])
                begin[axis] += first
            near = [range(max(0, a - ramp) // side * side, min(f, a + s + ramp), side) for a, s, f in zip(low, shape, full, strict=True)]
            for there in itertools.product(*near):
                b = [max(t, o) for t, o in zip(there, begin, strict=True)]
                e = [min(t + side, o + k) for t, o, k in zip(there, begin, out.shape, strict=True)]
                if all(x < y for x, y in zip(b, e, strict=True)):
                    piece = out[tuple(slice(x - o, y - o) for x, y, o in zip(b, e, begin, strict=True))]
                    source.append(i)
                    found.append((*there, *b, *piece.shape, *full, side))
                    data.append(piece.tobytes())
        columns = [*(heads.column(k).combine_chunks().take(pa.array(source)) for k in keys_), *(pa.array(c, pa.int32()) for c in zip(*found, strict=True)), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*keys_, *to, *names, "data"])

    def joined(batches):
        """Tiles as the sums of their parts."""
        for part, cuts in _runs(batches, [*keys, "psf_id", *to]):
            found = list(zip(*(x.tolist() for x in _ints(part, [*to, *names])), strict=True))
            numbers, data = [], []
            for a, b in itertools.pairwise(cuts.tolist()):
                there, full, side = found[a][:n], found[a][3 * n : 4 * n], found[a][-1]
                shape = [min(side, f - t) for t, f in zip(there, full, strict=True)]
                total = np.zeros(shape)
                for i in range(a, b):
                    begin, own = found[i][n : 2 * n], found[i][2 * n : 3 * n]
                    total[tuple(slice(p - t, p - t + s) for p, t, s in zip(begin, there, own, strict=True))] += array_of(part.column("data")[i].as_buffer(), *own)
                numbers.append((*there, *shape, *full, side))
                data.append(total.tobytes())
            heads = part.take(cuts[:-1])
            yield pa.RecordBatch.from_arrays([*(heads.column(k).combine_chunks() for k in (*keys, "psf_id")), *(pa.array(c, pa.int32()) for c in zip(*numbers, strict=True)), pa.array(data, pa.binary())], [*keys, "psf_id", *names, "data"])

    body = ", ".join([*(f"{c} int" for c in (*to, *names)), "data binary"])
    parts = _assembled(rows.select(*keys, "psf_id", *names, "data", "known"), overlap, "known", make, body, layers)
    by = [*keys, "psf_id", *to]
    sent = parts.repartition(*(F.col(c) for c in by)).sortWithinPartitions(*by)
    return sent.mapInArrow(joined, _fields(tiles, [*keys, "psf_id"]) + ", ".join(f"{c} int" for c in names) + ", data binary")
