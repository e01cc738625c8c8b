"""Connected components of masks: runs united in tiles, a graph of the tiles' borders, and ids in raster order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.graph import components
from pixelweave.functions.ranks import ranked
from pixelweave.functions.staging import staged
from pixelweave.sources.tiles import _ints, _runs

TILE = 512


def half_neighbours(dims: int, full: bool) -> list[tuple[int, ...]]:
    """One of each pair of opposite neighbour offsets; all 3^d - 1, or those along one axis."""
    every = [o for o in itertools.product((-1, 0, 1), repeat=dims) if o > (0,) * dims]
    return every if full else [o for o in every if sum(map(abs, o)) == 1]


def sparse_roots(points: np.ndarray, full: bool = True) -> np.ndarray:
    """For each of the points (rows of coordinates), the least index of a point of its component, in row order."""
    low = points.min(axis=0) - 1
    size = points.max(axis=0) - low + 2
    steps = np.concatenate([np.cumprod(size[::-1])[-2::-1], [1]]).astype(np.int64)
    key = ((points - low) * steps).sum(axis=1)
    order = np.argsort(key, kind="stable")
    by_key = key[order]
    ends = []
    for o in half_neighbours(points.shape[1], full):
        want = by_key + int((np.array(o) * steps).sum())
        at = np.minimum(np.searchsorted(by_key, want), len(by_key) - 1)
        hit = np.flatnonzero(by_key[at] == want)
        ends.append(np.stack([hit, at[hit]]))
    a, b = np.concatenate(ends, axis=1)
    root = np.arange(len(key))
    while True:  # hook larger roots to smaller ones, then halve the paths
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not (root == root[root]).all():
            root = root[root]
    least = np.full(len(key), len(key))
    np.minimum.at(least, root, order)  # order: index of the sorted point in the rows
    out = np.empty(len(key), np.int64)
    out[order] = least[root]
    return out


def run_roots(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, shifts: list[int], reach: int) -> np.ndarray:
    """For runs sorted by (row, x0), the least index of a run of the same component.

    ``row`` numbers rows so that a row's neighbours differ by ``shifts``; runs x0..x1 of neighbouring
    rows touch where they overlap after growing by ``reach``, and those of one row where they meet.
    """
    wide = int(x1.max()) + 4 if len(x1) else 4
    low, high = row * wide + x0 + 2, row * wide + x1 + 2
    ends = []
    for shift, grow in [(0, 1), *((s, reach) for s in shifts)]:
        first = np.searchsorted(high, low + shift * wide - grow)
        last = np.searchsorted(low, high + shift * wide + grow, side="right")
        if not shift:
            first = np.maximum(first, np.arange(len(row)) + 1)  # a row's later runs alone
        n = np.maximum(last - first, 0)
        a = np.repeat(np.arange(len(row)), n)
        ends.append(np.stack([a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]))
    a, b = np.concatenate(ends, axis=1)
    root = np.arange(len(row))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not (root == root[root]).all():
            root = root[root]


def to_runs(mask: DataFrame, per: list[str]) -> DataFrame:
    """(per, [z], y, x0, x1): runs of set pixels along x, both ends set; repeated pixels count once."""
    row = [*per, *(c for c in ("z", "y") if c in mask.columns and c not in per)]
    along = Window.partitionBy(*row).orderBy("x")
    new = F.when(F.col("x") - F.lag("x").over(along) <= 1, 0).otherwise(1)
    numbered = mask.select(*row, "x").withColumn("new", new).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*row, "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def label_runs(runs: DataFrame, per: list[str], connectivity: str = "full", tile: int = TILE) -> DataFrame:
    """Runs (per, [z], y, x0, x1) with ``label`` 1..n of their objects, in raster order of first pixels; runs are cut at tiles.

    Runs are the unit throughout: those of a tile are united in its task, runs at the tiles' borders
    meet pixel by pixel in a join, and their components in a graph. Ids are ranked by ranges.
    """
    dims = [*(c for c in ("z", "y") if c in runs.columns and c not in per), "x"]
    full, wide = connectivity == "full", 1 << (63 // len(dims) if len(dims) > 2 else 31)
    spot = F.lit(0).cast("long")
    for c, v in zip(dims, [*dims[:-1], "x0"], strict=True):
        inside = (F.col(v) >= 0) & ((F.col("x1") if c == "x" else F.col(v)) < wide)
        runs = runs.withColumn(v, F.when(inside, F.col(v)).otherwise(F.raise_error(F.lit(f"{c} is not in [0, {wide})")).cast(runs.schema[v].dataType)))
        spot = spot * wide + F.col(v).cast("long")
    cut = runs.withColumn("t_x", F.explode(F.sequence(F.expr(f"x0 div {tile}"), F.expr(f"x1 div {tile}"))))
    kind = runs.schema["x0"].dataType
    cut = cut.withColumn("x0", F.greatest("x0", F.col("t_x") * tile).cast(kind)).withColumn("x1", F.least("x1", F.col("t_x") * tile + tile - 1).cast(kind)).withColumn("spot", spot)
    tiles = {**{f"t_{c}": F.expr(f"{c} div {tile}") for c in dims[:-1]}, "t_x": F.col("t_x")}
    fields = [f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in [*per, *dims[:-1], "x0", "x1"]]
    names = [*per, *dims[:-1], "x0", "x1"]

    by = [*per, *tiles]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles of a batch at once, one below the other with empty rows between."""
        for rows, cuts in _runs(batches, by):
            n = np.diff(cuts)
            low, high = ({c: f.reduceat(v, cuts[:-1]) for c, v in zip(dims[:-1], _ints(rows, dims[:-1]), strict=True)} for f in (np.minimum, np.maximum))
            tall = high["y"] - low["y"] + 3
            step = int(tall.max())
            size = (high["z"] - low["z"] + 2) * step if len(dims) == 3 else tall
            row = np.repeat(np.cumsum(size) - size - low["y"] + 1, n) + rows.column("y").to_numpy()
            if len(dims) == 3:
                row += (rows.column("z").to_numpy().astype(np.int64) - np.repeat(low["z"], n)) * step
            shifts = [1] if len(dims) == 2 else [1, step - 1, step, step + 1] if full else [1, step]
            left, right, spots = _ints(rows, ["x0", "x1", "spot"])
            origin = rows.column("t_x").to_numpy().astype(np.int64) * tile
            order = np.lexsort((left, row))
            root = np.empty(len(order), np.int64)
            root[order] = order[run_roots(row[order], (left - origin)[order], (right - origin)[order], shifts, int(full))]
            table = rows.select(names).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in names), pa.array(spots), pa.array(spots[root])], [*names, "spot", "first"])

    placed = cut.withColumns(tiles)
    dealt = placed.select(*by, *(c for c in [*dims[:-1], "x0", "x1", "spot"] if c not in by)).repartition(*by).sortWithinPartitions(*by)
    done = staged(dealt.mapInArrow(local, ", ".join([*fields, "spot long", "first long"])), "local")
    edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    flat = F.lit(False)
    for c in dims[:-1]:
        flat = flat | edge(c)
    tips = F.filter(F.array_distinct(F.array("x0", "x1")), lambda v: (v % tile == 0) | (v % tile == tile - 1))
    border = done.withColumn("x", F.explode(F.when(flat, F.sequence("x0", "x1")).otherwise(tips)))
    border = border.withColumn("part", F.struct(*(F.expr(f"{c} div {tile}").alias(f"t_{c}") for c in dims)))
    moves = F.array(*(F.struct(*(F.lit(o).alias(f"d{c}") for c, o in zip(dims, offset, strict=True))) for offset in half_neighbours(len(dims), full)))
    one = border.withColumn("move", F.explode(moves)).select(*per, "part", "first", *((F.col(c) + F.col(f"move.d{c}")).alias(c) for c in dims))
    two = border.select(*per, F.col("part").alias("part2"), F.col("first").alias("first2"), *dims)
    node = lambda first: F.struct(*per, F.col(first).alias("first"))
    edges = staged(one.join(two, [*per, *dims]).where("part <> part2").select(node("first").alias("a"), node("first2").alias("b")).distinct(), "touching")
    if edges.limit(1).count():
        roots = components(edges).select(F.col("v").alias("node"), F.col("root.first").alias("root"))
        done = done.withColumn("node", node("first")).join(roots, "node", "left").withColumn("first", F.coalesce("root", "first")).drop("node", "root")
    objects = ranked(done.select(*per, "first").distinct(), per, ["first"], "label")
    return done.join(objects, [*per, "first"]).select(*names, "label")


def label(mask: DataFrame, per: list[str] | None = None, connectivity: str = "full", tile: int = TILE) -> DataFrame:
    """``mask`` (set pixels) with ``label`` 1..n of its objects, in raster order of their first pixels.

    Pixels touch along an edge ('edge') or also at corners ('full'); coordinates
    that are not in ``per`` belong to the object, so stacks without z in ``per``
    give solid objects. Coordinates are in [0, 2^31) on planes and in [0, 2^21) in
    volumes; others are an error. Pixels become runs first (one shuffle, by image and row), and
    all else is done on runs.
    """
    per = per or ["image_id"]
    dims = [c for c in ("z", "y", "x") if c in mask.columns and c not in per]
    found = label_runs(to_runs(mask, per), per, connectivity, tile)
    return found.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*per, *dims, "label")
