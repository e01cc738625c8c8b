"""Axes as columns: names, slots, selecting, iterating and passing, and joining slices again."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Other names of the axes (fixed values).
SYNONYMS = {
    "x": ("col", "cols", "column", "columns"),
    "y": ("row", "rows"),
    "z": ("pln", "plane", "planes", "slice", "slices"),
    "c": ("ch", "chan", "channel", "channels"),
    "t": ("frame", "frames", "time", "timepoint", "timepoints"),
}
_NAMES = {other: axis for axis, others in SYNONYMS.items() for other in others}
#: Columns that are no axes.
_OTHER = frozenset("image_id value label mask_id data dtype".split())


def canonical(name: str) -> str:
    """The usual name of an axis; unknown names are only folded."""
    folded = name.strip().casefold()
    return _NAMES.get(folded, folded)


def canonical_axes(df: DataFrame) -> DataFrame:
    """Columns named by a synonym get the usual axis name; the same axis twice is an error."""
    new = [canonical(c) if c not in _OTHER else c for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"repeated axis in {df.columns}")
    return df.toDF(*new)


def plan_axes(slots: list[str], axes: list[str]) -> dict[str, str]:
    """Which axis fills each slot: by name, then what is left to the required slots from the right.

    A slot that ends in '?' is optional and is filled by name alone.
    """
    named = [canonical(a) for a in axes]
    if len(set(named)) < len(named):
        raise ValueError(f"repeated axis in {axes}")
    chosen = {s: axes[named.index(s.rstrip("?"))] for s in slots if s.rstrip("?") in named}
    empty = [s for s in slots if s not in chosen and not s.endswith("?")]
    free = [a for a in axes if a not in chosen.values()]
    if len(free) < len(empty):
        raise ValueError(f"{len([s for s in slots if not s.endswith('?')])} axes are needed, {axes} given")
    for slot, axis in zip(empty, free[len(free) - len(empty) :], strict=True):
        warnings.warn(f"axis {axis!r} is used as {slot!r}", stacklevel=2)
        chosen[slot] = axis
    return {s.rstrip("?"): a for s, a in chosen.items()}


def map_axes(df: DataFrame, slots: list[str], axes: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the chosen axes under the slots' names; transposing is renaming."""
    plan = plan_axes(slots, axes)
    plan.update(mapping or {})
    if len(set(plan.values())) < len(plan):
        raise ValueError(f"an axis fills two slots: {plan}")
    back = {a: s for s, a in plan.items()}
    spare = [c for c in df.columns if c in plan and c not in back]  # a column whose name is taken over
    renamed = {c: f"{c}_" for c in spare}
    return df.toDF(*(back.get(c, renamed.get(c, c)) for c in df.columns))


def select_axis(df: DataFrame, axis: str, at: int = 0) -> DataFrame:
    """One position of an axis, without the axis."""
    return df.where(F.col(axis) == at).drop(axis)


def iterate_key(df: DataFrame, slots: list[str], passed: list[str] | None = None) -> list[str]:
    """The columns that group rows of one run: every axis that is no slot and isn't passed."""
    passed = passed or []
    return [c for c in df.columns if c not in slots and c not in passed and c not in ("value", "label")]


def renumber(labels: DataFrame, slice_axes: list[str] | None = None, key: str = "image_id") -> DataFrame:
    """Labels of independent slices made unique: each slice starts after the largest labels before it."""
    slice_axes = slice_axes or ["z"]
    tops = labels.groupBy(key, *slice_axes).agg(F.max("label").alias("top"))
    before = Window.partitionBy(key).orderBy(*slice_axes).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(key, *slice_axes, F.coalesce(F.sum("top").over(before), F.lit(0)).alias("offset"))
    moved = labels.join(offsets, [key, *slice_axes])
    return moved.withColumn("label", F.when(F.col("label") == 0, F.col("label")).otherwise(F.col("label") + F.col("offset")).cast("long")).drop("offset")


def apply_planes(pixels: DataFrame, fn, iterate: list[str], out: str = "image", value: str = "value") -> DataFrame:
    """Run a function of a 2-D array on every plane of ``pixels``.

    ``iterate`` are the columns that tell planes apart. out: 'image' and 'labels'
    give a pixel table (labels without 0, unique over the slices of an image),
    'scalar' one value a plane, 'points' and 'boxes' a row for each row of the
    function's array. An empty plane is handed on as it is: no rows, no call.
    """
    names = {"image": ["y", "x", "value"], "labels": ["y", "x", "label"], "scalar": ["value"], "points": ["y", "x"], "boxes": ["min_y", "min_x", "max_y", "max_x"]}[out]
    kinds = {"y": "double" if out == "points" else "int", "x": "double" if out == "points" else "int", "label": "long"}
    fields = [f"{c} {pixels.schema[c].dataType.simpleString()}" for c in iterate] + [f"{c} {kinds.get(c, 'double')}" for c in names]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        plane = np.zeros((y.max() + 1, x.max() + 1))
        plane[y, x] = rows[value]
        made = np.asarray(fn(plane))
        if out in ("image", "labels"):
            yy, xx = np.nonzero(made) if out == "labels" else (i.reshape(-1) for i in np.indices(made.shape))
            found = {"y": yy, "x": xx, names[2]: made[yy, xx]}
        elif out == "scalar":
            found = {"value": [float(made)]}
        else:
            found = dict(zip(names, np.asarray(made, float).reshape(-1, len(names)).T, strict=True))
        done = pd.DataFrame(found)
        for c, k in zip(iterate, key, strict=True):
            done[c] = k
        return done[[*iterate, *names]]

    done = pixels.groupBy(*iterate).applyInPandas(run, ", ".join(fields))
    slices = [c for c in iterate if c != "image_id"]
    return renumber(done, slices) if out == "labels" and slices and "image_id" in iterate else done
