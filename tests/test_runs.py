"""Components on runs against a flood of pixels, holes of nuclei, and numbers by ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions.ranks import ranked
from pixelweave.operators import components, tissue


def flood(points, full):
    """Point -> number of its component, in raster order of first points."""
    left, found, n = set(points), {}, 0
    for p in sorted(points):
        if p in left:
            n, todo = n + 1, [p]
            left.discard(p)
            while todo:
                q = todo.pop()
                found[q] = n
                for o in np.ndindex(*(3,) * len(p)):
                    o = tuple(v - 1 for v in o)
                    r = tuple(a + b for a, b in zip(q, o, strict=True))
                    if r in left and (full or sum(map(abs, o)) == 1):
                        left.discard(r)
                        todo.append(r)
    return found


@pytest.mark.parametrize("connectivity", ["full", "edge"])
@pytest.mark.parametrize("dims", [2, 3])
def test_components_by_runs_equal_a_flood(spark, connectivity, dims):
    rng = random.Random(dims)
    shape, names = ((40, 37), ("y", "x")) if dims == 2 else ((7, 14, 15), ("z", "y", "x"))
    share = {1: 0.5, 2: 0.3, 3: 0.62}
    masks = {i: [p for p in map(tuple, np.ndindex(*shape)) if rng.random() < share[i]] for i in (1, 2, 3)}
    rows = [(i, *map(int, p)) for i, ps in masks.items() for p in ps]
    df = spark.createDataFrame(rows + rows[:50], "image_id long, " + ", ".join(f"{c} int" for c in names))
    for tile in (5, 64):
        got = {(r["image_id"], *(r[c] for c in names)): r["label"] for r in components.label(df, connectivity=connectivity, tile=tile).collect()}
        want = {(i, *p): n for i, ps in masks.items() for p, n in flood(ps, connectivity == "full").items()}
        assert got == want


def test_runs_leave_nothing_and_repeat_nothing(spark):
    rows = [(1, 0, x) for x in (0, 1, 2, 2, 5, 7, 8)] + [(1, 1, 3), (2, 0, 9)]
    got = components.to_runs(spark.createDataFrame(rows, "image_id long, y int, x int"), ["image_id"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 2), (1, 0, 5, 5), (1, 0, 7, 8), (1, 1, 3, 3), (2, 0, 9, 9)]
    with pytest.raises(Exception, match="is not in"):
        components.label(spark.createDataFrame([(1, 0, -1)], "image_id long, y int, x int")).collect()


def test_holes_of_nuclei_by_runs(spark):
    rng = random.Random(4)
    masks = {i: [(y, x) for y in range(26) for x in range(23) if rng.random() < share] for i, share in ((1, 0.45), (2, 0.6), (3, 0.75))}
    masks[4] = [(y, x) for y in range(20) for x in range(20) if max(abs(y - 9), abs(x - 9)) in (8, 4)]  # a ring in a ring
    want = set()
    for i, points in masks.items():
        parts = flood(points, True)
        sizes = {}
        for n in set(parts.values()):
            own = {p for p, k in parts.items() if k == n}
            ys, xs = [p[0] for p in own], [p[1] for p in own]
            box = [(y, x) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1)]
            free = flood([p for p in box if p not in own], False)
            open_ = {k for (y, x), k in free.items() if y in (min(ys), max(ys)) or x in (min(xs), max(xs))}
            sizes[n] = (len(own), len(own) + sum(k not in open_ for k in free.values()))
        good = {n: s for n, s in sizes.items() if s[1] >= 3}
        want |= {(i, n, *s, len(good)) for n, s in good.items()}
    df = spark.createDataFrame([(i, y, x, 1) for i, ps in masks.items() for y, x in ps], "image_id long, y int, x int, kind int")
    for tile in (6, 64):
        assert {tuple(r) for r in tissue.nuclei(df, 3, tile).collect()} == want


def test_numbers_by_ranges_spread_a_huge_key(spark):
    rng = random.Random(2)
    rows = [(1 if k < 3000 else rng.randrange(6), k, rng.choice("ab")) for k in range(4000)] + [(None, -1, "z")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "image_id long, v long, part string").repartition(7)
    out = ranked(df, ["image_id"], [F.col("v").desc()])
    order = {}
    for i, v, _ in sorted(rows, key=lambda r: -r[1]):
        order.setdefault(i, []).append(v)
    got = {(r["image_id"], r["v"]): r["rank"] for r in out.where("image_id IS NOT NULL").collect()}
    assert got == {(i, v): k + 1 for i, vs in order.items() if i is not None for k, v in enumerate(vs)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "image_id" not in "".join(line for line in plan.splitlines() if "Window" in line)
    assert spark.createDataFrame([], df.schema).count() == ranked(df.limit(0), ["image_id"], ["v"]).count() == 0
