"""Boxes: (image_id, box_id, min_y, min_x, max_y, max_x, score), half-open; conversions, IoU and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.staging import spread, staged

SIDES = ("min_y", "min_x", "max_y", "max_x")


def as_boxes(rows: DataFrame) -> DataFrame:
    """The four sides as floats; a missing side is an error."""
    if missing := [c for c in SIDES if c not in rows.columns]:
        raise ValueError(f"no {missing} among {rows.columns}")
    return rows.withColumns({c: F.col(c).cast("float") for c in SIDES})


def from_xyxy(rows: DataFrame, names: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    x0, y0, x1, y1 = names
    return rows.withColumnsRenamed({y0: "min_y", x0: "min_x", y1: "max_y", x1: "max_x"})


def to_xyxy(boxes: DataFrame, names: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    x0, y0, x1, y1 = names
    return boxes.withColumnsRenamed({"min_y": y0, "min_x": x0, "max_y": y1, "max_x": x1})


def to_corners(boxes: DataFrame) -> DataFrame:
    """With ``corners``: the least and the largest corner as (y, x)."""
    pair = lambda y, x: F.struct(F.col(y).alias("y"), F.col(x).alias("x"))
    return boxes.withColumn("corners", F.array(pair("min_y", "min_x"), pair("max_y", "max_x"))).drop(*SIDES)


def from_vertices(rows: DataFrame, vertices: str = "corners") -> DataFrame:
    """Boxes around any list of (y, x) vertices."""
    side = lambda pick, axis: pick(F.transform(vertices, lambda v: v[axis]))
    return rows.withColumns({
        "min_y": side(F.array_min, "y"), "min_x": side(F.array_min, "x"), "max_y": side(F.array_max, "y"), "max_x": side(F.array_max, "x"),
    }).drop(vertices)


#: The finest level of the grid has cells of this many pixels, the next ones twice as many each.
FINEST = 16


def slices(*tables: DataFrame) -> list[str]:
    """image_id and the slice columns (t, c, z) that all of the tables have."""
    return ["image_id", *(c for c in ("t", "c", "z") if all(c in x.columns for x in tables))]


def _level() -> Column:
    """The level of the grid whose cells are as large as a box: there it lies in two cells at most along an axis."""
    side = F.greatest(F.col("max_y") - F.col("min_y"), F.col("max_x") - F.col("min_x"), F.lit(1)).cast("double")
    return F.greatest(F.lit(0), F.ceil(F.log2(side / FINEST) - 1e-12)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value.cast("double") / (F.pow(F.lit(2.0), level) * FINEST)).cast("long")


def _placed(boxes: DataFrame, level: str = "level") -> DataFrame:
    """A row for each of the cells (four at most) of a level, its own or a coarser one, that a box reaches."""
    def along(side: str) -> Column:
        size = F.pow(F.lit(2.0), F.col(level)) * FINEST
        first = _cell(F.col(f"min_{side}"), F.col(level))
        return F.explode(F.sequence(first, F.greatest(first, (F.ceil(F.col(f"max_{side}").cast("double") / size) - 1).cast("long"))))

    return boxes.withColumn("cell_y", along("y")).withColumn("cell_x", along("x"))


def _levels(boxes: DataFrame, per: list[str]) -> DataFrame:
    """(key, levels): those that an image's boxes have, some thirty at most."""
    return boxes.groupBy(*per).agg(F.collect_set(_level()).alias("levels"))


def box_pixels(boxes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels inside each box: a join on the cells of each box's own level, then the exact test.

    A box has four rows at most, whatever its size, and a pixel one for each level
    that boxes of its image have. Slice columns (t, c, z) that both tables have must agree.
    """
    per = slices(boxes, pixels)
    spread = _placed(boxes.select(*per, "box_id", *SIDES).withColumn("level", _level()))
    near = pixels.join(_levels(boxes, per), per).withColumn("level", F.explode("levels")).drop("levels")
    near = near.withColumn("cell_y", _cell(F.col("y"), F.col("level"))).withColumn("cell_x", _cell(F.col("x"), F.col("level")))
    inside = (F.col("y") >= F.col("min_y")) & (F.col("y") < F.col("max_y")) & (F.col("x") >= F.col("min_x")) & (F.col("x") < F.col("max_x"))
    return near.join(spread, [*per, "level", "cell_y", "cell_x"]).where(inside).drop("level", "cell_y", "cell_x", *SIDES)


def equals(boxes: DataFrame, per: list[str]) -> tuple[DataFrame, DataFrame]:
    """(firsts, members): a box (per, box_id, sides) for each set of equal boxes, that of the least box_id, and (per, first, box_id) of all.

    What depends on a box's sides alone is found once for a set of copies.
    """
    own = staged(boxes.select(*per, "box_id", *SIDES), "boxes")
    firsts = own.groupBy(*per, *SIDES).agg(F.min("box_id").alias("box_id")).select(*per, "box_id", *SIDES)
    same = F.lit(True)
    for c in (*per, *SIDES):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    # a set has one row on the right and all its members on the left
    firsts = staged(firsts, "firsts")
    members = own.alias("l").join(firsts.alias("r"), same).select(*(F.col(f"l.{c}").alias(c) for c in per), F.col("r.box_id").alias("first"), F.col("l.box_id").alias("box_id"))
    return firsts, staged(members, "members")


#: Boxes of a list, and members of a set of equal boxes that meet those of another one in one task.
LISTED, TOGETHER = 1024, 8192


def iou_pairs(boxes: DataFrame, least: float = 0.0, per: list[str] | None = None) -> DataFrame:
    """(key, a, b, iou) of boxes that overlap, a < b.

    Equal boxes are compared once, and their pairs are made only for sets that pass ``least``, so work goes with
    the different boxes and the pairs that come out. Where all boxes are copies these are as the square of their number;
    members move as lists, and their pairs are made behind the last shuffle, so they are never on a disk.
    """
    per = per or ["image_id"]
    firsts, members = equals(boxes, per)
    apart = _iou_pairs(firsts, least, per)
    # a set's pairs with itself: a box of some area has an IoU of 1 with its copies
    solid = (F.col("max_y") > F.col("min_y")) & (F.col("max_x") > F.col("min_x"))
    own = firsts.where(solid & F.lit(least < 1.0)).select(*per, F.col("box_id").alias("a"), F.col("box_id").alias("b"), F.lit(1.0).alias("iou"))
    sets = staged(apart.unionByName(own), "sets").withColumnsRenamed({"a": "first_a", "b": "first_b"})
    # the sets that are more than one list, as those of two are met in tasks by parts of both
    large = staged(members.groupBy(*per, "first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LISTED), "large")
    listed = F.ceil(F.coalesce("n", F.lit(1)) / LISTED)
    lists = members.join(F.broadcast(large), [*per, "first"], "left").withColumn("k", F.pmod(F.xxhash64("box_id"), listed))
    lists = staged(lists.groupBy(*per, "first", "k").agg(F.collect_list("box_id").alias("ids")), "lists")
    for end, name in (("a", "down"), ("b", "across")):
        sets = sets.join(F.broadcast(large.withColumnRenamed("first", f"first_{end}")), [*per, f"first_{end}"], "left")
        sets = sets.withColumn(name, F.ceil(F.coalesce("n", F.lit(1)) / TOGETHER)).drop("n")
    cell = [*per, "first_a", "first_b", "i", "j"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = sets.join(lists.withColumnsRenamed({"first": "first_a", "ids": "ids_a"}), [*per, "first_a"])
    one = one.select(*per, "first_a", "first_b", F.pmod("k", "down").alias("i"), every("across").alias("j"), "iou", "ids_a")
    two = sets.join(lists.withColumnsRenamed({"first": "first_b", "ids": "ids_b"}), [*per, "first_b"])
    two = two.select(*per, "first_a", "first_b", every("down").alias("i"), F.pmod("k", "across").alias("j"), "ids_b")
    both = spread(one, *cell).join(two, cell).withColumn("a", F.explode("ids_a")).withColumn("b", F.explode("ids_b"))
    both = both.where((F.col("first_a") != F.col("first_b")) | (F.col("a") < F.col("b")))
    return both.select(*per, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "iou")


def _iou_pairs(boxes: DataFrame, least: float, per: list[str]) -> DataFrame:
    """``iou_pairs`` of boxes that all differ.

    A box lies in the cells of its own level and looks into those of its own and
    each coarser level of its image; a pair counts in the cell of its common corner alone.
    """
    own = boxes.select(*per, F.col("box_id").alias("a"), *SIDES).withColumn("own", _level())
    two = _placed(own.withColumnRenamed("own", "level")).withColumnsRenamed({"a": "b", **{s: f"o_{s}" for s in SIDES}})
    one = _placed(own.join(_levels(boxes, per), per).withColumn("level", F.explode("levels")).drop("levels").where("level >= own"))
    top, left = F.greatest("min_y", "o_min_y"), F.greatest("min_x", "o_min_x")
    h, w = F.least("max_y", "o_max_y") - top, F.least("max_x", "o_max_x") - left
    both = one.join(two, [*per, "level", "cell_y", "cell_x"]).where((F.col("own") < F.col("level")) | (F.col("a") < F.col("b"))).where((h > 0) & (w > 0))
    both = both.where((_cell(top, F.col("level")) == F.col("cell_y")) & (_cell(left, F.col("level")) == F.col("cell_x")))
    area: Column = (F.col("max_y") - F.col("min_y")) * (F.col("max_x") - F.col("min_x")) + (F.col("o_max_y") - F.col("o_min_y")) * (F.col("o_max_x") - F.col("o_min_x"))
    iou = (h * w).cast("double") / F.nullif(area - h * w, F.lit(0))
    return both.select(*per, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), iou.alias("iou")).where(F.col("iou") > least)


def nms(boxes: DataFrame, conf: float = 0.4, iou: float = 0.9, max_det: int | None = 300, per: list[str] | None = None) -> DataFrame:
    """Boxes of score >= conf; of two with more than ``iou`` in common, the better stays; at most max_det an image.

    Equal scores go by box_id. Of equal boxes (with an area, and ``iou`` below 1) only the best can stay, as what
    beats it beats its copies, so the others go at once. In rounds over the pairs that overlap enough: a box
    without a better live neighbour stays and its neighbours go, until no pair is
    live. Each round is staged, so no image's boxes need to be in one task.
    """
    per = per or ["image_id"]
    good = boxes.where(F.col("score") >= conf)
    if iou < 1:
        solid = (F.col("max_y") > F.col("min_y")) & (F.col("max_x") > F.col("min_x"))
        best = good.where(solid).groupBy(*per, *SIDES).agg(F.max_by(F.struct(*good.columns), F.struct("score", -F.col("box_id"))).alias("best"))
        good = best.select("best.*").unionByName(good.where(~F.coalesce(solid, F.lit(False))))
    good = staged(good, "good")
    scores = good.select(*per, "box_id", "score")
    pairs = iou_pairs(good, iou, per=per)
    for end in ("a", "b"):
        pairs = pairs.join(scores.withColumnsRenamed({"box_id": end, "score": f"score_{end}"}), [*per, end])
    first = (F.col("score_a") > F.col("score_b")) | ((F.col("score_a") == F.col("score_b")) & (F.col("a") < F.col("b")))
    live = staged(pairs.select(*per, F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("box_id")), "pairs")
    gone = None
    while live.limit(1).count():
        beaten = live.select(*per, "box_id").distinct()
        stays = live.select(*per, F.col("better").alias("box_id")).distinct().join(beaten, [*per, "box_id"], "left_anti").withColumnRenamed("box_id", "better")
        out = staged(live.join(stays, [*per, "better"], "left_semi").select(*per, "box_id").distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        live = live.join(out, [*per, "box_id"], "left_anti").join(out.withColumnRenamed("box_id", "better"), [*per, "better"], "left_anti")
        live = staged(live.join(stays, [*per, "better"], "left_anti"), "pairs")
    kept = good if gone is None else good.join(gone, [*per, "box_id"], "left_anti")
    if max_det is None:
        return kept
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("score"), "box_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= max_det).drop("rank")
