"""Image tables derived from fact tables; each with the SQL that gives the same rows.

pixels: image_id, [c], [z], y, x, value; labels and masks hold set pixels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _square(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return cells.select(F.col("vec_id").alias("image_id"), F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), value.alias("value"))


def px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images of integer values, one a vector."""
    return _square(spark, sf_dir, F.floor((F.col("e").cast("double") + 1) * 127.5).cast("double"))


def px8f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the numbers of the vector."""
    return _square(spark, sf_dir, F.col("e").cast("double"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-channel 8 x 8 images from three vectors each; an incomplete last image is dropped."""
    px = px8(spark, sf_dir)
    whole = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 3").alias("image_id")).agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("image_id")
    split = px.select(F.expr("image_id div 3").alias("image_id"), (F.col("image_id") % 3).cast("int").alias("c"), "y", "x", "value")
    return split.join(whole, "image_id")


def rasterize(facts: DataFrame, keys: list[str], grid: DataFrame) -> DataFrame:
    """Counts of facts by pixel on a grid; pixels without facts are 0."""
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return grid.join(counts, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))


VOL_SHAPE = (10, 7, 32, 32)


def vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten volumes of 7 x 32 x 32 counts of line items (z from 1)."""
    images, planes, h, w = VOL_SHAPE
    facts = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % images).cast("long").alias("image_id"), F.col("l_linenumber").cast("int").alias("z"),
        (F.col("l_partkey") % h).cast("int").alias("y"), (F.floor("l_quantity") % w).cast("int").alias("x"),
    )
    i = F.col("id")
    grid = spark.range(images * planes * h * w).select(
        F.expr(f"id div {planes * h * w}").alias("image_id"), (F.expr(f"id div {h * w}") % planes + 1).cast("int").alias("z"),
        (F.expr(f"id div {w}") % h).cast("int").alias("y"), (i % w).cast("int").alias("x"),
    )
    return rasterize(facts, ["image_id", "z", "y", "x"], grid)


def _disc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (p % 20).cast("long").alias("image_id"), F.expr("p_partkey div 20").cast("int").alias("mask_id"),
        (p * 37 % 64).cast("int").alias("cy"), (p * 53 % 64).cast("int").alias("cx"), (F.col("p_size") % 6 + 2).cast("int").alias("r"),
    )


def _fill(discs: DataFrame, keep: list[str]) -> DataFrame:
    reach = F.sequence(F.lit(-7), F.lit(7))
    # a part of some ten bytes becomes 225 rows, so parts are dealt to all tasks first
    cells = discs.repartition(*discs.columns).withColumn("dy", F.explode(reach)).withColumn("dx", F.explode(reach)).where("dy * dy + dx * dx <= r * r")
    return cells.select(*keep, (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x")).where("y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63")


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks: set pixels of discs on 64 x 64 images."""
    return _fill(_disc_rows(spark, sf_dir), ["image_id", "mask_id"])


def disc_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on four planes: the discs moved a little and renumbered from plane to plane, the largest on top."""
    moved = _disc_rows(spark, sf_dir).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(3))))
    moved = moved.select("image_id", "z", (F.col("mask_id").bitwiseXOR(F.col("z")) + 1).alias("label"), (F.col("cy") + F.col("z")).alias("cy"), (F.col("cx") + F.col("z")).alias("cx"), "r")
    return _fill(moved, ["image_id", "z", "label"]).groupBy("image_id", "z", "y", "x").agg(F.max("label").alias("label"))


def psf_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("int").alias("psf_id"), (F.col("p_size") % 5 * 2 + 7).cast("int").alias("xy_dim"), (F.col("p_size") % 3 + 1).cast("double").alias("xy_sigma"))


_CELLS = "(SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_DISCS = "SELECT p_partkey % 20 AS image_id, p_partkey // 20 AS mask_id, p_partkey * 37 % 64 AS cy, p_partkey * 53 % 64 AS cx, p_size % 6 + 2 AS r FROM part"
_REACH = "range(-7, 8) a(dy), range(-7, 8) b(dx)"

#: The same tables as common table expressions.
SQL = {
    "px8": f"px8 AS (SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, floor((e::DOUBLE + 1) * 127.5) AS value FROM {_CELLS})",
    "px8f": f"px8f AS (SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, e::DOUBLE AS value FROM {_CELLS})",
    "rgb": f"""rgb AS (SELECT vec_id // 3 AS image_id, (vec_id % 3)::INT AS c, (i // 8)::INT AS y, (i % 8)::INT AS x, floor((e::DOUBLE + 1) * 127.5) AS value FROM {_CELLS}
  WHERE vec_id // 3 IN (SELECT vec_id // 3 FROM embeddings GROUP BY 1 HAVING count(*) = 3))""",
    "vol": """vol AS (SELECT g.image_id, g.z::INT AS z, g.y::INT AS y, g.x::INT AS x, coalesce(n, 0)::DOUBLE AS value
  FROM (SELECT * FROM range(10) i(image_id), range(1, 8) j(z), range(32) k(y), range(32) l(x)) g
  LEFT JOIN (SELECT l_suppkey % 10 AS image_id, l_linenumber AS z, l_partkey % 32 AS y, floor(l_quantity)::BIGINT % 32 AS x, count(*) AS n FROM lineitem GROUP BY ALL) f
  ON g.image_id = f.image_id AND g.z = f.z AND g.y = f.y AND g.x = f.x)""",
    "discs": f"""discs AS (SELECT image_id, mask_id::INT AS mask_id, (cy + dy)::INT AS y, (cx + dx)::INT AS x FROM ({_DISCS}), {_REACH}
  WHERE dy * dy + dx * dx <= r * r AND cy + dy BETWEEN 0 AND 63 AND cx + dx BETWEEN 0 AND 63)""",
    "disc_stack": f"""disc_stack AS (SELECT image_id, z::INT AS z, y::INT AS y, x::INT AS x, max(label)::INT AS label FROM (
  SELECT image_id, z, xor(mask_id::INT, z::INT) + 1 AS label, cy + z + dy AS y, cx + z + dx AS x, r, dy, dx FROM ({_DISCS}), range(4) t(z), {_REACH})
  WHERE dy * dy + dx * dx <= r * r AND y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 GROUP BY ALL)""",
    "psf_settings": "psf_settings AS (SELECT p_partkey::INT AS psf_id, (p_size % 5 * 2 + 7)::INT AS xy_dim, (p_size % 3 + 1)::DOUBLE AS xy_sigma FROM part)",
}


def with_sql(names: str, query: str) -> str:
    """``query`` after the tables of these names."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + ("," if query.lstrip()[:1] == "," else "") + "\n" + query.lstrip(", \n")
