"""Mixing sources to target weights by temperature (built-in column functions only).

Token shares p of the sources are raised to an exponent and normalised. The
exponent is the largest in [0, 1] whose weights reach a target entropy, unless a
source would then repeat more often than allowed, in which case it is the
smallest that keeps the limit. The weights are realised under a token budget:
whole epochs of a source, then a prefix of its blocks in a pseudo-random
permutation, then of the documents of one last block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.functions.staging import fresh, staged
from pixelweave.llm.text import words

#: Target entropy as a share of the largest possible one, the log of the number of sources.
ENTROPY_SHARE = 0.95
#: Most times that a source's documents may appear on average.
MAX_REPEATS = 4.0
#: Each round divides the bracket of the exponent by this.
PARTS, ROUNDS = 32, 5


def _key(*parts: Column) -> Column:
    """A number in [0, 2^32) from text, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def exponent(sources: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_share: float = 1.0) -> float:
    """The exponent for (source, tokens) rows with tokens > 0.

    A grid over the bracket is judged in one aggregate a round, so the sources
    stay distributed and the driver sees ``PARTS`` numbers. Entropy falls and the
    largest repetition too as the exponent grows.
    """
    n, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def judged(low: float, high: float) -> list:
        grid = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        rows = sources.select(share.alias("p"), F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a"))
        # repeats of a source: budget * weight / tokens = budget_share * p^(a - 1) / z
        sums = rows.groupBy("i", "a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.ln("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("r"))
        return sorted(sums.select("i", "a", (F.ln("z") - F.col("a") * F.col("s") / F.col("z")).alias("h"), (F.col("r") * budget_share / F.col("z")).alias("r")).collect())

    target = entropy_share * math.log(n)

    def search(reached) -> float:
        """The last grid point of a run from 0 at which ``reached`` holds, refined."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = judged(low, high)
            good = [x for x in rows if reached(x)]
            if not good:
                return low
            last = good[-1]
            if last["i"] == PARTS:
                return last["a"]
            low, high = last["a"], rows[last["i"] + 1]["a"]
        return low

    by_entropy = search(lambda x: x["h"] >= target)
    # the last point that still repeats too much; the limit holds from there on
    first = judged(by_entropy, 1.0)[0]
    if first["r"] <= max_repeats:
        return by_entropy
    return search(lambda x: x["r"] > max_repeats)




def _sized(docs: DataFrame, doc_id: str, source: str, text: str) -> list[Column]:
    key = _key(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.size(words(F.col(text))).cast("long").alias("n_tokens"), key.alias("k")]


def block_plan(sized: DataFrame, entropy_share: float, max_repeats: float, budget_share: float) -> tuple[DataFrame, DataFrame]:
    """Plans of sources (source, n_blocks, weight, epochs, rest) and of blocks (source, block, full, left).

    A source has as many blocks as the root of its documents, so neither the
    order of its blocks nor that of a block's documents grows with the source.
    ``full`` blocks get one copy more; the one block with ``left`` > 0 gets it
    for a prefix of its documents.
    """
    sources = staged(sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")
    filled = sources.where("tokens > 0")
    total = filled.agg(F.sum("tokens")).first()[0] or 0
    a = exponent(filled, entropy_share, max_repeats, budget_share)
    z = filled.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)) / F.lit(z)).otherwise(0.0)
    want = F.floor(F.col("weight") * F.lit(float(total) * budget_share)).cast("long")
    plan = (
        sources.withColumn("n_blocks", F.ceil(F.sqrt("docs")).cast("long")).withColumn("weight", weight).withColumn("want", want)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("want div tokens")).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("want") % F.col("tokens")).otherwise(0).cast("long"))
        .select("source", "n_blocks", "weight", "epochs", "rest")
    )
    sums = sized.join(plan, "source").groupBy("source", (F.col("k") % F.col("n_blocks")).alias("block"), "rest").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy(_key(F.col("source"), F.col("block").cast("string")), "block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    blocks = sums.withColumn("left", left).select(
        "source", "block", (F.col("left") >= F.col("tokens")).alias("full"), F.when((F.col("left") > 0) & (F.col("left") < F.col("tokens")), F.col("left")).otherwise(0).alias("left")
    )
    return staged(plan, "plan"), staged(blocks, "blocks")


def _repeats(sized: DataFrame, plan: DataFrame, blocks: DataFrame) -> DataFrame:
    """``sized`` rows with weight, block and repeats."""
    placed = sized.join(plan, "source").withColumn("block", F.col("k") % F.col("n_blocks")).join(blocks, ["source", "block"])
    # only the blocks that the budget cuts are ordered
    order = Window.partitionBy("source", "block").orderBy("k", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.where("left = 0").withColumn("more", F.col("full").cast("long"))
    cut = placed.where("left > 0").withColumn("more", (F.sum("n_tokens").over(order) <= F.col("left")).cast("long"))
    return whole.unionByName(cut).withColumn("repeats", F.col("epochs") + F.col("more"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_share: float = 1.0) -> DataFrame:
    """Per row of ``docs``: doc_id, source, n_tokens (words), weight of its source, block, repeats.

    The budget is ``budget_share`` of all tokens. Null text has no tokens, a null
    source is the source ''. Texts without tokens cost nothing of the budget; a
    source of such texts alone has weight 0 and stays once. An empty table gives no rows. Rows of the same id count one by one.
    """
    sized = staged(docs.select(*_sized(docs, doc_id, source, text)), "sized")
    plan, blocks = block_plan(sized, entropy_share, max_repeats, budget_share)
    return _repeats(sized, plan, blocks).select("doc_id", "source", "n_tokens", "weight", "block", "repeats")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_share: float = 1.0) -> DataFrame:
    """``docs`` realised: each row as often as ``mixture`` says, with the columns of ``docs``.

    The plan is made from sizes alone; the rows meet it by source and block.
    """
    row, n = fresh(docs, "mixing"), fresh(docs, "mixing_copy")
    sized = staged(docs.select(*_sized(docs, doc_id, source, text)), "sized")
    plan, blocks = block_plan(sized, entropy_share, max_repeats, budget_share)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), *_sized(docs, doc_id, source, text))
    out = _repeats(whole, plan, blocks).where("repeats > 0").withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return out.select(f"{row}.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "block", "repeats")


def _exponent_sql() -> str:
    """CTEs e0..: the search of ``exponent`` over relation s(source, docs, tokens, p)."""
    parts = ["tgt AS (SELECT %s * ln(count(*)) AS h, count(*) AS n FROM s)" % ENTROPY_SHARE]
    grid = lambda name, low: f"""{name}g AS (SELECT i, low + (high - low) * i / {PARTS} AS a, low, high FROM {low}, range({PARTS + 1}) t(i)),
{name}j AS (SELECT i, a, ln(sum(pow(p, a))) - a * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) AS h, max(pow(p, a - 1)) / sum(pow(p, a)) AS r FROM {name}g, s GROUP BY i, a)"""  # noqa: E731
    for kind, good in (("h", "h >= (SELECT h FROM tgt)"), ("r", f"r > {MAX_REPEATS}")):
        parts.append(f"{kind}0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high)")
        for k in range(1, ROUNDS + 1):
            name = f"{kind}{k}"
            parts.append(grid(name, f"{kind}{k - 1}"))
            parts.append(f"""{name} AS (SELECT coalesce(max(CASE WHEN i = b.best THEN a END), min(a)) AS low,
  coalesce(max(CASE WHEN i = least(b.best + 1, {PARTS}) THEN a END), min(a)) AS high
  FROM {name}j, (SELECT max(i) AS best FROM {name}j WHERE {good}) b)""")
    parts.append("ha AS (SELECT CASE WHEN (SELECT n FROM tgt) <= 1 THEN 1.0 ELSE low END AS a FROM h%d)" % ROUNDS)
    parts.append("hr AS (SELECT max(pow(p, a - 1)) / sum(pow(p, a)) AS r FROM s, ha)")
    parts.append(f"ex AS (SELECT CASE WHEN (SELECT n FROM tgt) <= 1 OR (SELECT r FROM hr) <= {MAX_REPEATS} THEN (SELECT a FROM ha) ELSE (SELECT low FROM r{ROUNDS}) END AS a)")
    return ",\n".join(parts)


def _key_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


QUERIES = {"op6_source_mixing": op6_source_mixing}
SQL = {
    "op6_source_mixing": rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, {_key_sql("coalesce(doc_id::VARCHAR, '')")} AS k FROM documents),
s0 AS (SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
tot AS (SELECT sum(tokens)::BIGINT AS total FROM s0 WHERE tokens > 0),
s AS (SELECT source, docs, tokens, tokens / (SELECT total FROM tot)::DOUBLE AS p FROM s0 WHERE tokens > 0),
{_exponent_sql()},
z AS (SELECT sum(pow(p, a)) AS z FROM s, ex),
pl AS (SELECT s0.source, ceil(sqrt(s0.docs))::BIGINT AS n_blocks, s0.tokens, coalesce(pow(s.p, ex.a) / z.z, 0.0) AS weight,
  floor(coalesce(pow(s.p, ex.a) / z.z, 0.0) * (SELECT total FROM tot)::DOUBLE)::BIGINT AS want
  FROM s0 LEFT JOIN s USING (source), ex, z),
pb AS (SELECT source, n_blocks, weight, CASE WHEN tokens > 0 THEN want // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN want % tokens ELSE 0 END AS rest FROM pl),
b AS (SELECT source, k % n_blocks AS block, rest, sum(n_tokens)::BIGINT AS tokens FROM d JOIN pb USING (source) GROUP BY ALL),
o AS (SELECT *, rest - coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY {_key_sql("source || '|' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b),
m AS (SELECT d.*, weight, epochs, block, room, o.tokens, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN pb USING (source) JOIN o ON o.source = d.source AND o.block = d.k % pb.n_blocks)
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, block,
  (epochs + CASE WHEN room >= tokens THEN 1 WHEN room > 0 AND run <= room THEN 1 ELSE 0 END)::BIGINT AS repeats FROM m"""
}
