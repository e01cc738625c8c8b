"""Exact histogram of encoded lengths, with suffix sums for every context limit.

Documents are reduced to (group, length) counts on the map side, so no stage
after the encoding sees more rows than there are different lengths. Suffix sums
over that histogram then answer, for any limit L: how many documents reach it,
how many tokens they hold, and the total if each document is cut at L.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged

#: Lengths that are summed together before the suffix sums over such spans.
SPAN = 256


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The byte-level BPE of a rank file, read once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and n_tokens of each whole text; null text has no tokens."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), "n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())], [*(f"c{i}" for i in range(len(rest))), "n_tokens"])

    return docs.select(F.col(text), *keep).mapInArrow(count, schema).toDF(*keep, "n_tokens")


def length_histogram(lengths: DataFrame, group: str = "source", span: int = SPAN) -> DataFrame:
    """From rows (group, n_tokens): a row for each length that occurs, in each group and over all.

    scope is 'group' or 'all' (then ``group`` is null); docs and tokens have this
    very length; docs_from and tokens_from this length or more; truncated_total is
    the sum over the scope of min(length, n_tokens); docs_upto and share_upto count
    lengths up to it. A null group is a group. An empty table gives no rows.
    """
    # one exploded row a document and scope would double the input: roll up the histogram instead
    counts = staged(lengths.groupBy(F.col(group).alias("group"), "n_tokens").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    both = counts.select(F.lit("group").alias("scope"), "group", "n_tokens", "docs").unionByName(
        counts.groupBy("n_tokens").agg(F.sum("docs").alias("docs")).select(F.lit("all").alias("scope"), F.lit(None).cast(counts.schema["group"].dataType).alias("group"), "n_tokens", "docs")
    )
    key = ["scope", "group"]
    both = both.withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("span", F.floor(F.col("n_tokens") / span))
    # suffix sums in two steps, so no task orders more than the spans of a scope or the lengths of a span
    spans = both.groupBy(*key, "span").agg(F.sum("docs").alias("sd"), F.sum("tokens").alias("st"))
    later = Window.partitionBy(*key).orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    spans = spans.select(
        *(F.col(k).alias(f"s_{k}") for k in [*key, "span"]),
        F.coalesce(F.sum("sd").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("st").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("sd").over(whole).alias("all_docs"), F.sum("st").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy(*key, "span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("d", F.sum("docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in [*key, "span"]]
    out = rows.join(spans, same[0] & same[1] & same[2]).withColumn("docs_from", F.col("d") + F.col("later_docs")).withColumn("tokens_from", F.col("t") + F.col("later_tokens"))
    upto = F.col("all_docs") - F.col("docs_from") + F.col("docs")
    return out.select(
        "scope", F.col("group").alias(group), "n_tokens", "docs", "tokens", "docs_from", "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        upto.alias("docs_upto"), (upto / F.col("all_docs")).alias("share_upto"),
    )


def at_limits(histogram: DataFrame, limits: list[int], group: str = "source") -> DataFrame:
    """For each scope and limit: documents, tokens, truncated_total, and documents longer than the limit."""
    some = histogram.groupBy("scope", group).agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"),
        F.array(*(
            F.struct(F.lit(x).cast("long").alias("limit"), F.sum(F.col("docs") * F.least("n_tokens", F.lit(x))).alias("truncated_total"), F.sum(F.when(F.col("n_tokens") > x, F.col("docs")).otherwise(0)).alias("docs_cut"))
            for x in limits
        )).alias("at"),
    )
    return some.select("scope", group, "docs", "tokens", F.explode("at").alias("x")).select("scope", group, "docs", "tokens", "x.*")


def quantiles(histogram: DataFrame, shares: list[float], group: str = "source") -> DataFrame:
    """For each scope, the least length that at least this share of its documents don't exceed."""
    return histogram.groupBy("scope", group).agg(*(F.min(F.when(F.col("share_upto") >= q, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares))


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["source"])
    return length_histogram(lengths)


QUERIES = {"op2_length_histogram": op2_length_histogram}
SQL: dict[str, str] = {}
