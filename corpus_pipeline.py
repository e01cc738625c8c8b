"""Quality rules, near-duplicate removal, source mixing and encoding over the documents table.

Stages take empty tables (no rows come out) and columns of any further names, which all but the last hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.functions.staging import staged
from pixelweave.llm import host_quality, near_dedup, piece_codec, source_mixing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go.

    Null and empty texts fail; a null source counts as the empty one; repeated rows and null ids stand for themselves.
    """
    return host_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8), that of the smallest id.

    Rows of one id are one document and stay together; texts without words are linked with nothing; rows with a null id are left as they are.
    """
    return near_dedup.keep_first(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weight of its source asks, under the budget of all tokens.

    A null source counts as the empty one, and a null text as the empty text.
    """
    return source_mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each row, as counts and digests: a row each, repeated ones too; a null or empty text has the end id alone."""
    return piece_codec.encode_documents(docs, piece_codec.default_model())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("source mixing", source_weights),
    ("piece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs


#: The near-duplicate groups and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
