"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, the last one their
token ids. What a stage returns is written as Parquet before the next one reads it. Extra columns
of the documents are carried along. Nulls, empty texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.llm import bpe, decontaminate, near_copies, simhash, toxicity, units
from zonetide.llm.common import stored, table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. The model is learned from labelled rows among them."""
    return toxicity.filter_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in shingles of five words."""
    return simhash.one_of_each(docs, near_copies.grouped)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines and passages that an earlier one has; ``n_chars`` is counted anew."""
    left = units.remove_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the token ids of each document, with their number and digests."""
    vocabulary = bpe.default_vocabulary()
    texts = docs.select("doc_id", "text")
    lexicon = bpe.frequent_lexicon(texts, vocabulary)
    return bpe.encode(texts, vocabulary, lexicon).drop("text")


STAGES = [
    ("toxicity", keep_civil),
    ("simhash_near_dedup", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", keep_uncontaminated),
    ("bpe", to_tokens),
]

#: SQL can express neither the toxicity model nor token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
