"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes documents (doc_id, text, lang, source, n_chars; any others go along) and all but the last give them back
with fewer rows and the same columns. In every stage a null doc_id or text, an empty or very long text, repeated rows, an empty table
and columns that are named like a stage's own are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, mixing, packing, simhash, toxicity
from lectern.llm.common import scratch, workspace
from lectern.llm.token_counts import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go; it learns from the labels table and ``docs``.

    Scores depend on the text alone: repeated rows and copies share their fate, and null or empty texts have the score of a
    text without words. Labels that are null, or of documents that are not there, teach nothing; without labels of both kinds
    every text has the same score.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal after lower-casing A-Z stays: the one with the largest doc_id.

    Null texts equal empty ones; null doc_ids rank last, and their copies go too; of rows repeated whole one stays.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by sets of five-word shingles of similarity 0.8 or more stays: the one with the smallest doc_id.

    Texts without words, nulls among them, are one group; a text of fewer than five words has one shingle, all of
    them; null doc_ids rank last; of rows repeated whole one stays.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to flattened source, language and topic weights, by a hash of doc_id.

    A null source or language is a value of its own; a null doc_id is drawn like any other; repeated rows share their fate.
    """
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents become full windows; one row per piece. A null text is its end id alone; null doc_ids stay null."""
    return packing.pieces(packing.pack(docs, vocabulary()))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Neither a learned model nor a tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again as the next one's input; a stage's own tables go with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        with workspace(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
