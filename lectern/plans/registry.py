"""Analysis methods: name -> builder of nodes and links from passages (id, text, embedding)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import links as lk, topics as tp

Builder = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
METHODS: dict[str, Builder] = {}


def method(name: str) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        METHODS[name] = builder
        return builder

    return add


def _published(name: str, rows: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes from (id, embedding, group, text), in order of id, and links to the k most similar others."""
    places = tp.layout(rows)
    nodes = places.join(rows.select("id", "group", "text"), "id").select(F.lit(name).alias("method"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), "x", "y", "z", F.col("group").cast("string").alias("group"), "text")
    near = lk.topk_cosine(rows.select("id", "embedding"), k)
    links = near.select(F.lit(name).alias("method"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("sim").alias("weight"))
    return nodes, links


@method("topics")
def topics(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic shares as vectors, the dominant topic as group."""
    found = tp.lda(passages.select("id", "text")).join(passages.select("id", "text"), "id")
    return _published("topics", found.withColumnRenamed("topics", "embedding"))


@method("words")
def words(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means of word vectors; no groups."""
    found = tp.term_vectors(passages.select("id", "text")).join(passages.select("id", "text"), "id")
    return _published("words", found.withColumn("group", F.lit(None).cast("string")))


@method("embeddings")
def embeddings(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Given vectors (column embedding) and, if there is one, the given group."""
    rows = passages if "group" in passages.columns else passages.withColumn("group", F.lit(None).cast("string"))
    return _published("embeddings", rows.select("id", "embedding", "group", "text"))
