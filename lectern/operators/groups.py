"""Topic groups: sizes, centroids, top terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx

DIGITS = 6


def sizes(nodes: DataFrame, by: str = "group") -> DataFrame:
    return nodes.groupBy(by).agg(F.count("*").alias("n"))


def centroids(nodes: DataFrame, by: str = "group") -> DataFrame:
    """Mean position of each group: partial sums per task, one row per group and task in the exchange."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), DIGITS).alias(c)
    return nodes.groupBy(by).agg(F.count("*").alias("n"), mean("x"), mean("y"), mean("z"))


def top_terms(passages: DataFrame, by: str, k: int) -> DataFrame:
    """by, rank, term, n: each group's most frequent terms, ties in order of the term."""
    counts = passages.select(by, F.explode(tx.terms(F.col("text"))).alias("term")).groupBy(by, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)
