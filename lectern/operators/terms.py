"""Term statistics and search over passages (id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

DIGITS = 6


def bag(passages: DataFrame) -> DataFrame:
    """id, term, tf: a partial count per task, then one exchange by passage and term."""
    return passages.select("id", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(bag: DataFrame) -> DataFrame:
    """term, df, cf of a bag, whose rows are one per passage and term, so nothing needs to be made distinct."""
    return bag.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def tfidf(passages: DataFrame) -> DataFrame:
    """id, term, tf, weight = tf * ln(passages / df), rounded."""
    counts = bag(passages)
    df = document_frequency(counts).select("term", "df")
    n = passages.agg(F.count("*").alias("_n"))
    weight = F.round(F.col("tf") * F.log(F.col("_n").cast("double") / F.col("df")), DIGITS) + F.lit(0.0)
    return counts.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", "tf", weight.alias("weight"))  # one row


def search(passages: DataFrame, word: str) -> DataFrame:
    """Passages that contain ``word`` in any case; a scan without an exchange."""
    return passages.where(F.lower("text").contains(word.lower()))


def inverted_index(bag: DataFrame) -> DataFrame:
    """term, id, tf dealt and sorted by term, to be written partition-wise and looked up by row-group statistics."""
    return bag.select("term", "id", "tf").repartitionByRange("term").sortWithinPartitions("term", "id")


def concordance(passages: DataFrame, word: str, around: int) -> DataFrame:
    """id, pos, before, hit, after: each occurrence of a term with up to ``around`` terms on both sides."""
    found = passages.where(F.lower("text").contains(word.lower())).select("id", tx.terms(F.col("text")).alias("terms"))
    hits = found.select("id", "terms", F.posexplode("terms").alias("pos", "hit")).where(F.col("hit") == word.lower())
    start = F.greatest(F.col("pos") - around, F.lit(0))
    words = lambda at, n: F.array_join(F.slice("terms", at + 1, n), " ")
    return hits.select("id", "pos", words(start, F.col("pos") - start).alias("before"), "hit", words(F.col("pos") + 1, F.lit(around)).alias("after"))
