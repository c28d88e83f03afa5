"""Topics, dominant groups, and layout in three dimensions, by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, CountVectorizer, StopWordsRemover, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

SEED = 42


def term_lists(passages: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """id and terms of each passage, stop words taken out."""
    rows = passages.select("id", tx.terms(F.col("text")).alias("all_terms"))
    remover = StopWordsRemover(inputCol="all_terms", outputCol="terms", stopWords=stop_words if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english"))
    return remover.transform(rows).select("id", "terms")


def lda(passages: DataFrame, k: int = 5, vocabulary: int = 5_000, rounds: int = 10, seed: int = SEED) -> DataFrame:
    """id, topics (shares that sum to 1), group (the dominant topic; ties to the lowest).

    Online variational Bayes, each round over all passages, on bags of the most frequent terms. Passages without terms have equal shares.
    """
    terms = term_lists(passages)
    counted = CountVectorizer(inputCol="terms", outputCol="bag", vocabSize=vocabulary, minDF=2.0)
    model = Pipeline(stages=[counted, LDA(k=k, maxIter=rounds, seed=seed, optimizer="online", subsamplingRate=1.0, featuresCol="bag", topicDistributionCol="share")]).fit(terms)
    shares = vector_to_array("share")
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    topics = F.when(total > 0, F.transform(shares, lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / k), k))
    return model.transform(terms).select("id", topics.alias("topics")).withColumn("group", dominant(F.col("topics")))


def dominant(topics: Column) -> Column:
    """Index of the largest share, the first of equals."""
    return (F.array_position(topics, F.array_max(topics)) - 1).cast("int")


def layout(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """id, x, y, z in [-1, 1]: three principal components, each scaled by its largest absolute value."""
    rows = vectors.select("id", array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    placed = PCA(k=3, inputCol="v", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
    widest = placed.agg(*[F.max(F.abs(F.col("p")[i])).alias(f"m{i}") for i in range(3)])
    scaled = lambda i: F.when(F.col(f"m{i}") > 0, F.col("p")[i] / F.col(f"m{i}")).otherwise(0.0).cast("float")
    return placed.crossJoin(F.broadcast(widest)).select("id", scaled(0).alias("x"), scaled(1).alias("y"), scaled(2).alias("z"))  # one row


def term_vectors(passages: DataFrame, size: int = 32, seed: int = SEED) -> DataFrame:
    """id and embedding: passages as means of word vectors, where no embeddings are given."""
    terms = term_lists(passages, stop_words=[])
    model = Word2Vec(vectorSize=size, minCount=2, seed=seed, inputCol="terms", outputCol="v").fit(terms)
    return model.transform(terms).select("id", vector_to_array("v").cast("array<float>").alias("embedding"))
