"""Node JSON: an array of objects in, an array of objects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import NODE_JSON


def completed(node: Column) -> list[Column]:
    """x, y, z, id of a parsed object; missing numbers are 0, a missing id is ''."""
    number = lambda c: F.coalesce(node[c].cast("float"), F.lit(0.0).cast("float")).alias(c)
    return [number("x"), number("y"), number("z"), F.coalesce(node["id"].cast("string"), F.lit("")).alias("id")]


def parse_column(df: DataFrame, name: str) -> DataFrame:
    """ord, x, y, z, id of the JSON arrays in a column; text that is no JSON array fails the query."""
    # Spark would take an object for an array of one
    listed = F.when(F.col(name).rlike(r"^\s*\["), F.col(name)).when(F.col(name).isNotNull(), F.lit("[MALFORMED"))
    parsed = F.from_json(listed, T.ArrayType(NODE_JSON), {"mode": "FAILFAST"})
    return df.select(F.posexplode(parsed).alias("ord", "node")).select(F.col("ord").cast("long").alias("ord"), *completed(F.col("node")))


def load(spark: SparkSession, json: str) -> DataFrame:
    """Nodes of a JSON text. ``ValueError`` if it is no array of objects, so that a caller can keep what it has."""
    nodes = parse_column(spark.createDataFrame([(json,)], "value string"), "value")
    try:
        nodes.count()
    except Exception as e:
        if "MALFORMED" in str(e) or "FAILFAST" in str(e):
            raise ValueError("no JSON array of nodes") from e
        raise
    return nodes


def dump(nodes: DataFrame, per: int = 10_000) -> DataFrame:
    """chunk, json: arrays of at most ``per`` nodes in order of ``ord``."""
    chunked = nodes.withColumn("chunk", F.floor(F.col("ord") / per))
    listed = F.array_sort(F.collect_list(F.struct("ord", F.struct("x", "y", "z", "id").alias("node"))))
    return chunked.groupBy("chunk").agg(F.to_json(F.transform(listed, lambda s: s["node"])).alias("json"))
