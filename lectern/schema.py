"""Explicit schemas of the records that the engine passes around."""

from __future__ import annotations

from pyspark.sql import types as T

#: What the JSON loader reads of a node; every field may be missing.
NODE_JSON = T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType()), T.StructField("z", T.FloatType()), T.StructField("id", T.StringType())])

#: A node as stored: ``ord`` is its place in the input, which settles ties and first matches.
NODE = T.StructType(
    [T.StructField("method", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("id", T.StringType()), T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType()), T.StructField("z", T.FloatType()), T.StructField("group", T.StringType()), T.StructField("text", T.StringType())]
)

LINK = T.StructType([T.StructField("method", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("weight", T.DoubleType())])

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)
