"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, or in a local session's own; it goes when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(root or tempfile.mkdtemp(prefix='lectern-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, there = _path(spark, path)
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file through the file system that Spark reads."""
    files, there = _path(spark, path)
    out = files.create(there, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
