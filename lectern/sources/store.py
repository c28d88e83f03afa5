"""The store of nodes and links, partitioned by method; each method's snapshot is replaced whole."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import LINK, NODE

METHOD = re.compile(r"[A-Za-z0-9_]+")


@dataclass
class Store:
    """Tables under ``root/nodes`` and ``root/links``.

    A scan of one method reads that method's partition only. Snapshots are replaced by dynamic partition overwrite, so
    other methods stay; nodes and links of one method are two writes, hence a reader may see new nodes
    with old links.
    """

    spark: SparkSession
    root: str

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    @staticmethod
    def checked(method: str) -> str:
        if not METHOD.fullmatch(method):
            raise ValueError(f"no method name: {method!r}")
        return method

    def _read(self, kind: str, schema, method: str | None) -> DataFrame:
        if not method:
            return self.spark.createDataFrame([], schema)
        try:
            table = self.spark.read.schema(schema).parquet(self._path(kind))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise
        return table.where(F.col("method") == self.checked(method))

    def nodes(self, method: str | None) -> DataFrame:
        """Nodes of a method; none without a method."""
        return self._read("nodes", NODE, method)

    def links(self, method: str | None) -> DataFrame:
        return self._read("links", LINK, method)

    def replace(self, kind: str, method: str, rows: DataFrame) -> bool:
        """Replaces a method's snapshot; an empty one leaves the old in place and answers False."""
        schema = {"nodes": NODE, "links": LINK}[kind]
        rows = rows.withColumn("method", F.lit(self.checked(method)))
        for f in schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None))
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        if rows.isEmpty():
            return False
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(self._path(kind))
        return True

    def methods(self) -> DataFrame:
        """method and n_nodes of every stored method."""
        try:
            table = self.spark.read.schema(NODE).parquet(self._path("nodes"))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], "method string, n_nodes long")
            raise
        return table.groupBy("method").agg(F.count("*").alias("n_nodes"))
