"""Live snapshots: the latest value per key, and a method's nodes and links replaced on every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import EVENTS
from ..sources import shared
from ..sources.store import Store


def latest(changes: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last values per key, by ``order``; works on batches and streams alike, with one state row per key."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last")).select(key, *[f"last.{v}" for v in values])


def changes_of(spark: SparkSession, folder: str, table: str = "events.parquet") -> DataFrame:
    """The event files of a table as a stream, be it one file or a folder of files; new files are picked up."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isFile():
        return spark.readStream.schema(EVENTS).option("pathGlobFilter", table).parquet(folder)
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}")


def run_available(rows: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns its result, which each batch writes under ``folder``.

    In complete mode the last batch is the result; in append mode all are. Nothing passes through the driver. A batch
    that runs again replaces its own files.
    """
    spark, folder = rows.sparkSession, folder or shared.folder(rows.sparkSession, "snapshot")
    seen: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        seen.append(n)

    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], rows.schema)
    paths = [f"{folder}/rows/batch={n}" for n in (sorted(set(seen))[-1:] if mode == "complete" else sorted(set(seen)))]
    return spark.read.schema(rows.schema).parquet(*paths)


class Subscription:
    """Keeps a method's stored snapshot equal to what a stream of full snapshots says; one method is live at a time.

    Each batch replaces the method's partition as a whole. Nodes and links are streams of their own, so
    between two batches a reader may see new nodes with old links; within a kind, a batch is all or nothing.
    """

    def __init__(self, store: Store, checkpoint: str, trigger: dict | None = None):
        self.store, self.checkpoint = store, checkpoint
        self.trigger = trigger or {"processingTime": "1 second"}
        self.method: str | None = None
        self.queries: list[StreamingQuery] = []

    def select(self, method: str | None, nodes: DataFrame | None = None, links: DataFrame | None = None) -> None:
        """Stops the old method's streams and starts the new one's; no method: nothing runs."""
        self.stop()
        self.method = method
        if not method:
            return
        for kind, rows in (("nodes", nodes), ("links", links)):
            if rows is not None:
                self.queries.append(self._start(kind, self.store.checked(method), rows))

    def _start(self, kind: str, method: str, rows: DataFrame) -> StreamingQuery:
        def replace(batch: DataFrame, _: int) -> None:
            self.store.replace(kind, method, batch)

        return rows.writeStream.foreachBatch(replace).option("checkpointLocation", f"{self.checkpoint}/{kind}-{method}").trigger(**self.trigger).start()

    def elapsed(self) -> list[dict]:
        """Progress of the live streams; the reset per method is that each selection starts new ones."""
        return [q.lastProgress for q in self.queries if q.lastProgress]

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries = []
