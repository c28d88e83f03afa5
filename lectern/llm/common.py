"""What the operators share: ASCII lower-casing, free column names, the shared scratch folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side is broadcast only if it was counted and has at most this many rows; beyond it a shuffle join runs.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    ``lower`` folds other letters too, so it serves only texts without any byte beyond ASCII; the others go
    through ``translate``, which is slower.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set, a local session gets one of its own; on a cluster that is an error, since a folder of one
    machine would lose what the others write.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc._jsc.sc().isLocal():
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


_open: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses. Its application's folder goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}"
    files, there = _path(spark, folder)
    if not files.exists(there):
        files.mkdirs(there)
        files.deleteOnExit(there)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch tables that were made within: for callers that have written what they keep."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            files, there = _path(spark, path)
            files.delete(there, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs within go when each one ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def give_back() -> None:
    """Returns what this process has freed to the system: Arrow's pool, and where the C library can (glibc) its heap, which else keeps it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage by a checkpoint in the shared folder, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, path: str = "") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back (columnar, compressed, prunable).

    A sum or count that is stored before it is joined has an exchange of its own there, so that Spark can split
    the other side's hot keys. ``path``: a scratch path that was made before, so that an inner ``workspace`` leaves
    the table; what is there already is added to.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keep_judged(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judged`` (doc_id, own, n, stays) drops, all columns kept.

    ``own`` is the XXH64 of a row's text (null: of ''); a row goes by it and its doc_id, null ids too. Rows that stay
    but share both with others (n > 1) become one; which of them is open if other columns differ.
    """
    doc, key, own = free(docs, "judged_doc", "judged_key", "own_key")
    hashed = docs.withColumn(own, F.xxhash64(text_or_empty()))
    at = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key))
    named = lambda rows, name: bounded(stored(rows.select(F.col("doc_id").alias(doc), F.col("own").alias(key)), name))
    left = hashed.join(named(judged.where("not stays"), "judged-gone"), at, "left_anti")
    repeated = judged.where("stays and n > 1")
    if not repeated.isEmpty():
        twice = named(repeated, "judged-repeated")
        left = left.join(twice, at, "left_anti").unionByName(left.join(twice, at, "left_semi").dropDuplicates(["doc_id", own]))
    return left.drop(own)
