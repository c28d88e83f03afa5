"""Token counts through a cache of digests: only distinct texts that the cache lacks are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, bounded, scratch, stored, text_or_empty
from .tokens import encoder, tokenizer_version

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CACHE_SCHEMA = "digest binary, n_tokens long"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, counts_only=True).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([encode(t.as_py()) for t in b.column("text")], pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache_dir: str, limit: int = LIMIT) -> DataFrame:
    """Adds to ``cache_dir`` the counts it lacks, then returns doc_id, n_bytes, n_tokens, over_limit per row.

    The key is the SHA-256 of the text; the tokenizer's version (file and library) names the folder inside
    ``cache_dir``. The only normalisation that cannot change a count is taken: null counts as empty. Which texts to
    encode is decided on slim rows of doc_id and digest, see ``_misses``. A batch becomes visible only when its
    write commits, so a lost executor or a failed job leaves the cache as it was; digests that two writers add twice
    are merged when read. ``cache_dir`` must be in a folder that all executors share.

    Null doc_ids and repeated rows are kept as they are; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    folder = f"{cache_dir}/{tokenizer_version(path)}"
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    each = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("rows"), F.min(F.struct("doc_id", "n")).alias("of"))
    each = stored(each.select("digest", "rows", F.col("of.doc_id").alias("owner"), F.col("of.n").alias("owned")), "token-digests")
    known = _read(spark, folder)
    hit = each.join(known.select("digest").distinct(), "digest", "left_semi") if known is not None else each.where("false")
    lacking = each.join(known.select("digest"), "digest", "left_anti") if known is not None else each
    _misses(texts, stored(lacking, "token-misses"), stored(hit.select("digest"), "token-hits")).mapInArrow(_counter(path), CACHE_SCHEMA).write.mode("append").parquet(folder)
    # a row for each digest of these rows, written before the join, so that Spark can split a digest of very many rows
    counts = each.select("digest").join(_read(spark, folder), "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(bounded(stored(counts, "token-counts")), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _misses(texts: DataFrame, lacking: DataFrame, hit: DataFrame) -> DataFrame:
    """digest and text of one row for each digest that the cache lacks (``lacking``: digest, rows, owner, owned).

    Texts are the heavy side, so they stay where they are read if a slim set can be sent to them: either the lacking
    digests (a warm cache), or those to skip, which are hits and copies (a cold one), whichever was counted and fits a
    broadcast. Of a digest's rows the one with its ``owner`` (least doc_id) is taken; where that doc_id has
    the text several times, these rows alone are made distinct by a shuffle. If neither set is that small, every
    text takes part in one shuffle by digest.
    """
    own = F.col("doc_id").eqNullSafe(F.col("owner"))
    if lacking.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = texts.join(F.broadcast(lacking.select("digest", "owner", "owned")), "digest").where(own)
        spread = lacking
    else:
        copied = lacking.where("rows > 1")
        skip = copied.select("digest", "owner", "owned", F.lit(False).alias("hit")).unionByName(hit.select("digest", F.lit(None).cast(texts.schema["doc_id"].dataType).alias("owner"), F.lit(0).cast("long").alias("owned"), F.lit(True).alias("hit")))
        if skip.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return texts.join(lacking.select("digest", "owner"), "digest").where(own).dropDuplicates(["digest"]).select("digest", "text")
        met = texts.join(F.broadcast(skip), "digest", "left").where(F.col("hit").isNull() | (~F.col("hit") & own)).withColumn("owned", F.coalesce("owned", F.lit(1)))
        spread = copied
    once = met.where("owned = 1").select("digest", "text")
    if spread.where("owned > 1").isEmpty():
        return once
    return once.unionByName(met.where("owned > 1").select("digest", "text").dropDuplicates(["digest"]))


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache of its own, so every distinct text is a miss that is really encoded."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), scratch(spark, "token-cache"))
