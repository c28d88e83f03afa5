"""Exact deduplication by progressive refinement: length, then a hash of the first characters, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, bounded, keep_judged, stored, text_or_empty

#: Characters whose hash refines a group of equal lengths.
PREFIX_CHARS = 64


def _full_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(text), 256)


def _refined(docs: DataFrame, digest_all: bool, prefix_chars: int) -> tuple[DataFrame, DataFrame]:
    """(rows alone after a cheap step, rows that needed the full hash), as doc_id, own (XXH64 of the text as it is), text_sha256."""
    own = F.xxhash64("text").alias("own")
    cheap = F.octet_length("text").alias("len"), F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars))).alias("head")
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    digest = _full_hash(F.col("text")).alias("text_sha256")
    seen = stored(texts.select("doc_id", own, *cheap, digest if digest_all else F.lit(None).cast("string").alias("text_sha256")), "dedup-keys")

    shared = lambda rows, *key: bounded(stored(rows.groupBy(*key).count().where("count > 1").select(*key), f"dedup-{key[-1]}"))
    by_length = seen.join(shared(seen, "len"), "len", "left_semi")
    heads = shared(by_length, "len", "head")
    alone = seen.join(heads, ["len", "head"], "left_anti").select("doc_id", "own", "text_sha256")
    if digest_all:
        return alone, seen.join(heads, ["len", "head"], "left_semi").select("doc_id", "own", "text_sha256")
    again = texts.select("doc_id", "text", *cheap).join(heads, ["len", "head"], "left_semi")
    return alone, stored(again.select("doc_id", own, digest), "dedup-full")


def duplicate_groups(docs: DataFrame, digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Finds groups of texts that are equal after lower-casing A-Z.

    Each step splits the groups of the step before, and only rows in groups of two or more go on:
    byte length -> hash of the first ``prefix_chars`` characters -> SHA-256 of the whole text. Rows alone after a cheap
    step are groups of one. Without ``digest_all`` the whole text is hashed only for rows that survive the first two
    steps (a second scan, joined with the surviving keys). With it the caller reports all digests, so the
    first scan has them as one more column; the steps and the groups are the same.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256 (null for rows that were alone
    after a cheap step, unless ``digest_all``).

    Null texts count as empty, so they equal each other and ''. The largest doc_id of a group stays; a null
    doc_id ranks below all others, and where all are null one row stays, under keep_id null. Of rows that share that
    doc_id and text exactly one is kept; each counts in group_size. No input rows: no output rows. Other columns are
    not read.
    """
    alone, survivors = _refined(docs, digest_all, prefix_chars)
    # rows of one doc_id and text are counted, not paired, and come back by their number
    counted = stored(survivors.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")), "dedup-counted")
    groups = bounded(stored(counted.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "dedup-groups").where("group_size > 1"))
    found = counted.join(groups, "text_sha256", "left").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    found = found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("i") == 1)).alias("kept"), "text_sha256")
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return found.unionByName(single)


def drop_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row of ``docs`` of each group of equal texts, all columns kept.

    The groups are those of ``duplicate_groups``. The row with the largest doc_id stays (null below all); of several texts
    that differ in case under that doc_id, one stays; of rows that share doc_id and text, one (which one
    is open if other columns differ). A row goes by its doc_id and text, so another text under the same doc_id stays.
    """
    _, survivors = _refined(docs, False, prefix_chars)
    counted = stored(survivors.groupBy("text_sha256", "doc_id", "own").agg(F.count("*").alias("n")), "dedup-counted")
    best = F.max(F.struct("doc_id", "own", "n")).alias("best")
    groups = stored(counted.groupBy("text_sha256").agg(best, F.sum("n").alias("group_size")).where("group_size > 1"), "dedup-groups")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("own") == F.col("best.own"))
    judged = counted.join(bounded(groups), "text_sha256").withColumn("stays", kept)
    return keep_judged(docs, judged)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


#: 26 pairs of letters: the folding that both sides of the comparison use.
ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
