"""Sharding by jump consistent hashing: a stable key and the shard count decide, without a ring table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bounded, free, stored, text_or_empty

#: Multiplier of the published generator, as 32-bit halves; the low half again as 16-bit halves. Fixed values.
HIGH, LOW_1, LOW_0 = 0x27BB2EE6, 0x87B0, 0xB0FD
MASK = 0xFFFFFFFF
#: Rows that one task numbers.
SLOT_ROWS = 50_000
#: Steps beyond the usual number that every key walks.
FEW = 4


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two unsigned 32-bit halves of a 64-bit key: the first 16 hex digits of the MD5 of its text (null: of '')."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def _next(h: Column, l: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 in halves; no product here leaves a signed long."""
    t0, t1 = l * LOW_0, l * LOW_1
    low = t0.bitwiseAND(MASK) + F.shiftleft(t1.bitwiseAND(0xFFFF), 16) + 1
    high = F.shiftright(t0, 32) + F.shiftright(t1, 16) + F.shiftright(low, 32) + (l * HIGH).bitwiseAND(MASK) + (h * LOW_0).bitwiseAND(MASK) + F.shiftleft((h * LOW_1).bitwiseAND(0xFFFF), 16)
    return high.bitwiseAND(MASK), low.bitwiseAND(MASK)


def jump(high: Column, low: Column, shards: int) -> Column:
    """Struct (shard, grown): the key's bucket among ``shards`` and among one more.

    The key's jumps do not depend on the shard count, so one walk serves both: the shard is the last bucket
    reached below the count. It ends after about ln(shards) + 1 jumps; ``FEW`` steps more are walked by all keys, and
    the many that a key may need at worst only by those that have not ended by then.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(high.alias("h"), low.alias("l"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"))

    def step(s: Column, _: Column) -> Column:
        h, l = _next(s["h"], s["l"])
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] > shards, s).otherwise(F.struct(h.alias("h"), l.alias("l"), j.alias("j"), F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown")))

    walk = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, step)
    first = min(shards + 1, round(np.log(shards)) + FEW)
    # bound to a name by a list of one, so that the first steps are not computed again by each use
    end = F.transform(F.array(walk(start, first)), lambda s: F.when(s["j"] > shards, s).otherwise(walk(s, shards + 1 - first)) if shards + 1 > first else s)[0]
    return F.transform(F.array(end), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))[0]


def assign(rows: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Adds shard and grown_shard to every row (same-named input columns are replaced); nothing is shuffled.

    A null key has the key of ''; repeated rows go to one shard; no rows give no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    walked = free(rows, "walked")[0]
    return rows.withColumn(walked, jump(*key_halves(F.col(key)), shards)).withColumns({"shard": F.col(f"{walked}.shard"), "grown_shard": F.col(f"{walked}.grown")}).drop(walked)


def number(rows: DataFrame, n_rows: int, key: str, ties: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Adds slot: gapless from 0 within each shard, by the key's hash, then the key, then ``ties``.

    Leading bits of the hash cut every shard into ranges of about ``slot_rows`` rows; ranges are counted first
    (from the key alone), each is numbered by its own task from the sum of those before it. Rows of a key (null, say)
    that more than ``slot_rows`` rows share come last in their shard, and are cut into ranges by a hash of the ties.
    Rows that are equal in the key and all ties may have each other's numbers. A column called slot is replaced; no rows give no rows.
    """
    high, low, part, at, before, n, sort, own = free(rows, "key_high", "key_low", "range", "at", "before", "n", "tie_hash", "own_key")
    h, l = key_halves(F.col(key))
    bits = max(0, int(n_rows // slot_rows).bit_length())
    ranged = rows.drop("slot").withColumn(high, h).withColumn(low, l)
    hot = ranged.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > slot_rows).select(F.col(key).alias(own)) if n_rows > slot_rows else ranged.limit(0).select(F.col(key).alias(own))
    hot = stored(hot, "shard-keys")  # fewer than n_rows / slot_rows rows
    by_key = F.shiftright(high, 32 - bits)
    if hot.isEmpty():
        ranged = ranged.withColumn(sort, F.lit(0).cast("long")).withColumn(part, F.struct(F.lit(0).alias("late"), by_key.alias("at"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("tie")))
    else:
        ranged = ranged.join(bounded(hot.withColumn(n, F.lit(True))), F.col(key).eqNullSafe(F.col(own)), "left").drop(own)
        late = F.coalesce(F.col(n), F.lit(False))
        tied = F.when(late, F.shiftrightunsigned(F.xxhash64(*ties) if ties else F.lit(0).cast("long"), 32)).otherwise(0)
        ranged = ranged.withColumn(sort, tied).withColumn(part, F.struct(F.when(late, 1).otherwise(0).alias("late"), F.when(late, F.col(high)).otherwise(by_key).alias("at"), F.when(late, F.col(low)).otherwise(0).alias("key"), F.shiftright(F.col(sort), 32 - bits).alias("tie"))).drop(n)
    up_to = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("shard", part).agg(F.count("*").alias(n)).withColumn(before, F.coalesce(F.sum(n).over(up_to), F.lit(0))).select("shard", part, before)
    order = Window.partitionBy("shard", part).orderBy(high, low, key, sort, *ties)
    numbered = ranged.withColumn(at, F.row_number().over(order)).join(bounded(stored(sums, "shard-ranges")), ["shard", part])
    return numbered.withColumn("slot", (F.col(before) + F.col(at) - 1).cast("long")).drop(high, low, part, at, before, sort)


SHARDS = 40


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return number(assign(rows, SHARDS), docs.count(), "doc_id", ["text_crc32", "size"])


#: The walk unrolled as a fold over a list, with wide integers; CRC-32 as a fold over the text's bytes.
ORACLE = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
b AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS x, md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
k AS (
  SELECT doc_id, size,
         xor(list_reduce(x, lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32,
         ('0x' || m[1:8])::HUGEINT * 4294967296 + ('0x' || m[9:16])::HUGEINT AS key FROM b, crc),
w AS (
  SELECT doc_id, size, text_crc32, key,
         list_reduce(range({SHARDS + 1}),
           lambda s, i: CASE WHEN s.j > {SHARDS} THEN s ELSE
             {{'k': (s.k * 2862933555777941757 + 1) % 18446744073709551616,
               'j': floor((s.j + 1)::DOUBLE * (2147483648::DOUBLE / ((((s.k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT,
               'shard': CASE WHEN s.j < {SHARDS} THEN s.j ELSE s.shard END, 'grown': s.j}} END,
           {{'k': key, 'j': 0::BIGINT, 'shard': 0::BIGINT, 'grown': 0::BIGINT}}) AS s FROM k)
SELECT doc_id, size, text_crc32, 'key' AS law, s.shard::INTEGER AS shard, s.grown::INTEGER AS grown_shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY key, doc_id, text_crc32, size) - 1 AS slot
FROM w
"""
