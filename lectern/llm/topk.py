"""Exact top-k by inner product with block-at-a-time pruning over document-range blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import stored

K, SCALE, EVERY = 5, 256, 50
#: Vectors of a block; the least and most of a segment, which bound a task's memory; blocks that one step scores at most.
BLOCK_ROWS, SEGMENT_ROWS, WAVE = 64, (4_096, 65_536), 64
#: Vectors that the clustering of document ranges is learned from, and its clusters. They order rows, results do not depend on them.
SAMPLE_ROWS, CLUSTERS, STEPS = 4_096, 64, 6
#: Bytes of segments' bounds that are sent to the queries at once.
BOUNDS_BYTES = 64 << 20

FOUND = "query_key long, query_id long, vec_id long, score long, scored long"


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) per component; vectors that are null or hold null or non-finite components go."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(usable).select("vec_id", F.transform(x, lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers as a matrix of longs, shorter rows padded with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(lists) and len(flat) == len(lists) * width and (np.diff(ends, prepend=0) == width).all():
        return flat.reshape(-1, width)
    m = np.zeros((len(lists), width), np.int64)
    for i, (at, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)) if len(lists) else ():
        m[i, : end - at] = flat[at:end]
    return m


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which inner products of the rows of both are exact: doubles, longs, or Python's integers."""
    largest = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = largest(a) * largest(b) * max(1, a.shape[1])
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class Segment:
    """Vectors in order, with a block's largest and smallest value of each component (its term maxima)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int):
        self.ids, self.vectors, self.block = ids, vectors, block
        self.starts = np.arange(0, len(ids), block)
        self.top, self.low = np.maximum.reduceat(vectors, self.starts, axis=0), np.minimum.reduceat(vectors, self.starts, axis=0)

    def search(self, q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each query: its number, the k best ids and scores at or above its floor, and how many blocks were scored.

        A query's terms are the signed components: of a positive one a block's maximum bounds the share of the
        score, of a negative one its minimum. Blocks go in the order of the summed bounds and are scored through
        their own vectors, a few at a time, until a bound is below the kth score (an equal one may still win by its id).
        """
        kind = _exact(self.vectors, q)
        vectors, q = self.vectors.astype(kind, copy=False), q.astype(kind, copy=False)
        bounds = np.maximum(q, 0) @ self.top.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        for i in range(len(q)):
            order = np.argsort(-bounds[i], kind="stable")
            kth, ids, scores, at, step = floors[i], np.empty(0, np.int64), np.empty(0, kind), 0, 1
            while at < len(order):
                wave = order[at : at + step]
                wave = wave[: np.count_nonzero(bounds[i, wave] >= kth)] if kth is not None else wave
                if not len(wave):
                    break
                rows = (self.starts[wave][:, None] + np.arange(self.block)).ravel()
                rows = rows[rows < len(self.ids)]
                s, c = vectors[rows] @ q[i], self.ids[rows]
                take = c != q_ids[i]
                if kth is not None:
                    take &= (s >= kth).astype(bool)
                ids, scores = np.concatenate([ids, c[take]]), np.concatenate([scores, s[take]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(scores) == k and (kth is None or scores[-1] > kth):
                    kth = int(scores[-1])
                at, step = at + len(wave), min(2 * step, WAVE)
            yield i, ids, scores, at


def _clusters(rows: DataFrame, width: int) -> np.ndarray:
    """Centres of a bounded sample (the rows with the smallest hashes), by a few steps of k-means from spread rows."""
    found = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("v").toArrow()
    x = _matrix(found["v"].combine_chunks(), width).astype(float)
    centres = x[np.linspace(0, len(x) - 1, min(CLUSTERS, len(x))).astype(int)]
    for _ in range(STEPS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x.astype(float) @ centres.T), axis=1)


def _dealt(rows: DataFrame, n: int, width: int, segment: int) -> DataFrame:
    """segment, place, vec_id, v: rows in order of their nearest centre and vec_id, cut into ranges of about ``segment``."""
    centres = rows.sparkSession.sparkContext.broadcast(_clusters(rows, width))  # CLUSTERS * width numbers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _nearest(_matrix(b.column("v"), width), centres.value)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *b.columns], names=["place", "vec_id", "v"])

    placed = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(place, "place int, vec_id long, v array<long>"), "topk-placed")
    return stored(placed.repartitionByRange(math.ceil(n / segment), "place", "vec_id").withColumn("segment", F.spark_partition_id()), "topk-segments")


def _bounds(dealt: DataFrame, width: int) -> DataFrame:
    """segment, top, low: largest and smallest value per component."""
    at = lambda f, i: f(F.coalesce(F.get("v", F.lit(i)), F.lit(0)))
    return dealt.groupBy("segment").agg(*(F.array(*[at(f, i) for i in range(width)]).alias(name) for f, name in ((F.max, "top"), (F.min, "low"))))


def _found(rows: DataFrame, queries: DataFrame, k: int, block: int, segment: int | None) -> tuple[DataFrame, int] | None:
    """(query_key, query_id, vec_id, score: the k best of each segment that a query was sent to; scored: in a row without
    vec_id per query and segment, the blocks scored there; number of blocks), or None without rows or queries."""
    spark = rows.sparkSession
    clean = lambda df: df.where("vec_id is not null").select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    rows = stored(clean(rows), "topk-rows")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    queries = stored(clean(queries).select(F.col("vec_id").cast("long").alias("query_id"), F.xxhash64("vec_id", "v").alias("query_key"), F.col("v").alias("q")), "topk-queries")
    if not n or queries.isEmpty():
        return None
    width = max(1, width)
    segment = segment or min(max(SEGMENT_ROWS[0], math.ceil(n / spark.sparkContext.defaultParallelism)), SEGMENT_ROWS[1])
    dealt = _dealt(rows, n, width, segment)
    bounds = stored(_bounds(dealt, width), "topk-bounds")
    blocks = dealt.groupBy("segment").agg(F.ceil(F.count("*") / block).alias("n")).agg(F.sum("n")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for b in batches:
            segments, kinds = b.column("segment").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(segments) != 0) | (np.diff(kinds) != 0)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(segments)], strict=True) if len(segments) else ():
                if segments[at] != now:
                    now, parts, held = segments[at], [], None
                if kinds[at] == 0:
                    part = b.slice(at, end - at)
                    parts.append((part.column("id").to_numpy(), _matrix(part.column("v"), width)))
                    continue
                held = held or (Segment(*(np.concatenate(x) for x in zip(*parts, strict=True)), block) if parts else None)
                for lo in range(at, end if held else at, 1024):
                    part = b.slice(lo, min(1024, end - lo))
                    ids, vectors = part.column("id").to_numpy(), _matrix(part.column("v"), width)
                    keys, out = part.column("query_key").to_numpy(), []
                    for i, found, scores, scored in held.search(ids, vectors, part.column("floor").to_pylist(), k):
                        out += [(keys[i], ids[i], None, None, scored), *((keys[i], ids[i], c, int(s), None) for c, s in zip(found, scores, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_key", "query_id", "vec_id", "score", "scored"])

    def meet(asked: DataFrame) -> DataFrame:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        left = dealt.join(asked.select("segment").distinct(), "segment", "left_semi")
        left = left.select("segment", F.lit(0).alias("kind"), "place", F.col("vec_id").alias("id"), none("long", "query_key"), "v", none("long", "floor"))
        right = asked.select("segment", F.lit(1).alias("kind"), F.lit(0).alias("place"), F.col("query_id").alias("id"), "query_key", F.col("q").alias("v"), "floor")
        # a segment's rows come first, then its queries as a stream: only the rows are held
        return left.unionByName(right).repartition("segment").sortWithinPartitions("segment", "kind", "place", "id").mapInArrow(run, FOUND)

    home = _sent(queries.withColumn("floor", F.lit(None).cast("long")), bounds, width, best=True)
    home = stored(home, "topk-home")
    first = stored(meet(home), "topk-first")
    floors = first.where("vec_id is not null").groupBy("query_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = queries.join(stored(floors, "topk-floors"), "query_key", "left")
    rest = _sent(asked, bounds, width, best=False).join(home.select("query_key", F.col("segment").alias("home")), "query_key").where("segment != home").drop("home")
    return first.unionByName(stored(meet(stored(rest, "topk-rest")), "topk-found")), blocks


def _sent(queries: DataFrame, bounds: DataFrame, width: int, best: bool) -> DataFrame:
    """Queries (query_key, query_id, q, floor) with a segment: the one with the best bound, or each whose bound reaches the floor.

    The segments' bounds are sent to the queries, at most ``BOUNDS_BYTES`` at once; no vector moves for it.
    """
    spark, per = queries.sparkSession, max(1, BOUNDS_BYTES // (16 * width))
    last, found = bounds.agg(F.max("segment")).first()[0], None
    for at in range(0, last + 1, per):
        table = bounds.where(F.col("segment").between(at, at + per - 1)).toArrow()
        shared = spark.sparkContext.broadcast((table["segment"].to_numpy(), *(_matrix(table[c].combine_chunks(), width) for c in ("top", "low"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, top, low = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    q = _matrix(part.column("q"), width)
                    kind = _exact(np.concatenate([top, low]), q)
                    bound = np.maximum(q, 0).astype(kind) @ top.astype(kind).T + np.minimum(q, 0).astype(kind) @ low.astype(kind).T
                    if best:
                        row, col = np.arange(len(q)), np.argmax(bound, axis=1)
                    else:
                        row, col = np.nonzero(np.stack([b >= f if f is not None else np.ones(len(b), bool) for b, f in zip(bound, part.column("floor").to_pylist(), strict=True)]).astype(bool))
                    limit = [str(int(x)) for x in bound[row, col]] if best else [None] * len(row)
                    taken = part.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(names[col], pa.int32()), pa.array(limit, pa.string()), *(taken.column(c) for c in ("query_key", "query_id", "q", "floor"))], names=["segment", "bound", "query_key", "query_id", "q", "floor"])

        part = queries.select("query_key", "query_id", "q", "floor").mapInArrow(run, "segment int, bound string, query_key long, query_id long, q array<long>, floor long")
        found = part if found is None else found.unionByName(part)
    if best and last >= per:
        found = found.groupBy("query_key").agg(F.max_by(F.struct("segment", "query_id", "q", "floor"), F.col("bound").cast("double")).alias("c")).select("query_key", "c.*")
    return found.select("segment", "query_key", "query_id", "q", "floor")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK_ROWS, segment: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller vec_id.

    ``rows`` and ``queries`` have vec_id and v (integers). Rows in order of a clustering and of vec_id are cut into segments of
    consecutive rows, and these into blocks. Each query is first sent to the segment with the best bound, which gives a
    score to beat, then to each other segment whose bound reaches that. Every segment's rows are shuffled at most twice, however
    many queries there are, and queries stream past them; only the k best of a segment are shuffled on. How far queries
    spread depends on the data: where no bound is below the kth score, each query meets each segment.

    Products are exact: in doubles below 2**53, else in longs, else in Python's integers; a score that fits no long fails.
    A candidate that has the query's vec_id is the query's own row and takes no part. Of rows repeated whole one
    counts; rows of one vec_id with different vectors are candidates (or queries) each, and their answers come
    under that id. Null vec_ids take no part. Vectors of unequal length meet as if padded with zeros. Fewer candidates
    give fewer ranks; no queries or no rows give no rows.
    """
    if (found := _found(rows, queries, k, block, segment)) is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))
    return found[0].where("vec_id is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruned_share(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK_ROWS, segment: int | None = None) -> float:
    """Share of all pairs of a query and a block that ``top_k`` does not score; 0 without rows or queries."""
    if (found := _found(rows, queries, k, block, segment)) is None:
        return 0.0
    n, scored = found[0].agg(F.count_distinct("query_key"), F.sum("scored")).first()
    return 1 - scored / (n * found[1])


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
