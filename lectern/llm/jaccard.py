"""Sets of shingles: their hashes, sketches that rule pairs out, and the exact Jaccard similarity of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, cut, stored, text_or_empty, workspace

SEED = 42
#: Bits of a set's parities, in words of 64: bit i tells whether an odd number of its hashes begins with i.
ODD_WORDS = 8

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 hashes of all shingles of the A-Z-lower-cased words, sorted; a text of fewer words has one, all of them."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().translate(_FOLD).split()
    parts = (tokens[i:] for i in range(min(words, len(tokens))))
    return np.unique(np.fromiter(map(partial(xxh64_intdigest, seed=SEED), map(b" ".join, zip(*parts, strict=False))), np.uint64))


def node_of(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(hashes.tobytes(), seed=SEED)], np.uint64).view(np.int64)[0])


def parities(hashes: np.ndarray) -> list[int]:
    """Where the parities of two sets differ there is a shingle that only one has, so the sets differ in as many at least."""
    odd = np.bincount((hashes >> np.uint64(64 - (64 * ODD_WORDS - 1).bit_length())).astype(np.int64), minlength=64 * ODD_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b of ``nodes`` (node, text_key) whose whole sets have that Jaccard similarity or more.

    Sets are made again, for one text of each node in a pair. They travel once to each pair of a node, so a caller
    gives few pairs a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            sets = [shingles(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "found"])

    pairs = cut(pairs.distinct())
    if pairs.isEmpty():
        return pairs.select("a", "b")
    with workspace(pairs.sparkSession):  # sets are larger than the texts, and go
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = bounded(stored(nodes.select("node", "text_key").join(ends, "node"), "near-wanted"))
        texts = docs.select(F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text")).join(wanted, "text_key").select("node", "text").dropDuplicates(["node"])
        sets = stored(texts.mapInArrow(run, "node long, found array<long>"), "near-sets")
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("found").alias(f"found_{end}")), end)
        both = F.size(F.array_intersect("found_a", "found_b"))
        return cut(pairs.where(both / (F.size("found_a") + F.size("found_b") - both) >= similarity).select("a", "b"))
