"""Hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .token_counts import vocabulary
from .tokens import encoder

#: Window lengths; tokens of a step group; tokens a task packs at once.
TIERS, STEP_TOKENS, CHUNK_TOKENS = (256, 512, 1024, 2048), 16_384, 2_000_000
END_ID = 1

FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the documents of one task; sequences and step groups are numbered from ``first``.

    A piece is (length, order, doc_id, ids, start): a span of a document's ids. ``order`` breaks ties, so the
    same rows in the same order always give the same sequences.
    """

    def __init__(self, first: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.held = self.orders = 0
        self.sequence = self.group = first
        self.open: list[list[int]] = []
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        """Cuts whole longest windows off, and routes what is left to the smallest tier that holds it."""
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self._emit([(top, 0, doc_id, ids, at)], top)
            at += top
        if at < n:
            self._route((n - at, self._order(), doc_id, ids, at))
            self.held += n - at

    def _order(self) -> int:
        self.orders += 1
        return self.orders

    def _route(self, piece: tuple) -> None:
        insort(self.pools[next(t for t in self.tiers if piece[0] <= t)], piece)

    def _fit(self, gap: int, below: int):
        """The longest whole piece of a shorter tier that fits; else one to cut, of a shorter tier if there is any."""
        for t in reversed([t for t in self.tiers if t < below]):
            pool = self.pools[t]
            if (i := bisect_right(pool, (gap, self.orders + 1))) > 0:
                return pool.pop(i - 1)
        for t in self.tiers:
            if self.pools[t]:
                return self.pools[t].pop()
        return None

    def pack(self, last: bool = False) -> None:
        """Fills windows, longest tier first, until no piece is left to close a gap. The one open window's pieces
        wait for more documents; at the ``last`` call they become the task's only padded sequence."""
        for t in reversed(self.tiers):
            while self.pools[t]:
                window, gap = [piece := self.pools[t].pop()], t - piece[0]
                while gap and (piece := self._fit(gap, t)):
                    if piece[0] > gap:
                        n, _, doc_id, ids, at = piece
                        self._route((n - gap, self._order(), doc_id, ids, at + gap))
                        piece = (gap, 0, doc_id, ids, at)
                    window.append(piece)
                    gap -= piece[0]
                if not gap or last:
                    self._emit(window, t)
                    continue
                for piece in window:
                    self._route((piece[0], self._order(), *piece[2:]))
                self.held = sum(p[0] for p in window)
                return
        self.held = 0

    def _emit(self, window: list[tuple], tier: int) -> None:
        size = sum(p[0] for p in window)
        group = next((g for g in self.open if g[1] + size <= self.step_tokens), None)
        if group is None:
            self.open.append(group := [self.group, 0])
            self.group += 1
        group[1] += size
        if group[1] >= self.step_tokens:
            self.open.remove(group)
        at = 0
        for n, _, doc_id, ids, start in window:
            self.out.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, self.sequence, at, tier, group[0]))
            at += n
        self.sequence += 1

    def taken(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.out), 2000):
            columns = zip(*self.out[i : i + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)], names=[n for n, _ in FIELDS])
        self.out = []


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Packs every document's ids and an end id into windows of the given tiers (powers of two).

    Documents go to the smallest tier that holds them (what exceeds the longest tier is first cut into whole
    longest windows). Each tier's windows, longest first, take their own documents and fill the gap with the
    longest whole pieces of shorter tiers that fit, then with a cut piece. So every window is full, but for one per
    task. Full windows of any tiers are gathered into step groups of equal token count.

    Tasks pack their own rows only: nothing is shuffled, memory is bounded by ``CHUNK_TOKENS`` and one document,
    and a task that runs again gives the same sequences. One row per piece: doc_id, start, length, ids (unsigned
    32-bit little-endian), doc_tokens, sequence_id (unique, not gapless), offset, tier, step_group.

    A null text counts as empty and is packed as its end id alone; null doc_ids stay null; repeated rows are packed
    each; other columns are not read; no rows give no rows.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, tiers, step_tokens)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                packer.add(doc_id, encode(text.as_py() or "") + end)
                if packer.held >= CHUNK_TOKENS:
                    packer.pack()
                if len(packer.out) >= 2000:
                    yield from packer.taken()
        packer.pack(last=True)
        yield from packer.taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def pieces(packed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()))
