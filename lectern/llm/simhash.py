"""SimHash near-duplicates by multi-index hashing: Hamming balls in each segment, table matches, full distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import jaccard
from .common import bounded, cut, keep_judged, scratch, stored, text_or_empty, tidy, workspace
from .components import components

BITS, SEED = 64, 42
#: The contract's shingle length and largest distance.
WORDS, MAX_BITS, SEGMENTS = 3, 3, 2
#: Shingles whose bits are added up at once.
BLOCK = 32_768
#: Hashes of a set whose mixed bits are added up at once.
SET_BLOCK = 4_096

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 majority bits over the XXH64 (seed 42) of all shingles of the A-Z-lower-cased words, as a signed long.

    Words are runs of bytes other than space and 9-13. A text of fewer words has one shingle, all of them; a text
    without words (or null) has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().translate(_FOLD).split()
    if not tokens:
        return 0
    n, width, hashed = max(1, len(tokens) - words + 1), min(words, len(tokens)), partial(xxh64_intdigest, seed=SEED)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = tokens[at : min(n, at + BLOCK) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        h = np.fromiter(map(hashed, shingles), np.uint64)
        counts += np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (signed long) per row, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t.as_py(), words) for t in b.column("text")], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(segments: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment: two fingerprints at ``max_bits`` or fewer meet within the radius in one."""
    each, over = divmod(max_bits, segments)
    edges = [BITS * i // segments for i in range(segments + 1)]
    found = [(lo, hi - lo, each if i <= over else each - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return [s for s in found if s[2] >= 0]


def _key(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def near_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) that differ in at most ``max_bits`` bits, each at least once.

    Each segment has a table of its values. A fingerprint looks up every value in the Hamming ball around its own
    one; of two values it is the one with a zero at their lowest differing bit that looks, so half the ball is
    enumerated. What meets is verified over all 64 bits. A fingerprint has at most 43 744 others within three bits,
    so the pairs are linear in distinct fingerprints, however large a group of copies is. The planner takes an exploded ball
    for as large as what it was made of, so the join says that it is none to broadcast.
    """
    tables = probes = None
    for i, (low, width, radius) in enumerate(_segments(segments, max_bits)):
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        key = _key(F.col("fp"), low, width)
        table = distinct.select(F.lit(i).alias("segment"), key.alias("key"), F.col("fp").alias("b"))
        ball = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: key.bitwiseAND(m).bitwiseAND(-m) == 0)
        probe = distinct.select(F.lit(i).alias("segment"), F.col("fp").alias("a"), key.alias("own"), F.explode(ball).alias("mask"))
        probe = probe.select("segment", "a", F.col("own").bitwiseXOR(F.col("mask")).alias("key"), (F.col("mask") == 0).alias("same"))
        tables, probes = (table, probe) if tables is None else (tables.unionByName(table), probes.unionByName(probe))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probes.join(tables.hint("merge"), ["segment", "key"]).where(close & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")


def near_groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp and component_id per row: the smallest doc_id reachable over links of ``max_bits`` bits or fewer.

    Equal fingerprints (exact copies, texts without words, nulls) are one node, so copies are never paired.
    Null doc_ids are kept and never smallest (a component of nulls only has id null); repeated rows are kept;
    other columns are not read; no rows give no rows.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(near_pairs(nodes.select("fp"), max_bits, segments)).select(F.col("node").alias("fp"), "root"))
    linked = nodes.join(roots.hint("merge"), "fp")
    least = bounded(stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "fingerprint-least"))
    linked = linked.join(least, "root").select("fp", F.col("component_id").alias("_linked"))
    ids = stored(nodes.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("_linked", "least").alias("component_id")), "fingerprint-ids")
    return rows.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


#: Shares of links that the candidate search may miss, at the stated similarity itself (above it misses fall fast).
LOSS = 0.002
#: Least width of a segment; from 2**(WIDTH + 4) rows on a segment is a bit wider for each doubling, so that chance meetings do not grow.
WIDTH = 14
#: Rounds in which each text is compared with one text of each of its values, before all pairs between groups are.
STARS = 3
#: Of the texts that a text meets in a round, so many are compared whole.
TRIED = 2
#: A segment's value is crowded beyond two texts of a size class and so many times the usual number of that class.
CROWD = 3
#: From so many of a group's texts on, those that look up a crowded value do not meet their own group there. For fewer, another row costs more.
BIG = 8
#: What a text brings along where whole fingerprints are compared.
WHOLE = ("id", "head", "group", "fp", "size", "odd")
#: What it brings along where it is looked up by 128 bits.
SLIM = ("id", "head", "tail", "group")
#: Segments that are looked up at once, or as many as give so many values. A segment's lookups are some 8 to 19 slim rows a text, so a turn's shuffle is a small share of the input at any size.
TURN, TURN_VALUES = 4, 1_000_000


def flip_share(similarity: float) -> float:
    """Share of bits in which fingerprints of sets of that Jaccard similarity differ: angle / pi, where sets of equal
    size have cosine 2s / (1 + s) and others a larger one."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def scheme(rows: int, similarity: float, loss: float = LOSS) -> tuple[int, int]:
    """(segments, width): as many segments as make a pair of that similarity meet within one bit in one of them, but for
    a share of ``loss``."""
    width = max(WIDTH, rows.bit_length() - 4)
    p = flip_share(similarity)
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return max(1, int(np.ceil(np.log(loss) / np.log1p(-meet)))) if p else 1, width


def set_fingerprint(hashes: np.ndarray, words: int) -> list[int]:
    """``words`` times 64 majority bits over a set of 64-bit hashes, each counted once, as signed longs. Zeros for none.

    Each further 64 bits mix the hashes with odd multipliers of their own.
    """
    if not len(hashes):
        return [0] * words
    counts, factors = np.zeros(BITS * words, np.int64), (np.random.default_rng(SEED).integers(0, 1 << 63, words, np.uint64) << np.uint64(1)) | np.uint64(1)
    for at in range(0, len(hashes), SET_BLOCK):
        h = hashes[at : at + SET_BLOCK, None]
        mixed = (h ^ (h >> np.uint64(31))) * factors
        mixed ^= mixed >> np.uint64(32)
        counts += np.add.reduce(np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<i8").tolist()


def signatures(docs: DataFrame, words: int, longs: int) -> DataFrame:
    """doc_id, text_key (XXH64 of the text), node (texts with equal shingle sets share it), size, odd (parities) and fp of its set per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            sets = [jaccard.shingles(t.as_py(), words) for t in b.column("text")]
            lists = (pa.array(map(f, sets), pa.list_(pa.int64())) for f in (jaccard.parities, partial(set_fingerprint, words=longs)))
            made = [pa.array(map(jaccard.node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *made], names=["doc_id", "text_key", "node", "size", "odd", "fp"])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, node long, size int, odd array<long>, fp array<long>")


def _apart(column: str, words: int) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{column}_a")[i].bitwiseXOR(F.col(f"{column}_b")[i])) for i in range(words)])


class Similar:
    """Links between nodes (node, size, odd, fp, text_key) whose sets have a Jaccard similarity, by multi-index hashing.

    A fingerprint's segments each have a table. Sizes of sets that similar differ by that factor at most, so a table's
    key is a segment's value and a class of sizes, and an entry stands under its own class and both neighbours.
    """

    def __init__(self, nodes: DataFrame, docs: DataFrame, words: int, similarity: float, segments: int, width: int, longs: int):
        self.nodes, self.docs, self.words, self.similarity, self.segments, self.width = nodes, docs, words, similarity, segments, width
        share = flip_share(similarity)
        limit = lambda bits: round(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)
        a, b = F.col("size_a"), F.col("size_b")
        # over the last 64 bits, which are in no segment; over the last 128, which travel with every row that is looked up; over all bits, and what sizes and parities prove
        differing = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
        self.near, self.nearer = differing("head") <= limit(BITS), differing("head") + differing("tail") <= limit(2 * BITS)
        proved = (F.least(a, b) >= similarity * F.greatest(a, b)) & (_apart("odd", jaccard.ODD_WORDS) * (1 + similarity) <= (a + b) * (1 - similarity) + 1e-6)
        self.fits = (_apart("fp", longs) <= limit(BITS * longs)) & proved
        self.plain = nodes.where("size > 0").select(F.col("node").alias("id"), F.col("fp")[longs - 1].alias("head"), F.col("fp")[longs - 2].alias("tail"), "fp", "size", "odd")

    def values(self, first: int = 0, last: int | None = None) -> Column:
        """Array of a long per segment: its number, a place for the class of sizes, its bits."""
        found = []
        for i in range(first, self.segments if last is None else min(last, self.segments)):
            at, off = divmod(i * self.width, BITS)
            bits = F.shiftrightunsigned(F.col("fp")[at], off)
            if off + self.width > BITS:
                bits = bits.bitwiseOR(F.shiftleft(F.col("fp")[at + 1], BITS - off))
            found.append(bits.bitwiseAND(F.lit((1 << self.width) - 1)) + F.lit(i << 52))
        return F.array(*found)

    def size_class(self) -> Column:
        """Sizes within the similarity of each other are in one class or in neighbours; a hair wider, against rounding."""
        return F.floor(F.log(F.col("size")) / float(-np.log(self.similarity) * 1.0001)).cast("long") if self.similarity < 1 else F.lit(0).cast("long")

    def masks(self) -> Column:
        """What a value differs by from those in its ball of radius one."""
        return F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(self.width)])

    def around(self, most: DataFrame) -> DataFrame:
        """value and class, and of the crowded places in ``most`` (key, value, of, most) those that a text with them asks at and stands under, as arrays.

        The places are turned about, the texts are not: those asking at a place have its class, and a one where they differ from
        it has become a zero. So a text is joined once for each segment, however many crowded values its ball has.
        """
        at, near = F.struct("key", "most"), F.explode(F.filter(self.masks(), lambda m: F.col("value").bitwiseAND(m) == m)).alias("mask")
        asks = most.select("value", F.col("of").alias("class"), at.alias("ask"), near).select(F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "class", "ask")
        stands = most.select("value", F.explode(F.array(*[F.col("of") + i for i in (-1, 0, 1)])).alias("class"), at.alias("stand"))
        return asks.unionByName(stands, allowMissingColumns=True).groupBy("value", "class").agg(F.collect_list("ask").alias("asks"), F.collect_list("stand").alias("stands"))

    def ends(self, pairs: DataFrame) -> DataFrame:
        """Pairs a, b that may have the similarity, as their whole fingerprints, sizes and parities say."""
        for end in ("a", "b"):
            pairs = pairs.join(self.plain.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("fp", "size", "odd")]), end)
        return pairs.where(self.fits)

    def checked(self, pairs: DataFrame) -> DataFrame:
        return jaccard.verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), self.nodes, self.docs, self.words, self.similarity)

    def crowded(self) -> DataFrame:
        """key of each value and class of sizes that far more nodes share than usual in that class."""
        rows = self.plain.select(self.size_class().alias("class"), F.explode(self.values()).alias("value"))
        usual = rows.groupBy("class").agg((F.count("*") / (self.segments * 2**self.width)).alias("usual"))  # one row for each class: a logarithm of sizes
        counts = rows.groupBy("value", "class").count().join(F.broadcast(stored(usual, "near-usual")), "class")
        return stored(counts.where(F.col("count") > 2 + CROWD * F.col("usual")).select((F.col("value") + F.shiftleft("class", 40)).alias("key")), "near-crowded")

    def stars(self, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links, id and group): each node is compared with one node of each of its crowded values, ``STARS`` times with
        others as long as that gives links, and decided with one of another group: of the ``TRIED`` nearest by the 64 bits the first that may be similar. That contracts large groups of near copies."""
        key = lambda v: v + F.shiftleft(self.size_class(), 40)
        seen = self.plain.select("id", "head", F.explode(F.transform(self.values(), key)).alias("key"))
        seen = stored(seen.join(bounded(crowded), "key", "left_semi"), "near-values")
        groups, found = self.plain.select("id", F.col("id").alias("group")), None
        if seen.isEmpty():
            return groups.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false"), groups
        for i in range(STARS):
            of = seen.join(groups, "id")
            pick = of.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(i), "id").alias("order"), "id", "head", "group")).alias("c"), F.count("*").alias("n")).where("n > 1")
            pick = stored(pick.select("key", F.col("c.id").alias("b"), F.col("c.head").alias("head_b"), F.col("c.group").alias("group_b")), "near-centres")
            met = of.withColumnsRenamed({"id": "a", "head": "head_a"}).join(pick, "key").where(self.near & (F.col("group") != F.col("group_b")))
            apart = F.bit_count(F.col("head_a").bitwiseXOR(F.col("head_b"))).alias("apart")
            few = met.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct(apart, "b"))), 1, TRIED).alias("c"))  # one for each segment at most
            fit = self.ends(few.select("a", F.explode("c").alias("c")).select("a", "c.b", "c.apart"))
            new = self.checked(fit.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")))
            found = new if found is None else found.unionByName(new)
            if new.isEmpty():
                break
            roots = components(found).select(F.col("node").alias("id"), "root")
            groups = stored(self.plain.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("group")), "near-groups")
        return found, groups

    def links(self) -> DataFrame:
        """Links a, b that join all nodes whose sets have the similarity, but for ``LOSS``.

        After ``stars``, each value's ball of radius one is looked up; of two values the one with a zero at the
        differing bit looks. Segments are looked up in turns, and a turn's shuffle files go with it. Only what meets between
        different groups is kept, so a group's own pairs are never rows. What
        meets is compared over 128 bits that travel with it, 64 of them in no segment, then over all. At values that far more nodes
        than usual share (``CROWD``; near copies of one text, texts around a common passage), whole fingerprints travel and the lookup
        itself compares them; there, nodes of the value's largest group do not look at that group if it is ``BIG``. What is left is decided on whole sets.
        """
        spark, crowded = self.nodes.sparkSession, self.crowded()
        star, groups = self.stars(crowded)
        plain = stored(self.plain.join(groups, "id").withColumn("class", self.size_class()), "near-table")
        place = lambda v, c: v + F.shiftleft(c, 40)
        beside = F.explode(F.array(*[F.col("key") + F.lit(i << 40) for i in (-1, 0, 1)])).alias("key")  # a class of -1 is asked for by none
        crowded = stored(crowded.select(beside).distinct(), "near-crowded-around")
        met, dense = (scratch(spark, f"near-{name}") for name in ("met", "dense"))
        turn = max(TURN, TURN_VALUES // max(1, plain.count()))
        for first in range(0, self.segments, turn):
            with workspace(spark):
                self.look_up(plain, place, crowded, first, first + turn, met, dense)
        met, dense = (spark.read.schema("a long, b long").parquet(path) for path in (met, dense))
        pairs = self.ends(met.distinct()).select("a", "b")
        return star.unionByName(self.checked(pairs.unionByName(dense)))

    def look_up(self, plain: DataFrame, place: Callable, crowded: DataFrame, first: int, last: int, to_met: str, to_dense: str) -> None:
        """Adds pairs that meet in these segments: to ``to_met`` by 128 bits, at crowded values to ``to_dense`` by whole fingerprints."""
        number = F.shiftright("key", 52)
        crowded = bounded(crowded.where((number >= first) & (number < last)))
        rows = plain.select(*SLIM, "class", F.explode(self.values(first, last)).alias("value"))
        around = F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])).alias("of")
        table = rows.select(*SLIM, "value", around).where("of >= 0").withColumn("key", place(F.col("value"), F.col("of")))
        ball = F.explode(F.filter(self.masks(), lambda m: F.col("value").bitwiseAND(m) == 0)).alias("mask")
        asked = rows.select(*SLIM, "class", "value", ball).select(*SLIM, place(F.col("value").bitwiseXOR(F.col("mask")), F.col("class")).alias("key"))
        name = lambda df, end: df.withColumnsRenamed({"id": end} | {c: f"{c}_{end}" for c in {*SLIM[1:], *WHOLE[1:]}})
        other, ordered = F.col("group_a") != F.col("group_b"), (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = name(asked.join(crowded, "key", "left_anti"), "a").join(name(table.select(*SLIM, "key").join(crowded, "key", "left_anti"), "b").hint("merge"), "key").where(self.nearer & other)
        stored(met.select(*ordered).distinct(), "near-met", to_met)

        most = table.join(crowded, "key", "left_semi").groupBy("key", "value", "of", "group").count()
        most = most.groupBy("key", "value", "of").agg(F.when(F.max("count") >= BIG, F.max_by("group", F.struct("count", "group"))).alias("most"))
        texts = rows.join(bounded(stored(self.around(most), "near-around")), ["value", "class"]).drop("value", "class", "tail")
        texts = stored(texts.join(self.plain.select("id", "fp", "size", "odd"), "id"), "near-whole")
        looks = F.explode(F.when(F.col("group") != F.col("most"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("big")
        left = name(texts.select(*WHOLE, F.inline("asks")).select(*WHOLE, "key", looks), "a")
        right = name(texts.select(*WHOLE, F.inline("stands")).select(*WHOLE, "key", F.coalesce(F.col("group") == F.col("most"), F.lit(False)).alias("big")), "b")
        stored(left.join(right.hint("merge"), ["key", "big"]).where(self.near & other & self.fits).select(*ordered).distinct(), "near-dense", to_dense)


def _similar(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows as doc_id, text_key, node; node, root, least for every node)."""
    spark = docs.sparkSession
    segments, width = scheme(docs.count(), similarity)
    longs = -(-segments * width // BITS) + 1
    kept_rows, kept_ids = scratch(spark, "near-rows"), scratch(spark, "near-ids")
    with tidy(spark), workspace(spark):
        rows = stored(signatures(docs, words, longs), "signatures")
        nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("text_key", "size", "odd", "fp")).alias("c"))
        nodes = stored(nodes.select("node", "least", "c.*"), "near-nodes")
        roots = stored(components(Similar(nodes, docs, words, similarity, segments, width, longs).links()), "near-roots")
        ids = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        return stored(rows.select("doc_id", "text_key", "node"), "near-rows", kept_rows), stored(ids, "near-ids", kept_ids)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key (XXH64 of the text) and component_id per row: the smallest doc_id reachable over links of the similarity or more.

    The similarity is that of the sets of ``words``-word shingles of the whole texts. Candidates come from SimHash
    fingerprints of the sets, as long as ``scheme`` asks, by multi-index hashing (see ``Similar``); every link is decided
    on whole sets, so texts below the similarity are never linked directly. Equal sets are one node (texts without words
    too); a component of null ids only has id null; repeated rows are kept; no rows give no rows.
    """
    rows, ids = _similar(docs, words, similarity)
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(stored(ids.join(least, "root").select("node", "component_id"), "near-components"), "node").select("doc_id", "text_key", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``: the one with the smallest doc_id, null last, then the
    smallest hash of its text. All columns are kept.

    A row goes by its doc_id and text, so another text under the same doc_id stays; of rows that share both one
    stays; rows without a doc_id belong to groups like others.
    """
    rows, ids = _similar(docs, words, similarity)
    counted = rows.join(ids.select("node", "root"), "node").groupBy("root", "doc_id", F.col("text_key").alias("own")).agg(F.count("*").alias("n"))
    counted = stored(counted, "near-counted")
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("best"), F.sum("n").alias("all")).where("all > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("own") == F.col("best.own"))
    return keep_judged(docs, counted.join(bounded(stored(first, "near-first")), "root").withColumn("stays", stays))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
