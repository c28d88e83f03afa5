"""Sharding, exact dedup, packing, token counts and top-k against brute force, with awkward rows."""

import hashlib
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, mixing, packing, sharding, token_counts, tokens, topk
from lectern.llm.packing import Packer
from lectern.llm.token_counts import vocabulary
from lectern.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"
AWKWARD = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "é É"), (5, "é É"), (None, "lost"), (None, None), (7, "word " * 40_000), (8, "ÉÉ"), (9, "éé"), (10, "SAME TEXT")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, KEPT string, `group` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 1, "x", "y") for i, t in AWKWARD], DOCS).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest_all", [True, False])
def test_duplicate_groups(docs, empty, digest_all):
    rows = [tuple(r) for r in exact_dedup.duplicate_groups(docs, digest_all=digest_all, prefix_chars=4).select("doc_id", "keep_id", "group_size", "kept").collect()]
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[fold(t)].append(i)
    key = lambda r: tuple(map(str, r))
    expected = []
    for g in groups.values():
        g = sorted(g, key=lambda j: (j is not None, j), reverse=True)
        expected += [(j, g[0], len(g), at == 0) for at, j in enumerate(g)]  # one row of a group stays, repeated rows too
    assert sorted(rows, key=key) == sorted(expected, key=key)
    if digest_all:
        digests = {(r["doc_id"], r["text_sha256"]) for r in exact_dedup.duplicate_groups(docs, True).collect()}
        assert digests == {(i, hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in AWKWARD}
    assert exact_dedup.duplicate_groups(empty, digest_all).count() == 0


def test_drop_duplicates_keeps_columns(docs, empty):
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["10", "4", "5", "None", "7", "8", "9"])  # the null id without a text goes with 4
    assert exact_dedup.drop_duplicates(empty).count() == 0


def test_dropping_copies_keeps_other_texts_of_the_doc_id(spark):
    rows = [(7, "a"), (7, "b"), (9, "A"), (5, "c")]
    left = exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, left.collect())) == [(5, "c"), (7, "b"), (9, "A")]


def test_dropping_copies_among_null_ids(spark):
    """Rows without a doc_id are told apart by their texts; of copies among them, or of rows repeated whole, one stays."""
    rows = [(None, "A", 1), (None, "a", 2), (None, "a", 2), (None, "other", 3), (3, "x", 4), (3, "x", 4), (3, "X", 5), (None, "x", 6), (3, "y", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, gone_doc int")
    left = exact_dedup.drop_duplicates(table)
    assert left.columns == table.columns
    assert sorted((str(r["doc_id"]), fold(r["text"])) for r in left.collect()) == [("3", "x"), ("3", "y"), ("None", "a"), ("None", "other")]
    groups = exact_dedup.duplicate_groups(table).collect()
    assert sum(r["kept"] for r in groups) == 4 and len(groups) == len(rows)


def jump(key, shards):
    b = j = 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 3, 40, 97, 1000])
def test_jump(spark, shards):
    rows = sharding.assign(spark.range(-50, 500).withColumnRenamed("id", "doc_id"), shards).collect()
    for r in rows:
        key = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:16], 16)
        assert (r["shard"], r["grown_shard"]) == (jump(key, shards), jump(key, shards + 1))
        assert r["grown_shard"] in (r["shard"], shards)


def test_slots_are_gapless(spark):
    rows = spark.range(3000).withColumnRenamed("id", "doc_id").unionByName(spark.range(5).withColumnRenamed("id", "doc_id"))
    one = sharding.number(sharding.assign(rows, 7), 3005, "doc_id", [], slot_rows=50).collect()
    two = sharding.number(sharding.assign(rows, 7), 3005, "doc_id", [], slot_rows=10_000).collect()
    assert sorted((r["shard"], r["slot"], r["doc_id"]) for r in one) == sorted((r["shard"], r["slot"], r["doc_id"]) for r in two)
    slots = defaultdict(list)
    for r in one:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_of_a_key_with_most_rows(spark):
    """A third of the rows has no key: they come last in their shard, cut by their ties, and numbers stay gapless."""
    rows = [(None if i % 3 == 0 else i, i) for i in range(3000)] + [(None, 0), (5, 5)]
    table = spark.createDataFrame(rows, "doc_id long, size long").selectExpr("doc_id", "size", "size AS _range", "'x' AS `KEY_HIGH`", "1 AS at")
    got = sharding.number(sharding.assign(table, 7), len(rows), "doc_id", ["size"], slot_rows=100)
    assert set(table.columns) | {"shard", "grown_shard", "slot"} == set(got.columns)
    got = got.collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), n) for i, n in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"] is None))
    for s in slots.values():
        assert [at for at, _ in sorted(s)] == list(range(len(s)))
        assert [late for _, late in sorted(s)] == sorted(late for _, late in s)


def test_sharding_of_awkward_rows(docs, empty):
    assert sharding.number(sharding.assign(docs.select("doc_id"), 40), 12, "doc_id", []).count() == len(AWKWARD)
    assert sharding.number(sharding.assign(empty.select("doc_id"), 40), 0, "doc_id", []).count() == 0


SPACES = ["a  b", " a", "a ", "  ", "", " ", "a\n b", "a \nb", "x\n \n y", "tab\t tab", "nb\u00a0 sp", "a\u2028 b", "don't I'll", "<|endoftext|>", "x<|endoftext|> y", "é€😀 ß", "12 345,67", "a" * 500, "... !!!\r\n\r\n q"]


def test_encoder_equals_the_library(spark, tokenizer):
    rng = random.Random(5)
    pieces = ["the", "Ünd", "x1", "'s", " ", "  ", "\n", "\t", "\u00a0", "<|endoftext|>", ",", "12", "😀", "\x1c", "\x85"]
    texts = SPACES + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    ids, count = Encoder(vocabulary()), Encoder(vocabulary(), counts_only=True)
    assert ids.ranks
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == e.ids, repr(text)
        assert count.encode(text) == len(e.ids)


def test_tasks_of_a_worker_share_one_encoder(monkeypatch):
    """Counting and packing in many tasks makes one encoder each, not one for each task."""
    made, init = [], tokens.Encoder.__init__
    monkeypatch.setattr(tokens.Encoder, "__init__", lambda self, *a, **b: made.append(a) or init(self, *a, **b))
    tokens.encoder.cache_clear()
    batch = pa.RecordBatch.from_pydict({"digest": [b"x"], "text": ["two words"]})
    counted = [b.column("n_tokens").to_pylist() for _ in range(3) for b in token_counts._counter(vocabulary())(iter([batch, batch]))]
    assert len(counted) == 6 and len({str(c) for c in counted}) == 1
    assert len(made) == 1
    tokens.encoder.cache_clear()


def test_every_code_point(tokenizer):
    """Each assigned code point alone, after a letter and before a space gets the library's number of tokens."""
    e = Encoder(vocabulary(), counts_only=True)
    assigned = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ["".join(f"a{c}{c} {c}b" for c in assigned[at : at + 40]) for at in range(0, len(assigned), 40)]
    for text, known in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.encode(text) == len(known.ids), text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(name):
    path = vocabulary(name)
    e = Encoder(path, counts_only=True)
    if name.endswith(".model"):
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        known = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    for text in SPACES:
        assert e.encode(text) == len(known(text))


def test_counts_and_cache(spark, docs, empty, tokenizer, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = token_counts.count_tokens(docs, vocabulary(), cache, limit=100).collect()
    expected = sorted(((str(i), len((t or "").encode()), n, n > 100) for i, t in AWKWARD for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids)]))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == expected
    stored = spark.read.parquet(f"{tmp_path}/cache/*")
    distinct = len({t or "" for _, t in AWKWARD})
    assert stored.count() == distinct
    more = docs.unionByName(spark.createDataFrame([(99, "brand new", "en", "s", 1, "", "")], DOCS))
    again = token_counts.count_tokens(more, vocabulary(), cache)
    assert again.count() == len(AWKWARD) + 1
    assert spark.read.parquet(f"{tmp_path}/cache/*").count() == distinct + 1  # hits were not encoded again
    assert token_counts.count_tokens(empty, vocabulary(), f"{cache}2").count() == 0


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_misses_are_encoded_once(spark, docs, monkeypatch, most):
    """One text per digest that the cache lacks, whichever set is small enough to be sent to the texts."""
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    each = texts.groupBy("digest", "doc_id").count().groupBy("digest").agg(F.sum("count").alias("rows"), F.min(F.struct("doc_id", "count")).alias("of")).select("digest", "rows", F.col("of.doc_id").alias("owner"), F.col("of.count").alias("owned"))
    hit = each.where("rows = 1").orderBy("digest").limit(2)
    got = token_counts._misses(texts, each.join(hit, "digest", "left_anti"), hit.select("digest")).collect()
    expected = {t or "" for _, t in AWKWARD} - {r["text"] for r in texts.join(hit, "digest", "left_semi").collect()}
    assert sorted(r["text"] for r in got) == sorted(expected)


def unpack(rows, sizes, end=True):
    """Each document's ids from its pieces; checks sequences on the way."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return by_doc, by_sequence


def test_packing_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.pack(docs, vocabulary()).collect()
    by_doc, by_sequence = unpack(rows, None)
    for d in docs.collect():
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[d["doc_id"]], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == list(np.cumsum([0] + [p["length"] for p in pieces])[:-1])
        assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == ids
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    lengths = [sum(p["length"] for p in s) for s in by_sequence.values()]
    partial = [n for n in lengths if n & (n - 1)]
    assert len(partial) <= docs.rdd.getNumPartitions() and {n for n in lengths if n not in partial} <= {256, 512, 1024, 2048}
    groups = defaultdict(int)
    for s in by_sequence.values():
        groups[s[0]["step_group"]] += sum(p["length"] for p in s)
    assert all(n <= packing.STEP_TOKENS for n in groups.values())
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.pieces(packing.pack(docs, vocabulary())).collect()}
    assert crc == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in rows}


@pytest.mark.parametrize("seed", range(6))
def test_packer_wastes_one_window(seed):
    rng = random.Random(seed)
    packer = Packer()
    sizes = [rng.choice([1, 5, 255, 256, 257, 700, 2048, 2049, 5000, rng.randint(1, 3000)]) for _ in range(200)]
    for i, n in enumerate(sizes):
        packer.add(i, np.full(n, i, "<u4").tobytes())
        if i % 37 == 0:
            packer.pack()
    packer.pack(last=True)
    keys = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
    rows = [dict(zip(keys, r, strict=True)) for r in packer.out]
    by_doc, by_sequence = unpack(rows, sizes)
    assert {i: sum(p["length"] for p in ps) for i, ps in by_doc.items()} == dict(enumerate(sizes))
    lengths = [sum(p["length"] for p in s) for s in by_sequence.values()]
    assert sum(n not in (256, 512, 1024, 2048) for n in lengths) <= 1


def test_packing_of_awkward_rows(docs, empty):
    rows = packing.pack(docs, vocabulary()).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (3, 4)) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 7) > 40_000
    assert packing.pack(empty, vocabulary()).count() == 0


def brute(vectors, k):
    found = []
    for q, v in vectors:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for c, w in vectors if c != q)[:k]
        found += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return found


@pytest.mark.parametrize(("block", "segment", "most"), [(4, 30, 1), (64, 1000, 64 << 20), (7, 50, 200)])
def test_topk_equals_brute_force(spark, monkeypatch, block, segment, most):
    """Blocks, segments and parts of the bounds of several sizes; ``most`` bytes make the bounds go out in parts."""
    monkeypatch.setattr(topk, "BOUNDS_BYTES", most)
    rng = random.Random(block)
    vectors = [(i * 3, [rng.randint(-3, 3) for _ in range(4)]) for i in range(120)]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    found = topk.top_k(rows, rows, block=block, segment=segment)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == sorted(brute(vectors, 5))


@pytest.mark.parametrize("size", [1e5, 4e8, 3e9])
def test_topk_of_large_components(spark, size):
    """Scores beyond 2**53 are exact as long as they fit a long; one huge row among small ones too."""
    rng = random.Random(int(size))
    vectors = [(i, [int(rng.uniform(-size, size)) for _ in range(2)]) for i in range(60)] + [(99, [2**62, 0]), (100, [0, 1])]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    some = [v for v in vectors if v[0] % 7 == 0 or v[0] == 100] if size < 1e6 else [(100, [0, 1])]
    asked = spark.createDataFrame([(i, [0, v[1]]) for i, v in some], "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(rows, asked, k=5, block=8, segment=20).collect())
    expected = []
    for q, v in [(i, [0, v[1]]) for i, v in some]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in vectors if c != q)[:5]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(expected)
    both = spark.createDataFrame([v for v in vectors if v[0] < 60], "vec_id long, v array<long>")
    if size < 2e9:  # scores below 2**63, of all components
        assert sorted(tuple(r) for r in topk.top_k(both, both, block=8, segment=20).collect()) == sorted(brute([v for v in vectors if v[0] < 60], 5))


def test_topk_prunes_clustered_vectors(spark):
    """Vectors around a few directions, in an order that mixes them: most blocks are never scored, answers stay exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (12, 16))
    vectors = [(int(i), [int(x) for x in centres[i % 12] + rng.normal(0, 15, 16)]) for i in range(1500)]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    asked = rows.where("vec_id % 50 = 0")
    assert topk.pruned_share(rows, asked, block=16, segment=300) > 0.5
    found = sorted(tuple(r) for r in topk.top_k(rows, asked, block=16, segment=300).collect())
    assert found == sorted(r for r in brute(vectors, 5) if r[0] % 50 == 0)


def test_topk_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1), (50, [0.1, -0.2], 1), (50, [0.1, -0.2], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = topk.integer_vectors(table)
    found = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect())
    assert found == [(0, 1, 5, 49152), (0, 2, 50, -128), (50, 1, 0, -128), (50, 2, 5, -6912)]
    assert topk.top_k(v.where("false"), v).count() == 0 and topk.top_k(v, v.where("false")).count() == 0


def test_pruning_keeps_the_best():
    """Sorted rows: all but a few blocks have bounds below the kth score."""
    rng = np.random.default_rng(0)
    vectors = np.sort(rng.integers(0, 1000, (1000, 1)), axis=0)
    _, _, scores, scored = next(topk.Segment(np.arange(1000), vectors, 50).search(np.array([-1]), np.array([[1]]), [None], 5))
    assert [int(s) for s in scores] == sorted(vectors[:, 0].tolist())[::-1][:5] and scored < 5


def filled(has, share, total):
    """Goals by share that nothing exceeds: values that would exceed what they have are full, the rest share what is left."""
    full = set()
    while True:
        left, shares = total - sum(has[v] for v in full), sum(n for v, n in share.items() if v not in full)
        over = {v for v in share if v not in full and share[v] * left > has[v] * shares}
        if not over:
            return {v: has[v] if v in full else share[v] / shares * left if share[v] else 0.0 for v in share}
        full |= over


def marginals(cells, rate, weights=None):
    found, sums = {}, {}
    for at, d in enumerate(mixing.DIMENSIONS):
        has = defaultdict(float)
        for c in cells:
            has[c[at]] += c[3]
        sums[d] = has, {v: (weights or {}).get(d, {}).get(v, 0.0) if d in (weights or {}) else n**mixing.POWER for v, n in has.items()}
    total = min(min(sum(has.values()) * rate, sum(has[v] for v in share if share[v] > 0)) for has, share in sums.values())
    return {d: filled(has, share, total) for d, (has, share) in sums.items()}


@pytest.mark.parametrize(("most", "weights"), [(50_000, None), (7, None), (50_000, {"lang": {"x": 3, "y": 1, "z": 5}}), (7, {"source": {"a": 1, "b": 1, "c": 2, "d": 1}, "lang": {"x": 2, "y": 1}})])
def test_mixing_meets_marginals(spark, monkeypatch, most, weights):
    """Within the tolerance of the feasible goals, in one part of the cell table and in several."""
    monkeypatch.setattr(mixing, "CELLS", most)
    rng = random.Random(1)
    cells = [(s, lang, t, rng.randint(100, 9000)) for s in "abcde" for lang in ("x", "y") for t in ("p", "q")] + [("f", "x", "p", 3)]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, _tokens long")
    rate = 0.2 if weights and "source" in weights else 0.5
    got, gap = mixing.rake(table, mixing.DIMENSIONS, weights, rate=rate)
    got = got.join(table, list(mixing.DIMENSIONS)).collect()
    assert gap < mixing.TOLERANCE and len(got) == len(cells)
    for d, goal in marginals(cells, rate, weights).items():
        kept = defaultdict(float)
        for r in got:
            kept[r[d]] += r["_tokens"] * r["probability"]
        for v in goal:
            assert abs(kept[v] - goal[v]) <= 0.003 * goal[v] + 0.01, (d, v)


def test_mixing_of_whole_documents_meets_marginals(spark):
    """Every marginal of the table is within a hundredth of its feasible goal, and so is what is sampled in all."""
    rows = mixing.op1_mixing(spark, "/root/testdata/sf0.01").collect()
    cells = defaultdict(float)
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["est_tokens"]
    for d, goal in marginals([(*k, n) for k, n in cells.items()], mixing.RATE).items():
        kept = defaultdict(float)
        for r in rows:
            kept[r[d]] += r["est_tokens"] * r["probability"]
        assert all(abs(kept[v] - goal[v]) <= 0.01 * goal[v] for v in goal), d
    total = sum(cells.values())
    assert abs(sum(r["est_tokens"] for r in rows if r["sampled"]) / total - mixing.RATE) < 0.05


def test_contradicting_marginals_are_reported(spark):
    """One language has only one source, so their weights cannot both be met: the gap says so."""
    table = spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 100)], "source string, lang string, topic string, _tokens long")
    _, gap = mixing.rake(table, mixing.DIMENSIONS, {"source": {"a": 3, "b": 1}, "lang": {"x": 1, "y": 3}}, rate=0.3, rounds=8)
    assert gap > 0.5


def test_very_long_texts_are_mixed_and_sharded(spark):
    rows = spark.createDataFrame([(i, "word " * (60_000 if i == 3 else 5), "en", "s", 1) for i in range(40)] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = {r["doc_id"]: r for r in mixing.mix(rows).collect()}
    assert mixed[3]["_tokens"] == 75_000 and len(mixed) == 41 and all(0 <= r["probability"] <= 1 for r in mixed.values())
    plain = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    assert max(r["size"] for r in sharding.number(sharding.assign(plain, 4), 41, "doc_id", ["size"]).collect()) == 300_000


def test_mixing_by_given_topics_and_counts(spark):
    rows = spark.createDataFrame([(i, "t", "en", "s", "kind" + str(i % 2), 10, 0.5) for i in range(50)], "doc_id long, text string, lang string, source string, subject string, n long, cell_probability double")
    got = mixing.mix(rows, topic_of=F.col("subject"), tokens_of=F.col("n"))
    assert {(r["_topic"], r["_tokens"]) for r in got.collect()} == {("kind0", 10), ("kind1", 10)} and "cell_probability" in got.columns


def test_mixing_of_awkward_rows(docs, empty):
    rows = mixing.mix(docs, rate=1.0).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["probability"] <= 1 for r in rows)
    same = [r["sampled"] for r in rows if r["doc_id"] == 5]
    assert same[0] == same[1]
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0
