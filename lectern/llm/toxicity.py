"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded, free, give_back, stored

#: Labelled rows that a fit may use: beyond it a sample by a hash of doc_id.
TRAIN_ROWS = 12_000
#: Hash buckets of terms; its factors; features the machine keeps by what each says alone, and by what they add beside another.
BUCKETS, FACTORS, FEATURES, PAIRED = 1 << 18, 8, 1024, 64
#: Rows in which a feature must occur; features beside which all others are tried.
LEAST, STRONG = 5, 128
#: A term in a text at least so many times is a feature of its own.
TIMES = (1, 2, 3, 5)
STEM = 4
#: Words that a worker remembers.
MEMO = 200_000
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 512, 0.02, 1e-4, 7

LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str) -> dict[str, int]:
    """How often each word, and each first ``STEM`` letters of longer words, occur in a text."""
    words = Counter(LETTERS.findall(text.lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        if len(w) > STEM:
            stems["^" + w[:STEM]] += n
    return words | stems


def features(text: str | None) -> list[int]:
    """Hashed features of a text: term and number of times reached; each once."""
    found = set()
    for term, n in terms(text or "").items():
        at = crc32(term.encode()) % BUCKETS * len(TIMES)
        found.update(at + i for i, least in enumerate(TIMES) if n >= least)
    return sorted(found)


class Machine:
    """logit = bias + sum w[i] + sum over pairs of <v[i], v[j]>, over the selected features of a text."""

    def __init__(self, selected: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.index = {int(f): i for i, f in enumerate(selected)}
        self.bias, self.w, self.v = bias, w, v

    def scores(self, found: list[list[int]]) -> np.ndarray:
        """Scores of texts, each given by the places of its selected features."""
        logit = np.full(len(found), self.bias)
        if full := [i for i, f in enumerate(found) if f]:
            at = np.concatenate([found[i] for i in full]).astype(np.int64)
            starts = np.cumsum([0] + [len(found[i]) for i in full[:-1]])
            v = self.v[at]
            pairs = np.add.reduceat(v, starts, axis=0) ** 2 - np.add.reduceat(v**2, starts, axis=0)
            logit[full] += np.add.reduceat(self.w[at], starts) + 0.5 * pairs.sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def score_text(self, text: str | None) -> float:
        return float(self.scores([Finder(self).places(text)])[0])


class Finder:
    """Places of a text's selected features. A word is hashed once by a worker; most words then turn out to matter to no
    selected feature and cost a lookup."""

    def __init__(self, machine: Machine):
        """``by_bucket``: for each bucket with a selected feature, its (times reached, place) pairs."""
        self.by_bucket: dict[int, list[tuple[int, int]]] = {}
        for f, place in machine.index.items():
            self.by_bucket.setdefault(f // len(TIMES), []).append((TIMES[f % len(TIMES)], place))
        of = lambda term: crc32(term.encode()) % BUCKETS
        finder = self

        class Memo(dict):
            def __missing__(self, word):
                if len(self) >= MEMO:
                    self.clear()
                stem = of("^" + word[:STEM]) if len(word) > STEM else None
                self[word] = found = (finder.by_bucket.get(of(word)), word[:STEM] if stem in finder.by_bucket else None, finder.by_bucket.get(stem))
                if found[0] is None and found[1] is None:
                    self[word] = found = None
                return found

        self.memo = Memo()

    def places(self, text: str | None) -> list[int]:
        found, stems, memo = set(), {}, self.memo
        for word, n in Counter(LETTERS.findall((text or "").lower())).items():
            if (known := memo[word]) is not None:
                own, stem, pairs = known
                if own:
                    found.update(place for least, place in own if n >= least)
                if stem is not None:
                    stems[stem] = stems.get(stem, (0, None))[0] + n, pairs
        for n, pairs in stems.values():
            found.update(place for least, place in pairs if n >= least)
        return sorted(found)


def _chi(n: np.ndarray, n1: np.ndarray, rows: int, positive: float) -> np.ndarray:
    """Chi-square of each feature (n rows, n1 of them positive) against the label among ``rows`` rows; 0 below ``LEAST``."""
    expected = n * (positive / rows)
    chi = (n1 - expected) ** 2 / np.maximum(expected * (1 - positive / rows) * (1 - n / (rows + 1)), 1e-9)
    return np.where(n < LEAST, 0, chi)


def select(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features that say most about the label: ``FEATURES`` by chi-square over all rows, and ``PAIRED`` by how much
    larger it is over the rows of one of the ``STRONG`` strongest features. So a word that alone says nothing is
    kept if it does beside another, beyond what chance gives the best of so many pairs. Memory: a few counts per hashed feature and the rows' own features."""
    every, labels = BUCKETS * len(TIMES), y > 0
    n, n1 = np.zeros(every, np.int32), np.zeros(every, np.int32)
    for row, label in zip(found, labels, strict=True):  # each feature occurs once in a row
        n[row] += 1
        if label:
            n1[row] += 1
    alone = _chi(n, n1, len(y), float(labels.sum()))
    order = np.argsort(-alone, kind="stable")
    used = np.flatnonzero(n >= LEAST)
    place = np.zeros(every, np.int32)
    place[used] = np.arange(1, len(used) + 1, dtype=np.int32)  # 0: a feature of too few rows
    strong = order[:STRONG][n[order[:STRONG]] >= LEAST]
    mark = np.full(every, -1, np.int32)
    mark[strong] = np.arange(len(strong), dtype=np.int32)
    with_it: list[list[int]] = [[] for _ in strong]
    for i, row in enumerate(found):
        at = mark[row]
        for f in at[at >= 0]:
            with_it[f].append(i)
    beside = np.zeros(len(used))
    for members in with_it:
        positive = [i for i in members if labels[i]]
        if 0 < len(positive) < len(members):
            c, c1 = (np.bincount(place[np.concatenate([found[i] for i in part])], minlength=len(used) + 1)[1:] for part in (members, positive))
            beside = np.maximum(beside, _chi(c, c1, len(members), len(positive)))
    beside -= alone[used]
    beside[beside < 2 * np.log(max(2, len(used) * STRONG))] = 0  # so many are tried that smaller ones come by chance
    more = used[np.argsort(-beside, kind="stable")[: min(PAIRED, np.count_nonzero(beside))]]
    return np.unique(np.concatenate([order[:FEATURES][alone[order[:FEATURES]] > 0], more]))


def fit(found: list[np.ndarray], y: np.ndarray) -> Machine:
    """Fits the machine to the features (sorted) and labels of rows.

    Features are chosen by ``select``. Adam, mini-batches in a fixed random order,
    the two classes weighted towards each other. Rows of one class only, or none, give a machine that answers their
    share of label 1 (0 without rows). Memory: rows times kept features.
    """
    positive = float(y.sum())
    if not 0 < positive < len(y):
        share = np.clip(positive / max(1, len(y)), 1e-6, 1 - 1e-6)
        return Machine(np.empty(0, int), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    selected = select(found, y)
    place = np.full(BUCKETS * len(TIMES), -1, np.int32)
    place[selected] = np.arange(len(selected))
    x = np.zeros((len(found), len(selected)), bool)
    for i, row in enumerate(found):
        at = place[row]
        x[i, at[at >= 0]] = True

    rng = np.random.default_rng(SEED)
    params = [np.float64(np.log(positive / (len(y) - positive))), np.zeros(len(selected)), rng.normal(0, 0.02, (len(selected), FACTORS))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    weight = np.where(y == 1, min(5.0, (len(y) - positive) / positive), 1.0)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            take = order[at : at + BATCH]
            xb = x[take].astype(np.float32)
            bias, w, v = params[0], params[1].astype(np.float32), params[2].astype(np.float32)
            xv = xb @ v
            logit = bias + xb @ w + 0.5 * ((xv**2).sum(1) - xb @ (v**2).sum(1))
            g = (weight[take] * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[take]) / len(take)).astype(np.float32)
            xg = xb.T @ g
            grads = [g.sum(), xg + DECAY * w, xb.T @ (g[:, None] * xv) - v * xg[:, None] + DECAY * v]
            step += 1
            for i, grad in enumerate(grads):
                m, s = moments[i]
                m += 0.1 * (grad - m)
                s += 0.01 * (grad**2 - s)
                moments[i] = [m, s]
                params[i] = params[i] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Machine(selected, float(params[0]), params[1], params[2])


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Fits on labelled documents outside the held-out fifth, on at most ``train_rows`` labels of them.

    The sample is the labels with the least hashes of doc_id, so it is the same on every run; it alone is joined with the
    texts and sent to the driver, as features. Null labels and labels of a null doc_id do not count (a null doc_id hashes as '', which
    is not held out, but has no label); of several labels of a doc_id the largest does; a doc_id with several rows gives each.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    doc, toxic = free(docs, "labelled_doc", "label")
    known = bounded(stored(known.select(F.col("doc_id").alias(doc), F.col("toxic").cast("int").alias(toxic)), "toxicity-labels"), train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "found"])

    rows = docs.join(known, F.col("doc_id") == F.col(doc)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(toxic).alias("toxic"), F.col("text").cast("string").alias("text"))
    table = rows.mapInArrow(run, "doc_id long, toxic int, found array<int>").orderBy("doc_id", "toxic", F.size("found")).toArrow()
    machine = fit([f.values.to_numpy() for f in table["found"]], table["toxic"].to_numpy().astype(float))
    del table
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` and toxic_score (0 to 1; a column of that name is replaced), from the whole text alone.
    Null and empty texts have no features and so the machine's bias; repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # (FEATURES + PAIRED) * (FACTORS + 1) numbers at most

    @F.arrow_udf("double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(shared.value)
        for texts in parts:
            yield pa.array(shared.value.scores([finder.places(t.as_py()) for t in texts]), pa.float64())

    return docs.withColumn("toxic_score", of(F.col("text").cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they were, also one called toxic_score."""
    own = free(docs, "toxic_score")[0]
    plain = score(docs.withColumnRenamed("toxic_score", own) if own != "toxic_score" else docs, train(docs, labels))
    back = [F.col(f"`{own if c.lower() == 'toxic_score' else c}`").alias(c) for c in docs.columns]
    return plain.where(F.col("toxic_score") < threshold).select(*back)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
