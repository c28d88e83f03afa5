"""Language identification: known words first, then shorter and shorter character n-grams of unseen ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded, cut, stored

#: Documents a fit may use (a sample by a hash of doc_id), but at least so many of each language; words the model keeps of
#: each language and n-grams of each language and order, the most frequent ones.
TRAIN_ROWS, LANG_ROWS, WORDS, GRAMS = 40_000, 1_000, 60_000, 60_000
#: Lengths of n-grams, longest first. A word seen fewer times than this is unseen.
ORDERS, LEAST = (4, 3, 2, 1), 3
#: Words whose vectors a worker keeps.
MEMO = 200_000
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Per-language log frequencies of words and of n-grams of each order; languages in sorted order."""

    def __init__(self, counts: list[tuple[int, str, str, int]]):
        """``counts``: (order, 0 for words; term; language; times)."""
        self.languages = sorted({lang for _, _, lang, _ in counts})
        column = {lang: i for i, lang in enumerate(self.languages)}
        self.tables: dict[int, dict[str, tuple[float, ...]]] = {}
        for order in (0, *ORDERS):
            table: dict[str, np.ndarray] = {}
            for o, term, lang, n in counts:
                if o == order:
                    table.setdefault(term, np.zeros(len(self.languages)))[column[lang]] += n
            totals = sum(table.values()) if table else 0
            self.tables[order] = {t: tuple(np.log((c + 0.5) / (totals + 0.5 * (len(table) + 1))).tolist()) for t, c in table.items()}

    def vector(self, word: str) -> tuple[float, ...]:
        """Log frequencies of a known word; else the mean over the known n-grams of the longest order that has any."""
        if (known := self.tables[0].get(word)) is not None:
            return known
        for n in ORDERS:
            get = self.tables[n].get
            if found := [v for g in grams(word, n) if (v := get(g)) is not None]:
                return tuple(sum(c) / len(found) for c in zip(*found, strict=True))
        return (0.0,) * len(self.languages)


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.rows = np.zeros((MEMO, len(model.languages)))
        at, vector, rows = self, model.vector, self.rows

        class Memo(dict):
            def __missing__(self, word):
                if len(self) >= MEMO:
                    raise OverflowError
                rows[i := len(self)] = vector(word)
                self[word] = i
                return i

        at.memo = Memo()

    def _total(self, words: list[str]) -> np.ndarray:
        try:
            return self.rows[list(map(self.memo.__getitem__, words))].sum(0)
        except OverflowError:
            self.memo.clear()
        if len(words) < MEMO:
            return self.rows[list(map(self.memo.__getitem__, words))].sum(0)
        return sum(n * np.array(self.model.vector(w)) for w, n in Counter(words).items())

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall((text or "").lower())
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        logs = self._total(words)
        best = int(np.argmax(logs))
        return self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum())


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task per language, given out whenever they are many, so memory stays bounded."""
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "term", "n"])
        counts.clear()

    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(LETTERS.findall(text.as_py().lower()))
        if sum(map(len, counts.values())) > 300_000:
            yield from out()
    yield from out()


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from text and non-null lang of documents outside the held-out third, at most about ``train_rows`` of them
    and ``LANG_ROWS`` of each rare language.

    Words are counted per task and summed in Spark; n-grams are counted from the table of words. Terms are cut, not
    (term, language) pairs: the most frequent ``WORDS`` words of each language and ``GRAMS`` n-grams of each language and order
    come to the driver, each with its counts in all languages. Null texts, null languages and held-out rows teach nothing; a
    null doc_id hashes as '', which is not held out.
    """
    known = docs.where("text is not null and lang is not null").where(~held_out()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if (n := sum(sizes.values())) > train_rows:
        shares = [(lang, max(train_rows / n, min(1.0, LANG_ROWS / of))) for lang, of in sizes.items()]
        shares = F.broadcast(known.sparkSession.createDataFrame(shares, "lang string, share double"))  # a row per language
        known = known.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    words = cut(known.select("text", "lang").mapInArrow(_count_words, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")))
    padded = F.concat(F.lit(" "), "term", F.lit(" "))
    of = lambda order, s: F.transform(F.sequence(F.lit(1), F.length(s) - order + 1), lambda i: F.struct(F.lit(order).alias("n_order"), F.substr(s, i, F.lit(order)).alias("term")))
    every = F.concat(*[of(n, F.col("term") if n == 1 else padded) for n in ORDERS if n < 4], F.when(F.length(padded) >= 4, of(4, padded)).otherwise(F.array().cast("array<struct<n_order:int,term:string>>")))
    found = words.select("lang", "n", F.explode(every).alias("g")).groupBy(F.col("g.n_order").alias("n_order"), F.col("g.term").alias("term"), "lang").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "n_order").orderBy(F.desc("n"), "term"))

    def most(part: DataFrame, rows: int) -> list[tuple]:
        """Terms that are among the most frequent ``rows`` of a language, with their counts in every language."""
        part = stored(part.select("n_order", "term", "lang", "n"), "langid-terms")
        chosen = part.withColumn("place", place).where((F.col("place") <= rows) & (F.col("n") >= LEAST)).select("n_order", "term").distinct()
        return sorted(tuple(r) for r in part.join(bounded(stored(chosen, "langid-chosen")), ["n_order", "term"], "left_semi").collect())

    return Model(most(words.withColumn("n_order", F.lit(0)), WORDS) + most(found, GRAMS))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row, from the whole text alone.

    The score is the language's share of the likelihood. A text that is null or has no letter is ``und`` with score 0,
    as is every text of a model without languages; equal likelihoods go to the language first in order.
    Repeated rows get equal answers; null doc_ids stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + GRAMS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            lang, score = zip(*[predictor.predict(t.as_py()) for t in b.column("text")], strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
