"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bounded, cut, free, stored, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens to keep; power that flattens the marginals that have no stated target.
RATE, POWER = 0.8, 0.8
#: Fitting ends when every marginal is within this share of its goal, tested each so many rounds, at the latest after so many.
TOLERANCE, CHECKED, ROUNDS = 0.002, 4, 100
#: Cells per partition of the fitting table.
CELLS = 50_000
DIGITS = 6

#: Marks of a text's kind, the first that occurs decides; else it is prose. Fixed values.
TOPICS = (("table", " | "), ("noise", "###"), ("shout", "!!"), ("contact", "@"), ("licence", "icense"))


def topic(text: Column) -> Column:
    kind = F.lit("prose")
    for name, mark in reversed(TOPICS):
        kind = F.when(text.contains(mark), name).otherwise(kind)
    return kind


def tokens(text: Column) -> Column:
    """Estimate of a text's tokens: a quarter of its UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def goals(cells: DataFrame, dimension: str, targets: dict[str, float] | None, power: float) -> DataFrame:
    """dimension, _has (its tokens) and _share: stated weights, or its tokens to a power; a value without a weight gets none."""
    sums = cells.groupBy(dimension).agg(F.sum("_tokens").cast("double").alias("_has"))
    if targets is None:
        share = F.when(F.col("_has") > 0, F.pow("_has", F.lit(float(power)))).otherwise(0.0)
    else:
        share = F.lit(0.0)
        for value, weight in targets.items():
            share = F.when(F.col(dimension) == value, float(weight)).otherwise(share)
    return sums.withColumn("_share", F.when(F.col("_has") > 0, share).otherwise(0.0))


def feasible(sums: DataFrame, total: Column) -> DataFrame:
    """Adds _goal: ``total`` dealt by _share, but no value gets more than it has; what it lacks goes to the others by share.

    With values in order of has / share, the level at which those before one are full and the rest share what
    is left is largest at the right place, so the goals are least(has, level * share). One row per value of a
    dimension, in one window.
    """
    order = Window.orderBy(F.col("_has") / F.nullif(F.col("_share"), F.lit(0.0)), sums.columns[0])
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    some = sums.where("_share > 0").withColumn("_total", total)
    level = (F.col("_total") - F.coalesce(F.sum("_has").over(before), F.lit(0.0))) / F.sum("_share").over(rest)
    some = some.withColumn("_level", level).withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return some.select(sums.columns[0], F.least("_has", F.col("_level") * F.col("_share")).alias("_goal")).unionByName(sums.where("_share <= 0").select(sums.columns[0], F.lit(0.0).alias("_goal")))


def rake(cells: DataFrame, dimensions: tuple[str, ...], targets: dict[str, dict[str, float]] | None = None, power: float = POWER, rate: float = RATE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(dimensions, probability per cell; the largest share by which a marginal misses its goal).

    A cell's probability is the product of one factor per dimension value, and at most 1: a cell cannot give more
    tokens than it has. Goals per value are made feasible first, see ``feasible``; all dimensions' goals have one sum,
    ``rate`` of all tokens or what values with a share have. Each step scales the factors of one dimension so
    that the tokens expected under each value move to its goal; a round takes every dimension. Rounds end
    when all marginals are within ``tolerance`` of their goals. Where marginals contradict each other the
    rounds run out, and the second result says by how much they are missed.

    The table has one row per cell; while it has fewer than ``CELLS`` for a second part, a round runs
    in one task without exchanges, beyond that as distributed sums and joins. Both do the same arithmetic.
    """
    targets = targets or {}
    cells = cut(cells)
    parts = max(1, cells.count() // CELLS)
    sums = {d: stored(goals(cells, d, targets.get(d), power), f"mix-{d}") for d in dimensions}
    reach = [s.agg((F.sum("_has") * rate).alias("a"), F.sum(F.when(F.col("_share") > 0, F.col("_has"))).alias("b")).first() for s in sums.values()]
    total = min((x for r in reach for x in r if x is not None), default=0.0)
    cells = cells.coalesce(parts)
    for d in dimensions:
        cells = cells.join(bounded(stored(feasible(sums[d], F.lit(float(total))).withColumnRenamed("_goal", f"_goal_{d}"), f"mix-goal-{d}")), d)
    cells, gap = cut(cells.withColumn("_f", F.lit(1.0))), 0.0
    expected = F.sum(F.col("_tokens") * F.least("_f", F.lit(1.0)))

    def with_mass(cells: DataFrame, d: str, name: str) -> DataFrame:
        if parts == 1:  # in one part a window needs neither an exchange nor a join
            return cells.withColumn(name, expected.over(Window.partitionBy(d)))
        # partial sums per task, so one value may hold any share of the cells
        return cells.join(cells.groupBy(d).agg(expected.alias(name)), d)

    for i in range(1, rounds + 1):
        cells = cells.coalesce(parts)
        for d in dimensions:
            cells = with_mass(cells, d, "_mass").withColumn("_f", F.when(F.col("_mass") > 0, F.col("_f") * F.col(f"_goal_{d}") / F.col("_mass")).otherwise(F.col("_f"))).drop("_mass")
        if parts > 1 or i % CHECKED == 0 or i == rounds:
            cells = cut(cells)
        if i % CHECKED == 0 or i == rounds:
            missed = [F.max(F.when(F.col(f"_goal_{d}") > 0, F.abs(F.col(f"_mass_{d}") / F.col(f"_goal_{d}") - 1))) for d in dimensions]
            gap = max((g for g in reduce(lambda c, d: with_mass(c, d, f"_mass_{d}"), dimensions, cells.coalesce(parts)).agg(*missed).first() if g is not None), default=0.0)
            if gap < tolerance:
                break
    return cells.select(*dimensions, F.round(F.least("_f", F.lit(1.0)), DIGITS).alias("probability")), gap


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, rate: float = RATE, rounds: int = ROUNDS, topic_of: Column | None = None, tokens_of: Column | None = None) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens, probability and sampled.

    Documents fall into cells of source, language and topic; a null source or language counts as ''. The expected
    tokens of a cell are raked to the marginals (see ``rake``), and a document is sampled if the uniform number
    of its doc_id is below its cell's probability. So repeated rows share their fate, a null doc_id is a
    key like others, a run repeats exactly, and a raised rate only adds documents. ``topic_of`` and ``tokens_of``
    take the place of the kind of a text and of the estimate of its tokens. A null text has no tokens, and a cell
    without tokens is kept. A column of ``docs`` called like an added one is replaced. No rows give no rows.
    """
    text = text_or_empty()
    kind, n = topic(text) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit("")), tokens(text) if tokens_of is None else F.coalesce(tokens_of.cast("long"), F.lit(0))
    rows = docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": kind, "_tokens": n})
    cells = rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("_tokens"))
    p = free(rows, "cell_probability")[0]
    kept = rake(cells, DIMENSIONS, targets, power, rate, rounds)[0].select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("probability").alias(p))
    rows = rows.drop("probability", "sampled").join(bounded(stored(kept, "mix-cells")), ["_source", "_lang", "_topic"], "left")
    return rows.withColumn("probability", F.coalesce(p, F.lit(0.0))).drop(p).withColumn("sampled", uniform(F.col("doc_id")) < F.col("probability"))


def sample(docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows of ``docs``, columns as they were."""
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in columns], "doc_id", "text", "source", "lang")
    return mix(plain, **settings).where("sampled").select(*[F.col(f"`_in_{c}`").alias(c) for c in columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs).select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("est_tokens"), "probability", "sampled")


def _oracle() -> str:
    kind = " ".join(f"WHEN contains(t, '{mark}') THEN '{name}'" for name, mark in TOPICS)
    sql = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, lang, CASE {kind} ELSE 'prose' END AS topic, ((strlen(t) + 3) // 4)::BIGINT AS est_tokens FROM d),
c AS (SELECT source, lang, topic, sum(est_tokens)::DOUBLE AS n FROM r GROUP BY ALL),
"""
    joins = ""
    for d in DIMENSIONS:
        sql += f"""
h_{d} AS (SELECT {d}, sum(n) AS has, CASE WHEN sum(n) > 0 THEN pow(sum(n), {POWER}::DOUBLE) ELSE 0 END AS share FROM c GROUP BY {d}),
l_{d} AS (SELECT max(((SELECT sum(n) FROM c) * {RATE}::DOUBLE - coalesce(below, 0)) / rest) AS level FROM (
  SELECT sum(has) OVER (ORDER BY has / share, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
         sum(share) OVER (ORDER BY has / share, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM h_{d} WHERE share > 0)),
g_{d} AS (SELECT {d}, CASE WHEN share > 0 THEN least(has, level * share) ELSE 0 END AS goal_{d} FROM h_{d}, l_{d}),
"""
        joins += f" JOIN g_{d} USING ({d})"
    inner, gaps = "SELECT *, f AS f0 FROM it WHERE round < %d" % ROUNDS, []
    for i, d in enumerate(DIMENSIONS):
        inner = f"SELECT * EXCLUDE (m), CASE WHEN m > 0 THEN f{i} * goal_{d} / m ELSE f{i} END AS f{i + 1} FROM (SELECT *, sum(n * least(f{i}, 1)) OVER (PARTITION BY {d}) AS m FROM ({inner}))"
        gaps.append(f"CASE WHEN goal_{d} > 0 THEN abs(sum(n * least(f, 1)) OVER (PARTITION BY round, {d}) / goal_{d} - 1) ELSE 0 END")
    goals = ", ".join(f"goal_{d}" for d in DIMENSIONS)
    return sql + f"""
it AS (SELECT 0 AS round, source, lang, topic, n, {goals}, 1::DOUBLE AS f FROM c{joins}
       UNION ALL SELECT round + 1, source, lang, topic, n, {goals}, f{len(DIMENSIONS)} FROM ({inner})),
w AS (SELECT round, max(gap) AS gap FROM (SELECT round, greatest({", ".join(gaps)}) AS gap FROM it) GROUP BY round),
e AS (SELECT min(round) AS round FROM w WHERE round > 0 AND round % {CHECKED} = 0 AND (gap < {TOLERANCE}::DOUBLE OR round = {ROUNDS}))
SELECT doc_id, source, lang, topic, est_tokens, round(least(f, 1), {DIGITS}) AS probability,
       ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE / 4294967296::DOUBLE < round(least(f, 1), {DIGITS}) AS sampled
FROM r JOIN (SELECT * FROM it WHERE round = (SELECT round FROM e)) USING (source, lang, topic)
"""


ORACLE = _oracle()
