"""URL filter: rules on hosts and paths, and trust and distrust propagated over the graph of links between hosts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded, cut, stored

#: (verdict, host/path): a rule holds for its host and all subdomains where the path starts with its path. Fixed values.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING, DIGITS = 0.85, 6
#: Rounds end when scores change by less than this for each seed, in sum (each round's change is at most ``DAMPING`` times the last one's), at the latest after so many.
TOLERANCE, ROUNDS = 1e-9, 130
#: A host is blocked if its distrust exceeds its trust so many times.
MARGIN = 1.0

#: The host is what follows the first "://" up to "/", "?" or "#"; the path follows up to "?" or "#".
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: An address may leave out the scheme (//host/path).
LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 2)


def node_of(host: Column) -> Column:
    """A host's node in the graph: without user names before it and the ports that its schemes mean anyway."""
    return F.regexp_replace(host, r"^.*@|:(80|443)?$", "")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null. ``rules`` is a short list and part of the plan."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def flows(pages: DataFrame) -> DataFrame:
    """kind, from, to, share: how a host's trust moves along its links, and distrust against those it gets.

    Links are the absolute addresses in ``href``; they are counted per pair of hosts before anything else, so hosts
    with very many links cost as many rows as they have neighbours. Links within a host say nothing.
    """
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), 1)).alias("to")).select("host", node_of(host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit(":"), "to")).otherwise(F.col("to")))).alias("to"))
    links = stored(links.where("host != '' and to != '' and host != to").groupBy("host", "to").agg(F.count("*").alias("n")), "host-links")
    out = bounded(stored(links.groupBy("host").agg(F.sum("n").alias("total")), "host-out"))
    into = bounded(stored(links.groupBy("to").agg(F.sum("n").alias("total")), "host-in"))
    trust = links.join(out, "host").select(F.lit("trust").alias("kind"), F.col("host").alias("from"), "to", (F.col("n") / F.col("total")).alias("share"))
    distrust = links.join(into, "to").select(F.lit("distrust").alias("kind"), F.col("to").alias("from"), F.col("host").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    return stored(trust.unionByName(distrust), "host-flows")


def propagate(flow: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """kind, host, score: personalised PageRank of each kind from its seeds (kind, host), in units of one seed's weight.

    Scores of a kind sum to its number of seeds, so a seed's neighbour scores the same however many other seeds
    there are. What reaches a host without further links goes back to the seeds: that scales a kind's scores
    as a whole, so it is done once at the end. Each round is one join of the flows with the scores and one
    sum, checkpointed. Rounds end when the scores stand still (``TOLERANCE``). Without flows the seeds keep their weights.
    """
    start = cut(seeds.select("kind", "host", F.lit(1.0).alias("score")))
    if flow.isEmpty():
        return start
    score, n = start, start.count()
    home = start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    for _ in range(rounds):
        sent = flow.join(score.withColumnRenamed("host", "from"), ["kind", "from"]).select("kind", F.col("to").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
        last, score = score, cut(sent.unionByName(home).groupBy("kind", "host").agg(F.sum("score").alias("score")))
        both = score.join(last.withColumnRenamed("score", "before"), ["kind", "host"], "full")
        if (both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0] or 0.0) < TOLERANCE * n:
            break
    mass = score.groupBy("kind").agg(F.sum("score").alias("mass")).join(start.groupBy("kind").agg(F.count("*").alias("n")), "kind")
    return score.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("score") * F.col("n") / F.col("mass")).alias("score"))  # two kinds, two rows


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page.

    A page with a fitting rule has its verdict. Hosts most of whose pages rules allow are trusted seeds, those most
    of whose pages rules block are blocked seeds. Trust is personalised PageRank from the first along links;
    distrust from the second against links, since who links to bad hosts is suspect. Other pages are blocked
    if their host's distrust exceeds ``margin`` times its trust, else allowed. Verdicts compare unrounded scores.

    A null url, or one without ``://``, has empty host and path and is allowed; null html has no links; repeated
    rows are judged each; null page_ids stay; other columns are not read; no rows give no rows.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", node_of(F.col("host")))
    n = F.count("*")
    most = lambda v: 2 * F.count(F.when(F.col("fit.verdict") == v, 1)) > n
    seeds = parsed.where("node != ''").groupBy("node").agg(F.when(most("allow"), "trust").when(most("block"), "distrust").alias("kind")).where("kind is not null").select("kind", F.col("node").alias("host"))
    flow = flows(pages.select(node_of(host_of(F.col("url"))).alias("host"), "html"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    scores = stored(propagate(flow, seeds, rounds, damping).groupBy(F.col("host").alias("node")).agg(of("trust"), of("distrust")), "host-scores")
    rows = parsed.join(bounded(scores), "node", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > F.lit(float(margin)) * F.col("trust"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), *(F.round(k, DIGITS).alias(k) for k in ("trust", "distrust")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    fits = lambda rule: f"((host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    cases = lambda i: " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in longest)
    fold = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), {fold}) AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, html FROM pages),
j AS (SELECT *, regexp_replace(host, '^.*@|:(80|443)?$', '', 'g') AS node, CASE {cases(1)} END AS rule, CASE {cases(0)} END AS fit FROM p),
k AS (SELECT CASE WHEN 2 * count(*) FILTER (fit = 'allow') > count(*) THEN 'trust' WHEN 2 * count(*) FILTER (fit = 'block') > count(*) THEN 'distrust' END AS kind, node FROM j WHERE node <> '' GROUP BY node),
s0 AS (SELECT kind, node, 1::DOUBLE AS score FROM k WHERE kind IS NOT NULL),
u AS (SELECT node, unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1)) AS u FROM j),
l AS (SELECT node, regexp_replace(translate(regexp_extract(CASE WHEN starts_with(u, '//') THEN ':' || u ELSE u END, '{URL}', 1), {fold}), '^.*@|:(80|443)?$', '', 'g') AS t, count(*) AS n FROM u GROUP BY ALL),
e AS (SELECT * FROM l WHERE node <> '' AND t <> '' AND node <> t),
f AS (SELECT 'trust' AS kind, node AS a, t AS b, n / sum(n) OVER (PARTITION BY node) AS share FROM e
      UNION ALL SELECT 'distrust', t, node, n / sum(n) OVER (PARTITION BY t) FROM e),
it AS (SELECT 0 AS round, kind, node, score FROM s0
       UNION ALL SELECT round, kind, node, sum(score) AS score FROM (
         SELECT i.round + 1 AS round, f.kind, f.b AS node, share * score * {DAMPING}::DOUBLE AS score FROM f JOIN it i ON f.kind = i.kind AND f.a = i.node WHERE i.round < {ROUNDS}
         UNION ALL SELECT r.round + 1, kind, node, score * {1 - DAMPING}::DOUBLE FROM s0, (SELECT DISTINCT round FROM it) r WHERE r.round < {ROUNDS} AND EXISTS (FROM f)) GROUP BY ALL),
z AS (SELECT kind, node, score * (SELECT count(*) FROM s0 WHERE s0.kind = it.kind) / sum(score) OVER (PARTITION BY kind) AS score FROM it WHERE round = (SELECT max(round) FROM it)),
r AS (SELECT node, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS d FROM z GROUP BY node)
SELECT page_id, host, path, rule, coalesce(fit, CASE WHEN coalesce(d, 0) > {MARGIN}::DOUBLE * coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(t, 0)::DOUBLE, {DIGITS}) AS trust, round(coalesce(d, 0)::DOUBLE, {DIGITS}) AS distrust
FROM j LEFT JOIN r USING (node)
"""


ORACLE = _oracle()
