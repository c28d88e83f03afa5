"""Terms, markup state, ordered units, ranges, topics, streams, and each query against its SQL."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import align, markup, passages, terms, topics
from lectern.plans import catalog
from lectern.sources.store import Store
from lectern.streaming import snapshots

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_terms(spark):
    rows = spark.createDataFrame([(1, "One two, TWO three."), (2, "two"), (3, ""), (4, None)], "id long, text string")
    bag = {(r["id"], r["term"]): r["tf"] for r in terms.bag(rows).collect()}
    assert bag == {(1, "one"): 1, (1, "two"): 2, (1, "three"): 1, (2, "two"): 1}
    assert {r["term"]: r["df"] for r in terms.document_frequency(terms.bag(rows)).collect()} == {"one": 1, "two": 2, "three": 1}
    hit = terms.concordance(rows, "two", 1).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["before"], r["after"]) for r in hit] == [(1, 1, "one", "two"), (1, 2, "two", "three"), (2, 0, "", "")]
    index = terms.inverted_index(terms.bag(rows)).where("term = 'two'").collect()
    assert sorted((r["id"], r["tf"]) for r in index) == [(1, 2), (2, 1)]


def test_markup(spark):
    pages = spark.createDataFrame([(1, "<p>one <b>two</b><br>three</p>tail")], "page_id long, html string")
    rows = markup.depth(markup.last_opened(markup.tokens(pages))).orderBy("pos").collect()
    assert [r["depth"] for r in rows] == [1, 1, 2, 2, 1, 1, 1, 0, 0]
    assert [r["opened"] for r in rows] == ["p", "p", "b", "b", "b", "b", "b", "b", "b"]
    assert markup.page_text(pages).first()["text"] == "one two three tail"


def test_sections(spark):
    units = spark.createDataFrame([(1, 0, "x", "a"), (1, 1, "user", "b"), (1, 2, "x", "c"), (1, 3, "user", "d")], "g int, o int, role string, text string")
    cut = passages.sections(units, "g", "o", F.col("role") == "user").orderBy("o").collect()
    assert [r["section"] for r in cut] == [0, 1, 1, 2]
    assert passages.concat(units, "g", "o", "text").first()["text"] == "a b c d"


def test_range_join_meets_each_pair_once(spark):
    ranges = [(i, i * 7 - 200, i * 7 - 200 + (i * 13) % 300) for i in range(60)] + [(99, 5, 4), (100, None, 3)]
    points = list(range(-250, 600, 3))
    met = align.range_join(spark.createDataFrame(ranges, "r int, lo int, hi int"), spark.createDataFrame([(p,) for p in points], "p int"), "lo", "hi", "p")
    found = sorted((r["r"], r["p"]) for r in met.collect())
    assert found == sorted((r, p) for r, lo, hi in ranges if lo is not None for p in points if lo <= p <= hi)


def test_topics(spark):
    words = {0: "apple pear plum fruit", 1: "iron steel copper metal"}
    rows = spark.createDataFrame([(i, words[i % 2] * 3) for i in range(20)] + [(99, "")], "id long, text string")
    found = topics.lda(rows, k=3, rounds=3).collect()
    assert len(found) == 21
    assert all(abs(sum(r["topics"]) - 1) < 1e-6 and 0 <= r["group"] < 3 and r["topics"][r["group"]] == max(r["topics"]) for r in found)
    assert topics.term_vectors(rows, size=4).count() == 21


def test_layout_is_bounded(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0, float(-i % 3)]) for i in range(30)], "id long, embedding array<float>")
    found = topics.layout(rows).collect()
    assert len(found) == 30 and all(-1 <= r[c] <= 1 for r in found for c in "xyz") and max(abs(r["x"]) for r in found) == 1


def test_latest_of_a_stream_equals_the_batch(spark):
    of = lambda rows: snapshots.latest(rows, "user_id", ["ts", "event_id"], ["event_id", "value"])
    batch = of(spark.read.parquet(f"{DATA}/events.parquet"))
    stream = snapshots.run_available(of(snapshots.changes_of(spark, DATA)))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_subscription_keeps_one_method_live(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    feed = tmp_path / "feed"
    schema = "ord long, id string, x float, y float, z float"
    live = snapshots.Subscription(store, str(tmp_path / "ckpt"), trigger={"availableNow": True})
    for method, ids in (("a", ["p", "q"]), ("b", ["r"]), ("a", ["s"])):
        shutil.rmtree(feed, ignore_errors=True)
        spark.createDataFrame([(i, n, 0.0, 0.0, 0.0) for i, n in enumerate(ids)], schema).coalesce(1).write.parquet(str(feed))
        live.select(method, nodes=spark.readStream.schema(schema).parquet(str(feed)))
        for q in live.queries:
            q.awaitTermination()
        assert [r["id"] for r in store.nodes(method).orderBy("ord").collect()] == ids
    assert [r["id"] for r in store.nodes("b").collect()] == ["r"]
    live.select(None)
    assert not live.queries


def test_subscription_of_links_and_ticks(spark, tmp_path):
    """Links are a stream of their own beside the nodes; progress is that of the method now live."""
    store, live = Store(spark, str(tmp_path / "store")), None
    for kind, schema, row in (("nodes", "ord long, id string, x float, y float, z float", (0, "p", 0.0, 0.0, 0.0)), ("links", "src string, dst string, weight double", ("p", "q", 0.5))):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / kind))
    live = snapshots.Subscription(store, str(tmp_path / "ckpt"), trigger={"availableNow": True})
    assert live.elapsed() == []
    live.select("m", nodes=spark.readStream.schema("ord long, id string, x float, y float, z float").parquet(str(tmp_path / "nodes")), links=spark.readStream.schema("src string, dst string, weight double").parquet(str(tmp_path / "links")))
    assert len(live.queries) == 2
    for q in live.queries:
        q.awaitTermination()
    assert [(r["src"], r["dst"], r["weight"]) for r in store.links("m").collect()] == [("p", "q", 0.5)]
    assert len(live.elapsed()) == 2 and all(p["numInputRows"] > 0 for p in live.elapsed())
    assert snapshots.Subscription(store, "x").trigger == {"processingTime": "1 second"}
    live.select("other", nodes=spark.readStream.schema("ord long, id string, x float, y float, z float").parquet(str(tmp_path / "nodes")))
    assert len(live.queries) == 1 and live.method == "other"
    live.stop()
    assert live.elapsed() == [] and store.links("m").count() == 1


def test_stream_results_of_several_batches(spark, tmp_path):
    """Append mode gives all batches, complete mode the last; a feed without rows gives none."""
    schema = "k int, n int"
    for i in range(3):
        spark.createDataFrame([(j, i) for j in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    assert snapshots.run_available(feed(), "append").count() == 12
    assert sorted(map(tuple, snapshots.run_available(snapshots.latest(feed(), "k", ["n"], ["n"])).collect())) == [(j, 2) for j in range(4)]
    (tmp_path / "none").mkdir()
    assert snapshots.run_available(spark.readStream.schema(schema).parquet(str(tmp_path / "none")), "append").count() == 0


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(catalog.SQL[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in got.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted((tuple(map(_plain, r)) for r in expected), key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
