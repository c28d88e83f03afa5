"""The markup reader on the invented sample: every case that the format has."""

import os

import duckdb
import pytest

from lectern.api import Lectern
from lectern.functions import text as tx
from lectern.operators import align
from lectern.plans import catalog, sample, usx_sql
from lectern.sources import usx
from pyspark.sql import functions as F

CORPUS = os.environ.get("USX_CORPUS", "")  # a folder of <version>/<book>.usx


@pytest.fixture(scope="module")
def rows(spark):
    return usx.annotate(usx.tokenise(sample.files(spark))).persist()


@pytest.fixture(scope="module")
def verses(rows):
    return {(r["version"], r["ref"]): r for r in usx.verses(rows).collect()}


def test_verses(verses):
    assert verses["ONE", "GEN 1:1"]["text"] == "A river ran to the sea."
    assert verses["ONE", "GEN 1:2"]["text"] == "It was wide, it was deep, and it sang & slept."
    assert verses["ONE", "GEN 1:2"]["n_paras"] == 3
    assert verses["ONE", "GEN 2:1"]["text"] == "A song of the hill."
    assert verses["TWO", "GEN 1:1"]["text"] == "A stream did run to the great salt sea."
    assert verses["TWO", "GEN 1:1"]["text_raw"].startswith("¶ A stream")
    assert verses["TWO", "GEN 1:2"]["text"] == "It was very wide and deep and old."
    assert {r["book_no"] for r in verses.values()} == {1}
    assert len(verses) == 8
    assert all(r["text"] and "\r" not in r["text"] for r in verses.values())


def test_notes(rows):
    found = {r["version"]: r for r in usx.notes(rows).collect()}
    assert (found["ONE"]["ref"], found["ONE"]["caller"], found["ONE"]["fr"], found["ONE"]["ft"]) == ("GEN 1:1", "+", "1:1", "Or flowed")
    assert (found["TWO"]["fr"], found["TWO"]["ft"]) == ("1:1", "run: or, go")


@pytest.mark.parametrize("name", ["verses", "notes", "spans", "headings", "crossrefs", "passages", "aligned"])
def test_queries_equal_sql(spark, name):
    cursor = duckdb.connect().execute(getattr(usx_sql, name.upper()))
    columns = [c[0] for c in cursor.description]
    got = catalog.QUERIES[f"usx_{name}"](spark, "")
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_styles_nest_to_any_depth(spark):
    styles = ["add", "nd", "wj", "bd", "it", "sc", "em"]
    inner = "".join(f'<char style="{s}">{s} ' for s in styles) + "deep" + "</char>" * len(styles)
    text = f'<usx version="3.0"><book code="GEN" style="id">x</book><para style="p"><verse number="1" style="v" sid="GEN 1:1" />{inner}<char style="nd">end</char><verse eid="GEN 1:1" /></para></usx>'
    found = usx.spans(usx.annotate(usx.tokenise(spark.createDataFrame([("V", text)], "version string, value string")))).collect()
    assert sorted(r["style"] for r in found if r["text"].endswith("deep")) == sorted(styles)
    assert [r["style"] for r in found if r["text"] == "end"] == ["nd"]


def test_verse_details(spark, rows, tmp_path):
    page = Lectern(spark, str(tmp_path), verses=usx.verses(rows))
    assert {r["version"] for r in page.get_verse_details("GEN 1:1").collect()} == {"ONE", "TWO"}
    assert [r["text"] for r in page.get_verse_details("GEN 1:1", "ONE").collect()] == ["A river ran to the sea."]
    assert page.get_verse_details("GEN 9:9").count() == 0
    with pytest.raises(ValueError):
        Lectern(spark, str(tmp_path)).get_verse_details("GEN 1:1")


def test_spans_nest(rows):
    found = {(r["style"], r["text"]) for r in usx.spans(rows).where("version = 'TWO'").collect()}
    assert {("add", "did"), ("wj", "great"), ("wj", "salt"), ("add", "salt"), ("wj", "sea"), ("bd", "[[and old]]")} == found


def test_headings(rows):
    found = {(r["version"], r["text"]): r["next_ref"] for r in usx.headings(rows).collect()}
    assert found == {("ONE", "The River"): "GEN 1:1", ("ONE", "A voice"): "GEN 2:1", ("ONE", "The Hill"): "GEN 2:1", ("TWO", "Written from the hill."): None}


def test_crossrefs(rows):
    found = {r["loc"]: r for r in usx.resolve(usx.crossrefs(rows), usx.verses(rows)).collect()}
    assert (found["GEN 2:1-2"]["resolved"], found["GEN 2:1-2"]["n_verses"]) == (True, 2)
    assert (found["PSA 9:1"]["resolved"], found["PSA 9:1"]["n_verses"]) == (False, 0)
    assert (found["GEN 1-2"]["v1"], found["GEN 1-2"]["v2"], found["GEN 1-2"]["n_verses"]) == (None, None, 4)
    assert found["GEN 1:2-2:1"]["n_verses"] == 2
    links = {(r["src"], r["dst"]) for r in usx.crossref_links(usx.crossrefs(rows), usx.verses(rows)).collect()}
    assert ("GEN 1:1", "GEN 2:2") in links and ("GEN 2:1", "GEN 1:1") in links


def test_passages(rows):
    found = {(r["version"], r["passage"]): r["text"] for r in usx.passages(rows, "section").collect()}
    assert found["ONE", "1"].startswith("A river ran") and found["ONE", "1"].endswith("slept.")
    assert found["ONE", "2"] == "A song of the hill. The hill stood still."
    chapters = {(r["version"], r["passage"]) for r in usx.passages(rows, "chapter").collect()}
    assert chapters == {(v, c) for v in ("ONE", "TWO") for c in ("GEN 1", "GEN 2")}
    assert usx.passages(rows, "verse").count() == 8


def test_alignment(rows):
    table = usx.verses(rows)
    wide = {r["ref"]: (r["ONE"], r["TWO"]) for r in align.side_by_side(table, ["ONE", "TWO"]).collect()}
    assert wide["GEN 2:2"][1] is None and wide["GEN 2:3"][0] is None and all(wide["GEN 1:1"])
    one, two = table.where("version = 'ONE'"), table.where("version = 'TWO'")
    assert [r["ref"] for r in align.only_in(one, two, "ref").collect()] == ["GEN 2:2"]


def test_reference_forms(spark):
    forms = ["GEN 1:2", "GEN 1:2-5", "2SA 5:1-6:3", "HAB 1-3", "PSA 7", "not one", "GEN 1:x"]
    t = [tuple(r["t"]) for r in spark.createDataFrame([(f,) for f in forms], "loc string").select(tx.target(F.col("loc")).alias("t")).collect()]
    assert t[:5] == [("GEN", 1, 2, 1, 2), ("GEN", 1, 2, 1, 5), ("2SA", 5, 1, 6, 3), ("HAB", 1, None, 3, None), ("PSA", 7, None, 7, None)]
    assert t[5] == t[6] == (None,) * 5


def test_files(spark, tmp_path):
    for version, text in (("ONE", sample.FIRST), ("TWO", sample.SECOND)):
        (tmp_path / version).mkdir()
        (tmp_path / version / "GEN.usx").write_text(text, encoding="utf-8", newline="")
    files = usx.read_files(spark, str(tmp_path))
    assert usx.verses(usx.annotate(usx.tokenise(files))).count() == 8


@pytest.mark.skipif(not os.path.isdir(CORPUS), reason="the corpus is not there")
def test_invariants_on_a_corpus(spark):
    rows = usx.annotate(usx.tokenise(usx.read_files(spark, CORPUS))).persist()
    verses = usx.verses(rows).persist()
    counts = {r["version"]: r for r in verses.groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("ref").alias("refs"), F.sum((F.col("n_paras") > 1).cast("int")).alias("cross"), F.min(F.length("text")).alias("short"), F.count_distinct("book", "chapter").alias("chapters")).collect()}
    assert {v: r["n"] for v, r in counts.items()} == {"BSB": 28625, "KJV": 28641, "LSV": 31104}
    assert all(r["n"] == r["refs"] and r["short"] > 0 for r in counts.values())
    assert {v: r["cross"] for v, r in counts.items()} == {"BSB": 7191, "KJV": 0, "LSV": 0}
    assert {v: r["chapters"] for v, r in counts.items()} == {"BSB": 1039, "KJV": 1039, "LSV": 1189}
    assert {r["version"]: r["count"] for r in usx.notes(rows).groupBy("version").count().collect()} == {"BSB": 4549, "KJV": 6187}
    assert usx.crossrefs(rows).count() == 1938
    of = lambda v: verses.where(F.col("version") == v)
    assert align.only_in(of("BSB"), of("KJV"), "ref").count() == 0
    assert align.only_in(of("KJV"), of("LSV"), "ref").count() == 0
    assert align.only_in(of("KJV"), of("BSB"), "ref").count() == 16
    rows.unpersist()
    verses.unpersist()
