"""Milestone markup (USX 3.0): verses, spans, notes, headings and cross-references from an ordered stream of tokens.

Paragraphs, character styles and notes nest, while verses and chapters are pairs of empty tags that may lie in
different paragraphs. So a passage is an interval of document order, found by running windows per book. A book is one
file, which bounds the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from ..functions import text as tx
from ..operators import align

#: Paragraph styles that are no verse text, even inside an open verse. Fixed values.
HEADINGS = ("s1", "s2", "r", "h", "toc1", "toc2", "toc3", "mt", "mt1", "mt2", "usfm", "ide")


def _so_far() -> WindowSpec:
    return Window.partitionBy("version", "book").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _next(event: Column) -> Column:
    """The next event from here on. A running window over the reversed order: one that looks forward would read the
    rest of the book for every row."""
    return F.last(event, ignorenulls=True).over(Window.partitionBy("version", "book").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """version (the folder's name) and value (the whole file) of ``root/<version>/<book>.usx``."""
    files = spark.read.text(f"{root}/*/*.usx", wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("version"), "value")


def tokenise(files: DataFrame) -> DataFrame:
    """version, book, pos, tok."""
    plain = files.select("version", tx.plain_file(F.col("value")).alias("value"))
    # the code is taken from the file before the tokens multiply its rows
    listed = plain.select("version", F.regexp_extract("value", r'<book\s[^>]*code="([^"]*)"', 1).alias("book"), tx.tokens(F.col("value")).alias("tokens"))
    return listed.select("version", "book", F.posexplode("tokens").alias("pos", "tok"))


def _filled(event: Column) -> Column:
    """The last event so far, '' before the first."""
    return F.coalesce(F.last(event, ignorenulls=True).over(_so_far()), F.lit(""))


def annotate(tokens: DataFrame) -> DataFrame:
    """Adds to every token what is open there: ref, chapter, paragraph and its style, note and its depth, styles, section."""
    t = F.col("tok")
    name = F.regexp_extract(t, r"^</?([A-Za-z0-9]+)", 1)
    shut, empty = t.startswith("</"), t.endswith("/>")
    rows = tokens.withColumns({"tag": name, "shut": shut, "empty": empty, "style": F.when(t.startswith("<") & ~shut, tx.attribute(t, "style"))})
    tag = F.col("tag")
    opens = lambda x: (tag == x) & ~F.col("shut") & ~F.col("empty")
    shuts = lambda x: (tag == x) & F.col("shut")
    sid, eid = tx.attribute(t, "sid"), tx.attribute(t, "eid")

    def milestone(x: str) -> Column:
        return F.when((tag == x) & (sid != ""), sid).when((tag == x) & (eid != ""), F.lit(""))

    step = lambda x: F.when(opens(x), 1).when(shuts(x), -1).otherwise(0)
    rows = rows.withColumns(
        {
            "ref": _filled(milestone("verse")),
            "chapter_ref": _filled(milestone("chapter")),
            "para_style": _filled(F.when(opens("para"), F.col("style")).when(shuts("para"), F.lit(""))),
            "para_no": F.sum(F.when((tag == "para") & ~F.col("shut"), 1).otherwise(0)).over(_so_far()),
            "section_no": F.sum(F.when(opens("para") & (F.col("style") == "s1"), 1).otherwise(0)).over(_so_far()),
            "note_no": F.sum(F.when(opens("note"), 1).otherwise(0)).over(_so_far()),
            "note_depth": F.sum(step("note")).over(_so_far()),
            "char_depth": F.sum(step("char")).over(_so_far()),
        }
    )
    return rows.withColumns({"is_text": ~t.startswith("<"), "opens_char": opens("char")})


def levels(tokens: DataFrame) -> DataFrame:
    """Text tokens within character styles, once for each style that is open there, with level (from 1) and style.

    A text at depth n takes the style that was opened last at each level up to n, so styles may nest to any depth.
    """
    depth = F.col("char_depth")
    rows = tokens.where(F.col("opens_char") | (F.col("is_text") & (depth > 0)))
    rows = rows.withColumn("level", F.explode(F.when(F.col("opens_char"), F.array(depth)).otherwise(F.sequence(F.lit(1).cast("long"), depth))))
    at_level = Window.partitionBy("version", "book", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("style", F.last(F.when(F.col("opens_char"), F.col("style")), ignorenulls=True).over(at_level)).where("is_text")


def _joined(order: str = "pos", piece: str = "tok") -> Column:
    """Text pieces of a group in order; groups are verses, notes or passages, so lists stay short."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda s: s[piece]), "")


def _verse_text(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("is_text") & (F.col("ref") != "") & (F.col("note_depth") == 0) & ~F.col("para_style").isin(*HEADINGS))


def verses(tokens: DataFrame) -> DataFrame:
    """version, book, book_no, chapter, verse, ref, text, text_raw, n_paras of annotated tokens."""
    inked = F.when(tx.collapse(F.col("tok")) != "", F.col("para_no"))
    grouped = _verse_text(tokens).groupBy("version", "book", "ref").agg(_joined().alias("run"), F.count_distinct(inked).cast("int").alias("n_paras"))
    raw = tx.collapse(tx.unescape(F.col("run")))
    ref = tx.reference(F.col("ref"))
    return grouped.select("version", "book", tx.book_no(F.col("book")).alias("book_no"), ref["chapter"].alias("chapter"), ref["verse"].alias("verse"), "ref", tx.clean(raw).alias("text"), raw.alias("text_raw"), "n_paras")


def passages(tokens: DataFrame, grain: str = "verse") -> DataFrame:
    """version, book, grain, passage, first_ref, text: verse text rolled up to verses, paragraphs, sections or chapters."""
    key = {"verse": F.col("ref"), "paragraph": F.col("para_no").cast("string"), "section": F.col("section_no").cast("string"), "chapter": F.col("chapter_ref")}[grain]
    verse = F.lag("ref").over(Window.partitionBy("version", "book").orderBy("pos"))
    runs = _verse_text(tokens).withColumn("tok", F.when(F.col("ref") == verse, F.col("tok")).otherwise(F.concat(F.lit(" "), F.col("tok"))))
    grouped = runs.withColumn("passage", key).groupBy("version", "book", "passage").agg(F.min_by("ref", "pos").alias("first_ref"), _joined().alias("run"))
    found = grouped.select("version", "book", F.lit(grain).alias("grain"), "passage", "first_ref", tx.clean(tx.unescape(F.col("run"))).alias("text"))
    return found.where("text != ''")


def spans(tokens: DataFrame) -> DataFrame:
    """version, ref, pos, style, text: styled runs of verse text, once for each style that is open."""
    return _verse_text(levels(tokens)).select("version", "ref", "pos", "style", tx.collapse(tx.unescape(F.col("tok"))).alias("text"))


def notes(tokens: DataFrame) -> DataFrame:
    """version, ref, pos, caller, fr, ft: footnotes; the origin is written with a colon."""
    note = ("version", "book", "note_no")
    found = tokens.where("note_depth > 0").groupBy(*note).agg(F.min_by("ref", "pos").alias("ref"), F.min("pos").alias("pos"), F.max(tx.attribute(F.col("tok"), "caller")).alias("caller"))
    parts = levels(tokens.where("note_depth > 0")).where(F.col("style").isin("fr", "ft")).select(*note, "pos", "style", "tok").distinct()
    of = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("style") == s, F.struct("pos", "tok")))), lambda x: x["tok"]), "").alias(s)
    met = found.join(parts.groupBy(*note).agg(of("fr"), of("ft")), list(note), "left").fillna("", ["fr", "ft"])
    return met.select("version", "ref", "pos", "caller", F.regexp_replace(tx.collapse(tx.unescape(F.col("fr"))), r"\.", ":").alias("fr"), tx.collapse(tx.unescape(F.col("ft"))).alias("ft"))


def headings(tokens: DataFrame) -> DataFrame:
    """version, book, pos, style, text, next_ref: section headings and the verse that follows (null at a book's end)."""
    start = F.nullif(tx.attribute(F.col("tok"), "sid"), F.lit(""))
    ahead = tokens.withColumn("next_ref", _next(F.when(F.col("tag") == "verse", start)))
    rows = ahead.where(F.col("para_style").isin("s1", "s2") & F.col("is_text") & (F.col("note_depth") == 0))
    grouped = rows.groupBy("version", "book", "para_no").agg(F.min("pos").alias("pos"), F.first("para_style").alias("style"), _joined().alias("run"), F.min_by("next_ref", "pos").alias("next_ref"))
    return grouped.select("version", "book", "pos", "style", tx.collapse(tx.unescape(F.col("run"))).alias("text"), "next_ref")


def crossrefs(tokens: DataFrame) -> DataFrame:
    """version, book, pos, loc, from_ref, t_book, c1, v1, c2, v2: parallel references and the verse that they stand before."""
    start = F.nullif(tx.attribute(F.col("tok"), "sid"), F.lit(""))
    ahead = tokens.withColumn("from_ref", _next(F.when(F.col("tag") == "verse", start)))
    loc = tx.attribute(F.col("tok"), "loc")
    rows = ahead.where((F.col("tag") == "ref") & (loc != "")).select("version", "book", "pos", loc.alias("loc"), "from_ref")
    return rows.select("*", tx.target(F.col("loc")).alias("t")).select("version", "book", "pos", "loc", "from_ref", "t.*")


def _targets(crossrefs: DataFrame, verses: DataFrame) -> DataFrame:
    """Cross-references with each verse (to_ref) of their targets: a binned range join, a chapter to a bin."""
    place = lambda c, v: c * 1000 + v
    spot = verses.select("version", F.col("book").alias("t_book"), place(F.col("chapter"), F.col("verse")).alias("place"), F.col("ref").alias("to_ref"))
    ranges = crossrefs.withColumns({"low": place(F.col("c1"), F.coalesce("v1", F.lit(0))), "high": place(F.col("c2"), F.coalesce("v2", F.lit(999)))})
    return align.range_join(ranges, spot, "low", "high", "place", 1000, ("version", "t_book"))


def resolve(crossrefs: DataFrame, verses: DataFrame) -> DataFrame:
    """Cross-references (one per version, book and pos) with resolved and n_verses; dangling ones stay."""
    met = _targets(crossrefs, verses).groupBy("version", "book", "pos").agg(F.count("*").cast("int").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return crossrefs.join(met, ["version", "book", "pos"], "left").select(*crossrefs.columns, (n > 0).alias("resolved"), n.alias("n_verses"))


def crossref_links(crossrefs: DataFrame, verses: DataFrame) -> DataFrame:
    """src, dst, weight: from the verse under a parallel reference to each verse of its target."""
    return _targets(crossrefs, verses).select("version", F.col("from_ref").alias("src"), F.col("to_ref").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
