"""Text expressions: tokens of markup, references, clean-up of editions' conventions, terms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = r"<[^>]+>|[^<]+"
TERM = r"\p{L}+"
#: white space that both this engine and SQL engines agree on
SPACE = r"[ \t\n\r\f]+"

#: Canonical order of book codes. Fixed values.
BOOKS = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL "
    "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV"
).split()


def tokens(markup: Column) -> Column:
    """Tags and text runs, in order."""
    return F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, '' if it has none."""
    return F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, SPACE, " "))


def unescape(s: Column) -> Column:
    """The five standard entities; the ampersand last, so that nothing is decoded twice."""
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(c))
    return s


def plain_file(s: Column) -> Column:
    """Without a byte order mark and carriage returns."""
    return F.regexp_replace(s, "^﻿|\r", "")


def clean(s: Column, pilcrow: bool = True, poetic: bool = True, supplied: bool = True, variant: bool = True) -> Column:
    """Conventions of editions taken out: paragraph marks, poetic breaks, brackets of variants and of supplied words."""
    if pilcrow:
        s = F.replace(s, F.lit("¶"), F.lit(" "))
    if poetic:
        s = F.replace(s, F.lit("||"), F.lit(" "))
    if variant:
        s = F.regexp_replace(s, r"\[\[|\]\]", "")
    if supplied:
        s = F.regexp_replace(s, r"\[([^\[\]]*)\]", "$1")
    return collapse(s)


def book_no(code: Column) -> Column:
    """Place of a book code in canonical order from 1; null for other codes."""
    return F.nullif(F.array_position(F.array(*[F.lit(b) for b in BOOKS]), code), F.lit(0)).cast("int")


def reference(ref: Column) -> Column:
    """"GEN 1:27" as struct (book, chapter, verse); all null if it has another form."""
    form = r"^(\w{3}) (\d+):(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(ref, form, i), F.lit(""))
    return F.struct(part(1).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"))


def target(loc: Column) -> Column:
    """A cross-reference's target as struct (t_book, c1, v1, c2, v2): verse, verse range, range over chapters, chapters.

    Verses are null for whole chapters; everything is null if the form is unknown.
    """
    form = r"^(\w{3}) (\d+)(?::(\d+))?(?:-(?:(\d+):)?(\d+))?$"
    text = lambda i: F.nullif(F.regexp_extract(F.trim(loc), form, i), F.lit(""))
    part = lambda i: text(i).cast("int")
    v1, c2, last = part(3), part(4), part(5)
    return F.struct(
        text(1).alias("t_book"),
        part(2).alias("c1"),
        v1.alias("v1"),
        F.coalesce(c2, F.when(v1.isNull(), last), part(2)).alias("c2"),
        F.when(v1.isNotNull(), F.coalesce(last, v1)).alias("v2"),
    )


def terms(s: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(s), F.lit(TERM), F.lit(0))
