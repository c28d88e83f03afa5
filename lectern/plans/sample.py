"""A small invented corpus in milestone markup: two editions of made-up books, with every case that the reader handles.

The prose is invented; tags, their attributes and styles are fixed by the format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import shared

FIRST = """<?xml version="1.0" encoding="utf-8"?>
<usx version="3.0">
  <book code="GEN" style="id">- First Edition</book>
  <para style="h">Beginnings</para>
  <para style="mt1">Beginnings</para>
  <chapter number="1" style="c" sid="GEN 1" />
  <para style="s1">The River</para>
  <para style="r">(<ref loc="GEN 2:1-2">Beginnings 2:1-2</ref>; <ref loc="PSA 9:1">Songs 9:1</ref>)</para>
  <para style="m">
    <verse number="1" style="v" sid="GEN 1:1" />A river ran<note caller="+" style="f"><char style="fr" closed="false">1:1 </char><char style="ft" closed="false">Or <char style="it">flowed</char></char></note> to the sea.<verse eid="GEN 1:1" />
    <verse number="2" style="v" sid="GEN 1:2" />It was wide,</para>
  <para style="b" />
  <para style="q1" vid="GEN 1:2">it was deep,</para>
  <para style="s2" vid="GEN 1:2">A voice</para>
  <para style="q2" vid="GEN 1:2">and it sang &amp; slept.<verse eid="GEN 1:2" /></para>
  <chapter eid="GEN 1" />
  <chapter number="2" style="c" sid="GEN 2" />
  <para style="s1">The Hill</para>
  <para style="r">(<ref loc="GEN 1:1">Beginnings 1:1</ref>; <ref loc="GEN 1:2-2:1">Beginnings 1:2-2:1</ref>; <ref loc="GEN 1-2">Beginnings 1-2</ref>)</para>
  <para style="d"><verse number="1" style="v" sid="GEN 2:1" />A song of the hill.<verse eid="GEN 2:1" /></para>
  <para style="m"><verse number="2" style="v" sid="GEN 2:2" />The hill stood still.<verse eid="GEN 2:2" /></para>
  <chapter eid="GEN 2" />
</usx>
"""

SECOND = """﻿<?xml version="1.0" encoding="utf-8"?>\r
<usx version="3.0">\r
  <book code="GEN" style="id">Beginnings</book>\r
  <para style="toc3">Beg</para>\r
  <chapter number="1" style="c" sid="GEN 1" />\r
  <para style="p"><verse number="1" style="v" sid="GEN 1:1" />¶ A stream <char style="add">did</char> run<note caller="+" style="f"><char style="fr">1.1 </char><char style="ft">run: or, go</char></note> to the <char style="wj">great <char style="add">salt</char> sea</char>.<verse eid="GEN 1:1" /></para>\r
  <para style="p"><verse number="2" style="v" sid="GEN 1:2" />It was [very] wide || and deep <char style="bd">[[and old]]</char>.<verse eid="GEN 1:2" /></para>\r
  <chapter eid="GEN 1" />\r
  <chapter number="2" style="c" sid="GEN 2" />\r
  <para style="p"><verse number="1" style="v" sid="GEN 2:1" />A hill song.<verse eid="GEN 2:1" /></para>\r
  <para style="p"><verse number="3" style="v" sid="GEN 2:3" />An added line.<verse eid="GEN 2:3" /></para>\r
  <para style="s1">Written from the hill.</para>\r
  <chapter eid="GEN 2" />\r
</usx>\r
"""


def written(spark: SparkSession) -> str:
    """A new shared folder with the sample as <version>/<book>.usx."""
    root = shared.folder(spark, "sample")
    for version, text in (("ONE", FIRST), ("TWO", SECOND)):
        shared.write_text(spark, f"{root}/{version}/GEN.usx", text)
    return root


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ONE", FIRST), ("TWO", SECOND)], "version string, value string")
