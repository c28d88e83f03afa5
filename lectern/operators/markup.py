"""Running state over the tokens of markup pages (page_id, pos, tok), and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import text as tx

#: Tags without an end. Fixed values.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def _so_far() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def tokens(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(tx.tokens(F.col("html"))).alias("pos", "tok"))


def _name() -> Column:
    return F.lower(F.regexp_extract("tok", r"^</?([A-Za-z0-9]+)", 1))


def _step() -> Column:
    name = _name()
    return F.when((name == "") | name.isin(*VOID), 0).when(F.col("tok").startswith("</"), -1).otherwise(1)


def last_opened(tokens: DataFrame) -> DataFrame:
    """Adds opened: the tag that was opened last, filled forward; '' before the first."""
    event = F.when(_step() == 1, _name())
    return tokens.withColumn("opened", F.coalesce(F.last(event, ignorenulls=True).over(_so_far()), F.lit("")))


def depth(tokens: DataFrame) -> DataFrame:
    """Adds depth: tags open after each token."""
    return tokens.withColumn("depth", F.sum(_step()).over(_so_far()).cast("long"))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id and text: the text runs of a page in order, white space collapsed. One expression per row, no exchange."""
    runs = F.filter(tx.tokens(F.col("html")), lambda t: ~t.startswith("<"))
    return pages.select("page_id", tx.collapse(F.array_join(runs, " ")).alias("text"))
