"""Alignment of editions, coverage, and joins with ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import free


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on ``key``: what only one edition has is a legitimate row. Null keys meet nothing and stay on both
    sides; a key that a side repeats meets each; an empty side leaves the other. Other columns must differ in name."""
    return left.join(right, key, "full_outer")


def side_by_side(verses: DataFrame, versions: list[str]) -> DataFrame:
    """ref and one text column per version. The versions are stated, so no pass is needed to find them."""
    return verses.groupBy("ref").pivot("version", versions).agg(F.first("text"))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key ``b`` lacks, repeated ones too; rows with a null key stay."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def range_join(ranges: DataFrame, points: DataFrame, low: str, high: str, at: str, width: int = 64, on: tuple[str, ...] = ()) -> DataFrame:
    """Ranges and points with low <= at <= high (integers) and equal columns ``on``, each pair once.

    The number line is cut into bins of ``width``: a range has a row for each bin that it touches, a point for
    its own, so the join is an equi-join on bins that splits over tasks, not a comparison of everything with
    everything. Choose ``width`` near the usual length of ranges. Ranges with high < low or nulls, and points or keys
    that are null, meet nothing; repeated ranges and points meet each; no rows give no rows. All columns but ``on`` must differ in name.
    """
    place = free("bin", beside=(ranges, points))[0]
    binned = ranges.where(F.col(high) >= F.col(low)).withColumn(place, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    placed = points.withColumn(place, F.floor(F.col(at) / width))
    return binned.join(placed, [place, *on]).where(F.col(at).between(F.col(low), F.col(high))).drop(place)
