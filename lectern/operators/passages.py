"""Passages from ordered units (group, order, text): concatenation and roll-up to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered_concat(order: str, text: str, separator: str = " ") -> Column:
    """Texts of a group joined in order; sorting the gathered pairs does not depend on how rows arrive."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), separator)


def concat(units: DataFrame, group: str, order: str, text: str) -> DataFrame:
    return units.groupBy(group).agg(F.count("*").alias("n"), ordered_concat(order, text).alias("text"))


def sections(units: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """Adds section: how many section starts there were up to a unit; units before the first are section 0."""
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.withColumn("section", F.sum(F.when(starts, 1).otherwise(0)).over(so_far).cast("long"))
