"""Column names that do not clash."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(*stems: str, beside: tuple[DataFrame, ...]) -> list[str]:
    """A name for each stem that no column of the given tables has, whatever its case."""
    taken, found = {c.lower() for df in beside for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
