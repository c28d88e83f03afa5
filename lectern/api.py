"""The facade: what a page that shows the cloud asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import groups, pick as pk
from .plans import registry
from .sources import nodes_json
from .sources.store import Store


@dataclass
class Lectern:
    spark: SparkSession
    root: str
    verses: DataFrame | None = None

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root)

    def methods(self) -> list[str]:
        """Methods that can be built."""
        return sorted(registry.METHODS)

    def build(self, method: str, passages: DataFrame) -> None:
        """Runs a method and replaces its stored nodes and links."""
        nodes, links = registry.METHODS[method](passages)
        self.store.replace("nodes", method, nodes)
        self.store.replace("links", method, links)

    def get_data(self, method: str | None) -> tuple[DataFrame, DataFrame]:
        """Nodes and links of a method; empty without one."""
        return self.store.nodes(method), self.store.links(method)

    def get_topics(self, method: str) -> DataFrame:
        """group, n and centre of the groups of a method."""
        return groups.centroids(self.store.nodes(method))

    def get_verse_details(self, ref: str, version: str | None = None) -> DataFrame:
        """The verse in one version, or in all."""
        if self.verses is None:
            raise ValueError("no corpus was given")
        found = self.verses.where(F.col("ref") == ref)
        return found.where(F.col("version") == version) if version else found

    def load_nodes(self, method: str, json: str) -> bool:
        """Replaces a method's nodes by those of a JSON array. Text that is none, or an empty array, changes nothing."""
        try:
            nodes = nodes_json.load(self.spark, json)
        except ValueError:
            return False
        return self.store.replace("nodes", method, nodes)

    def pick(self, method: str, cx: float, cy: float, width: float = 800, height: float = 600) -> DataFrame:
        """The nearest node's id, ord, dist, group and text; no row for an empty cloud."""
        nodes = self.store.nodes(method)
        return pk.picked_details(pk.pick(nodes, cx, cy, width, height), nodes)

    toggle = staticmethod(pk.toggle)
