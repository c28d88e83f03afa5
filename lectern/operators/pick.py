"""Nearest-node picking and lookup of details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as sc

#: Larger distances never win (the bound a search starts with: the largest 32-bit float).
FARTHEST = 3.4028234663852886e38
#: Clicks that are sent to the nodes at once; picks up to which their ids are.
CLICKS = 10_000


def _near(nodes: DataFrame, gx: Column, gy: Column, single: bool) -> DataFrame:
    """Nodes with their distance, without those whose distance is NaN or beyond the bound."""
    d = sc.distance(F.col("x"), F.col("y"), gx, gy, single)
    return nodes.withColumn("dist", d).where(~F.isnan("dist") & (F.col("dist") < F.lit(FARTHEST)))


def pick(nodes: DataFrame, cx: float, cy: float, width: float = sc.WIDTH, height: float = sc.HEIGHT, single: bool = False) -> DataFrame:
    """id, ord, dist of the node nearest to a click, ties to the lowest ``ord``; no row for an empty cloud.

    A partial minimum per task, then one row from each: the cloud is neither sorted nor moved.
    """
    gx, gy = sc.to_clip(F.lit(cx), F.lit(cy), width, height)
    best = _near(nodes, gx, gy, single).agg(F.min_by(F.struct("id", "ord", "dist"), F.struct("dist", "ord")).alias("best"))
    return best.where("best is not null").select("best.*")


def pick_many(nodes: DataFrame, clicks: DataFrame, width: float = sc.WIDTH, height: float = sc.HEIGHT, block: int = CLICKS) -> DataFrame:
    """click_id, id, ord, dist: the nearest node of each click (click_id, cx, cy).

    ``clicks`` is a stated query set: blocks of about ``block`` of them are sent to the nodes in turns, and every
    task keeps one candidate per click. A click with a null place, or an empty cloud, gives no row; of clicks that repeat a
    click_id the nearest answer counts.
    """
    gx, gy = sc.to_clip(F.col("cx"), F.col("cy"), width, height)
    asked = clicks.select("click_id", gx.alias("gx"), gy.alias("gy"))
    blocks, found = max(1, -(-clicks.count() // block)), None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("click_id"), F.lit(blocks)) == i) if blocks > 1 else asked
        met = _near(nodes.select("ord", "id", "x", "y").crossJoin(F.broadcast(part)), F.col("gx"), F.col("gy"), False)
        best = met.groupBy("click_id").agg(F.min_by(F.struct("id", "ord", "dist"), F.struct("dist", "ord")).alias("best"))
        found = best if found is None else found.unionByName(best)
    return found.select("click_id", "best.*")


def pick_topk(nodes: DataFrame, cx: float, cy: float, k: int, width: float = sc.WIDTH, height: float = sc.HEIGHT) -> DataFrame:
    """The ``k`` nearest nodes (an extension): each task keeps its k best."""
    gx, gy = sc.to_clip(F.lit(cx), F.lit(cy), width, height)
    return _near(nodes, gx, gy, False).orderBy("dist", "ord").limit(k).select("id", "ord", "dist")


def details(nodes: DataFrame, node_id: str | Column) -> DataFrame:
    """id, group, text of the first node (by ``ord``) with an id."""
    return nodes.where(F.col("id") == node_id).orderBy("ord").limit(1).select("id", "group", "text")


def picked_details(picked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first node with each picked id: nodes are reduced before they are joined. A pick without a node, or a null
    id, gives no row; repeated picks give each."""
    ids = picked.select("id").distinct()
    few = ids.limit(CLICKS + 1).count() <= CLICKS
    first = nodes.join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("group", "text"), "ord").alias("n"))
    return picked.join(first, "id").select(*picked.columns, "n.group", "n.text")


def toggle(current: str | None, clicked: str) -> str | None:
    """Selecting the selected node clears the selection."""
    return None if clicked == current else clicked
