"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined map-side) and a join; a hub's links are split by the
skew-join handling, never gathered. Rounds are logarithmic in practice; each ends in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) with u > v. Large: both directions, larger neighbours go to the least. Small: smaller ones and the node itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """links(a, b) -> node, component (the least node reachable). Nodes without a link have no row; null ends are dropped."""
    pairs = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = cut(_star(_star(edges, True), False))
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
