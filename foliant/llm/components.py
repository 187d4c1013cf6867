"""Connected components by alternating large-star and small-star.

Each round links every node to the smallest node near it; the rounds end when no edge changes, and then
every edge leads to the smallest node of its component. Edges are cut from their lineage after each round
by a table in the shared folder; the table of the round before is deleted. A node's neighbours are never gathered: each
star is a minimum by node (combined before the shuffle) joined back to the edges, and the edges of a node that has
many are dealt over several tasks in that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, spread_join, stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m, n), stored: the smallest neighbour of each node, and how many it has."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")


def large_star(edges: DataFrame, total: int | None = None) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("m", F.least("u", "m"))
    return spread_join(both.where("v > u"), low, "u", "v", total=total, counted="n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int | None = None) -> DataFrame:
    low = _lowest(edges)
    rest = spread_join(edges, low, "u", "v", total=total, counted="n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` that is not itself the smallest.

    Null ends, loops and repeated edges change nothing; no edges give no rows.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    links = stored(links, "cc")
    mark = _mark(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        large = stored(large_star(links, mark[0]), "cc-large")
        old, links = links, stored(small_star(large, mark[0]), "cc")
        remove(links.sparkSession, old)
        remove(links.sparkSession, large)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
