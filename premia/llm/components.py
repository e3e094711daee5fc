"""Connected components of a link table, all in joins and aggregates.

Alternating large-star and small-star rounds: each round hooks a node's neighbours onto its smallest
neighbour, until every component is a star around its smallest node. Each round is written to the
shared folder, so a lost executor costs at most one round. A hub's links are joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.frames import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    joined = both.join(low, "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionAll(low.select("u", F.col("low").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) names; root is the component's smallest node.

    Links may repeat, run either way or join a node to itself. No links: no rows.
    """

    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionAll(roots)
