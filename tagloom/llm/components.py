"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.workspace import store


def _least(edges: DataFrame) -> DataFrame:
    """Every (v, u) with m, the least of v and all its neighbours."""
    low = edges.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
    return edges.join(low, "v")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``; the component is its least id.

    Links may repeat, point either way or join an id to itself; rows with a null
    end are ignored; no links give no rows. Each round is written to the shared
    folder and at most keeps the number of links, so a hub with very many
    neighbours stays a set of pairs and is never gathered.
    """
    edges = store(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct(),
        "links",
    )
    for _ in range(rounds):
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _least(both).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        small = _least(large)
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(
            small.select("v", F.col("m").alias("u"))
        )
        made = store(small.where("v <> u").distinct(), "links")
        # A forest of stars: one low end for each high end, and none of them is a high end itself.
        lows = made.groupBy("v").agg(F.count("*").alias("n"))
        if lows.where("n > 1").isEmpty() and made.join(lows.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        edges = made
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return made.select(F.col("v").alias("id"), F.col("u").alias("component")).union(
        made.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    )
