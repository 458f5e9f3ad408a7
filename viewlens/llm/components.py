"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import land

#: Links (two numbers each) that are kept in one partition, as adaptive
#: execution would read so few bytes: their rounds need no exchange.
FEW = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, comp)``: the smallest node reachable from
    each node that has a link. Nodes without links are absent.

    Alternates two star contractions (each link moves to a smaller common
    neighbour) until the link set no longer changes: O(log n) rounds on
    long chains, two or three on stars. Every round is landed, so a lost
    executor never replays earlier rounds. The minimum per node is a partial
    aggregate and the join back reads two plain tables, so a node with a
    third of all links is split by the skew join. Up to FEW links are one
    partition, and a round is one stage. Self-links, repeats and null ends
    are ignored; an empty table gives an empty table.
    """
    links = land(edges.where("a <> b")
                 .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    few = links.count() <= FEW  # links never become more
    one = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    seen = None
    for _ in range(max_rounds):
        links = one(links)
        both = one(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each larger neighbour of u links to the least of u's neighbourhood
        large = (links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
                 .select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = one(land(large, "cc"))
        # each smaller neighbour of u, and u, link to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = one(large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(lowest.select("u", F.col("m").alias("v"))).where("u <> v")).distinct()
        links = land(small, "cc")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
        seen = tuple(now)
    raise RuntimeError("components did not settle")
