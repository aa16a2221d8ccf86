"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations to a minimum and two joins on the node, so that no node's neighbours are ever
gathered; the links stay in tables. Links and minima are tables in the shared folder before they are joined: a join of
links with an aggregate that lies on the same partitioning could not be split where a node has a large part of the
links, as the centre of a star has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, cut


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(scratch: Scratch, links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(scratch: Scratch, links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, root) for each node with a link, root being the least node reachable. links has columns u and v, without nulls."""
    with Scratch(links.sparkSession, "components") as scratch:
        now = scratch.table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before = _digest(now)
        while before[0]:
            wide = scratch.table(_large_star(scratch, now), instead=now)
            now = scratch.table(_small_star(scratch, wide), instead=wide)
            after = _digest(now)
            if after == before:
                break
            before = after
        roots = now.select("u", F.col("v").alias("root"))
        return cut(roots.union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()))
