"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and one equi join, so a node
with very many links is split by the skew join and no group is gathered in one task. Links
stay in DataFrames; between rounds they are a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tidy, written

#: Rounds grow with the logarithm of the longest chain; this only guards against a fault.
MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links hold u > v."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node has one parent at most, and no parent has one."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


@tidy
def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has a link to another node, with the smallest node reachable.

    links: two columns of one orderable type; nulls, self links, repeats and either direction
    are allowed. No links give an empty table.
    """
    a, b = F.col(a), F.col(b)
    now = written(
        links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        after = written(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
