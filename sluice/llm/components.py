"""Connected components of a table of links, by contraction.

In each round every vertex points to its least neighbour, pointers are followed twice, and the links are rewritten
between what they point to; links inside one vertex vanish. Neither links nor components come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import Scratch, partitions

#: Links that make a partition worth its task.
_TASK_LINKS = 50_000


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component) of every vertex of links (a, b); a component is named by its least vertex. No links: no rows."""
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    links = scratch.save(links, "given")
    n = min(partitions(scratch.spark), links.count() // _TASK_LINKS + 1)
    live = scratch.save(links.where("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct().coalesce(n), "links")
    roots = scratch.save(live.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("component")).coalesce(n), "roots")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("up"))
        least = scratch.save(least.coalesce(n), "least")
        jump = least.select(F.col("v").alias("up"), F.col("up").alias("top"))
        once = least.join(jump, "up").select("v", F.col("top").alias("up"))
        tops = scratch.save(once.join(jump, "up").select("v", F.col("top").alias("up")).coalesce(n), "tops")
        ends = [tops.select(F.col("v").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab"]
        moved = live.join(ends[0], "a").join(ends[1], "b").where("a_up <> b_up").select(*ordered(F.col("a_up"), F.col("b_up"))).distinct()
        moved = scratch.save(moved.coalesce(n), "links")
        named = roots.join(tops.select(F.col("v").alias("component"), "up"), "component", "left")
        named = scratch.save(named.select("v", F.coalesce("up", "component").alias("component")).coalesce(n), "roots")
        scratch.drop(live, roots, least, tops)
        live, roots = moved, named
    scratch.drop(live, links)
    return roots
