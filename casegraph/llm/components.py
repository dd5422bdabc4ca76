"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two group-minima and two joins on the links; hubs need no collected neighbour lists, and the links are
written to the shared folder after each round, so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import drop, stash


def _round(links: DataFrame) -> DataFrame:
    """links (u, v), u > v."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where(F.col("u") != F.col("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return small.union(down.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root (the smallest node of its component) for each node of `links` (a, b: longs).

    Links to self and repeated links change nothing; links with a null end are left out; no links, no rows.
    """
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = stash(now, "links")
    state = None
    for _ in range(most_rounds):
        new, new_path = stash(_round(now), "links")
        drop(new.sparkSession, path)
        now, path = new, new_path
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
