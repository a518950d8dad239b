"""Connected components of a link table, by alternating star operations.

Each round points every node at the smallest node it knows (large star, then
small star) until nothing changes.  Only per-node minima and links are shuffled,
no neighbour list is ever gathered, and rounds are logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import Scratch


def _star(links: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """One operation on rows (u, v). Minima are written first, so that both sides of
    the join are plain exchanges and the partition of a hot node can be split."""
    if large:
        links = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = links.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest node.

    Self links and repeated links don't matter; no links give no rows.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = scratch.save(pairs, "links")
    state = None
    for _ in range(most_rounds):
        wide = scratch.save(_star(now, scratch, large=True).distinct(), "large")
        after = scratch.save(_star(wide, scratch, large=False).distinct(), "small")
        scratch.drop(now, wide)
        now = after
        row = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state or not row[0]:
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.save(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
