"""Connected components of a table of links, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(links: DataFrame) -> DataFrame:
    """links: a, b. One row (node, root) per linked node; the root is the component's least node and has a row itself.

    Links to oneself or with a null end are dropped; no links give no rows.
    """
    now = contracted(links)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.saved_at = now.saved_at
    return out


def contracted(links: DataFrame) -> DataFrame:
    """As components(), but one row (a, b) per linked node `a` that isn't its component's root `b`; saved.

    Every round joins links with per-node minima only, so a hub's links are never held at once, and ends in a written table.
    """
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not stars(now):
        least = now.union(now.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        # Every greater neighbour of a node moves to the node's least one; dealt out once for the minima and their join.
        large = now.join(least, "b").select("a", F.col("m").alias("b")).repartition("a")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        to = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        small = large.join(least, "a").select(F.explode(F.array_compact(F.array(to("a"), F.when(F.col("b") != F.col("m"), to("b"))))).alias("link")).select("link.*")
        last, now = now, saved(small.distinct(), "links")
        dropped(last)
    return now


def stars(links: DataFrame) -> bool:
    """Whether every node either has one link to a lesser node or none: then the roots are the components' least nodes."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(links.select("b", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return nodes.where("down > 1 or (down = 1 and n > 1)").isEmpty()
