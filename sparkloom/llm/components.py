"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import dropped, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node reachable.

    Each round joins the links with the smallest neighbour of each node, found by a pre-aggregated groupBy, and
    is written to the shared folder; nothing but whether it is done reaches the driver. Null ends and
    links of a node to itself are ignored; repeated links count once.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    for _ in range(most_rounds):
        # done when the links are stars: every node has one link, to a root that has no link upwards
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        if ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("all")).where("ups > 1 OR (ups = 1 AND all > 1)").isEmpty():
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = written(to_least.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        dropped(edges), dropped(large)
        edges = small
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
