"""Connected components of large graphs by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as (node, comp): the smallest node of each component, for all nodes with an edge.

    Each round re-hangs every neighbour on the smallest one, first for larger, then for smaller neighbours.  A node with
    very many edges only meets partial aggregates and joins of two stored tables, which Spark can split.
    """
    pairs = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        pairs = saved(large.distinct())
        down = saved(pairs.groupBy("u").agg(F.min("v").alias("m")))
        small = pairs.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        pairs = saved(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        # Done when every node hangs on one other node that hangs on none.
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            pairs.select("v", F.lit(0), F.lit(1)))
        hung = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if hung.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return saved(stars.union(stars.select("comp", "comp").distinct()))


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after adding the edges ``links`` (a, b), by way of the graph of the components."""
    side = comps.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    ends = links
    for c in ("a", "b"):
        ends = ends.join(side, F.col(c) == F.col("n"), "left").withColumn(c, F.coalesce("c", c)).drop("n", "c")
    over = components(ends.select("a", "b"))
    known = comps.join(over.select(F.col("node").alias("n"), F.col("comp").alias("c")), F.col("comp") == F.col("n"), "left").select(
        "node", F.coalesce("c", "comp").alias("comp"))
    fresh = over.join(comps.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti")
    return saved(known.union(fresh))
