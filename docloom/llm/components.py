"""Connected components of a graph in a DataFrame, with every node's smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.llm import common as c


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b), longs.  component: the smallest node that can be reached.

    Alternating large-star and small-star steps: each node hands its larger, then its smaller neighbours to the smallest, until
    stars are left.  A node's smallest neighbour is an aggregate with partial sums, and goes back to its edges by a
    join, whose large partitions Spark can split; no neighbourhood is ever gathered.  Edges don't grow in number.
    """
    now = c.checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while True:
        # large star: both ways; every larger neighbour v of u to m(u)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour and u itself to m(u)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = c.checkpointed(small)
        # two 64-bit sums and the count of the edges tell whether a step changed them
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        was = state
