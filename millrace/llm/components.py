"""Connected components of an undirected link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: root is the least node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each keeps connectivity and
    needs one grouped minimum and one join on the node, so no component is ever gathered in one
    task; stars pull hot nodes' edges to their minima. Rounds are written to the shared folder, and so
    are their minima: both sides of a join are then shuffled afresh, and Spark can split a hub's rows.
    A node type with an order is enough. Empty links give an empty result.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m")), "minima")
        large = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links")
        # small star: a node's smaller neighbours and the node itself link to the least of them
        small_min = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "minima")
        joined = large.join(small_min, large.u == small_min.n)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_min.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
