"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinwright.llm.storage import checkpoint, hold, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest reachable node.

    Alternates large-star and small-star steps: each replaces edges by as many
    or fewer edges that point at smaller nodes, so a hub never gathers its
    neighbours in one row and the number of rounds grows with the logarithm of
    the longest path.  Minima are aggregated before they are shuffled and kept apart,
    so that the joins with them can split the edges of a hub.
    """
    # rows of two ids: fewer and larger files than there are shuffle partitions
    files = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    links = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().coalesce(files))
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = hold(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # large star: larger neighbours of a go to the least of a's neighbourhood
        large = hold(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: smaller neighbours, and a itself, go to the least of them
        down = hold(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = checkpoint(moved.select("e.a", "e.b").where("a <> b").distinct().coalesce(files))
        release(links, least, large, down)
        links = after
        # a forest of stars: every node has one parent and no parent has one
        parents = links.select(F.col("b").alias("a")).distinct()
        if links.groupBy("a").count().where("count > 1").select("a").unionByName(links.select("a").join(parents, "a", "left_semi")).isEmpty():
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
