"""Connected components of a link table, in rounds of joins; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import keep


def components(links: DataFrame, tag: str = "links", most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of comparable ids -> (node, root): root is the smallest id that node reaches.

    Alternates large-star and small-star steps (each node's links are re-hung on the smallest
    neighbour), which end after a number of rounds that grows with the logarithm of the longest
    chain. Each round is written to the shared folder. A node without links gets no row.
    """
    edges = keep(links.select("a", "b").where("a <> b").distinct(), tag)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large star: every larger neighbour of a hangs on the smallest of a's neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours hang on the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = keep(small.where("a <> b").distinct(), tag)
        # done once every edge is a star: no parent is itself a child, and no child has two parents
        parents = new.groupBy("a").agg(F.count("*").alias("n"))
        loose = parents.where("n > 1").select("a").unionByName(new.join(parents.select(F.col("a").alias("b")), "b", "left_semi").select("a")).limit(1).count()
        edges = new
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
