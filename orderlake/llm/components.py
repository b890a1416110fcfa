"""Connected components of a graph given by its links, by alternating stars.

Large-star and small-star rounds (Kiveris et al., 2014) hang every node on the smallest
node it can see until nothing changes, in a number of rounds that grows with the
logarithm of the nodes. Minima are aggregated before they are shuffled and joined back, so
a node with most of the links is no single task's work. Each round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlake.llm.scratch import written


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, m): the links with the smallest node that u sees, itself included."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = _with_least(both)
    return seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _with_least(down)
    hung = seen.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(seen.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every linked node; the component is its smallest node. Links may repeat or be loops."""
    now = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    now, before = written(now, "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = written(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
