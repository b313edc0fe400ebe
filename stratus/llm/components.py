"""Connected components by alternating large and small stars.

Each round is two joins against per-node minima (aggregated before they are shuffled),
so no node's neighbours are gathered anywhere and a star whose centre holds a third of
all edges is a skewed join that AQE splits. Rounds grow with the logarithm of the longest
chain; each is written to the shared folder. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratus.llm.common import written


def _star(edges: DataFrame) -> DataFrame:
    """For each u, its neighbours of a larger number are linked to the least of all."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return written(out.filter("a < b").distinct(), "stars")


def _small_star(edges: DataFrame) -> DataFrame:
    """For each u, its neighbours of smaller numbers and itself are linked to their least."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return written(out.filter("a < b").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), two columns of one integer type:
    root is the smallest node that can be reached. Loops and repeats are allowed; no
    links give an empty table."""
    e = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        e = _small_star(_star(e))
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
