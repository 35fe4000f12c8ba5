"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored

#: Rounds after which something must be wrong; each at least halves the depth of the trees.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); component is its least node.

    Each round hangs every node on the least node that it or its parent knows:
    large-star moves larger neighbours, small-star the others.  A round is two
    aggregations and two joins on long keys; its result is written to the shared
    folder, so lineage stays short.  No rows for no links.
    """
    edges = stored(_downward(links.select("a", "b")), "component-links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _downward(both.filter("b > a").join(least, "a").select("b", F.col("m").alias("a"))).select("a", "b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = stored(_downward(small), "component-links")
        if new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty():
            stars = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
        edges = new
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def _downward(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node, without loops."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
