"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.llm.shared import few, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node that it reaches.

    Each round is two aggregations and two joins on the links, so that a node with very many links is pre-aggregated in the
    aggregation and split by the skewed-join rule in the join; no list of neighbours is ever built. The number of rounds grows with
    the logarithm of the component size. The rounds are written to the shared folder, in tasks and files as many as the links need,
    whose number never grows. No links give no rows; repeated links and links of a node with itself do no harm.
    """
    high, low = F.greatest(a, b).alias("v"), F.least(a, b).alias("u")
    edges = stored(links.where(F.col(a) != F.col(b)).select(high, low).distinct(), "links")
    count = edges.count()
    if not count:
        return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    while True:
        # large star: every larger neighbour of a node links to the smallest node around it
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = few(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), 2 * count)
        large = few(both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), count)
        # small star: a node and its smaller neighbours link to the smallest of them
        least = few(large.groupBy("v").agg(F.min("u").alias("m")), count)
        small = large.join(least, "v")
        small = small.select("v", F.col("m").alias("u")).unionByName(small.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")))
        after = stored(few(small.distinct(), count), "links")
        # done when the links are stars already: one link a node, and no root is linked on
        ends = after.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(after.select(F.col("u").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        ends = few(ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")), 2 * count)
        if ends.where("below > 1 OR below = 1 AND above = 1").isEmpty():
            tops = few(after.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), count)
            return after.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(tops)
        edges = after
