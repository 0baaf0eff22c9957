"""Connected components of links, as repeated joins and groupings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """key and group, the smallest key that links (a, b) reach; of linked keys only.

    Each round hooks every node and its larger neighbours to its smallest neighbour,
    then every node and its smaller neighbours likewise (large and small stars), until
    the links are stars.  Links stay links between the same components, their number
    does not grow, and a round is written down before the next reads it.
    """
    edges = stored(links.selectExpr("greatest(a, b) AS v", "least(a, b) AS u").where("u != v").distinct(), "links-round")
    while True:
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u != v").distinct()
        large = stored(large, "links-large")
        lows = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lows, "v")
        hooked = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u != v")
        after = stored(hooked.unionAll(small.select("v", F.col("m").alias("u"))).distinct(), "links-round")
        # Stars: no node that hangs on another has one hanging on it, nor hangs twice.
        if not after.join(after.select(F.col("v").alias("u")), "u", "left_semi").head(1) and not after.groupBy("v").count().where("count > 1").head(1):
            break
        edges = after
    return after.select(F.col("v").alias("key"), F.col("u").alias("group")).unionAll(
        after.select(F.col("u").alias("key"), F.col("u").alias("group")).distinct())
