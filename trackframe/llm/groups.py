"""Connected groups of a table of links, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.session import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from every node of `links` (a, b).

    Every round points each node's larger neighbours, then its smaller ones, at the smallest it knows,
    which takes about as many rounds as the logarithm of a group's width. A round ends as a written
    table; only its row count and a checksum come to the driver.
    """
    now = checkpoint(links.filter("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = checkpoint(small.filter("u <> v").distinct())
    nodes = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return nodes.union(nodes.select(F.col("comp").alias("node"), "comp").distinct())
