"""Connected components of a graph whose links are rows, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Each node passes the least of its neighbours and itself to its greater neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node passes its least neighbour to its other lesser neighbours and to itself. Links have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (least id that can be reached) of every node of the links (a, b: longs, not null).

    Links in which both ends are one node are passed over. Each round writes its links, in place of the last round's;
    their number falls from round to round, and about log(n) rounds are needed. Nothing is kept by the driver but
    a count and a sum over the links.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links, state = scratch.put(links), None
    while True:
        links = scratch.put(_small_star(_large_star(links)).distinct(), instead_of=links)
        # in the final state each node is linked with the least node of its component and no other
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return scratch.put(links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), instead_of=links)
