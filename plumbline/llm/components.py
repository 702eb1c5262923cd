"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize


def _settled(pairs: DataFrame) -> bool:
    """Whether every id points at one id only, and none of those points on."""
    sources = pairs.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    targets = pairs.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    roles = sources.unionByName(targets).groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return roles.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that stands in ``links`` (a, b).

    Alternates two steps until every id points straight at its smallest one: every id
    links its larger neighbours to its smallest neighbour, then its smaller neighbours to
    the smallest one. Both are a grouped minimum joined back, so an id with very many
    links is no single group. The number of rounds grows with the logarithm of the
    longest chain; links that form stars already need none. Each round is written to the
    shared folder, which cuts the lineage.
    """
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "links")
    while not _settled(pairs):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).withColumn("_low", F.least("_low", "a"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("_low"))
        small = large.join(low, "a")
        pairs = (
            small.select(F.col("b").alias("a"), F.col("_low").alias("b"))
            .unionByName(low.select("a", F.col("_low").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        pairs = materialize(pairs, "links")
    ids = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
