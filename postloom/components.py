"""Connected components of a list of links, by minimum labels over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize
from .skew import with_group


#: Links of a node that may meet in one task; where none has more, each minimum is a window, which shuffles the links once.
NODE_LINKS = 20_000


def _with_least(links: DataFrame, total: int, windows: bool) -> DataFrame:
    """Links (u, v) with ``m``, the least v of each u."""
    if windows and (links.groupBy("u").count().agg(F.max("count")).first()[0] or 0) <= NODE_LINKS:
        return links.withColumn("m", F.min("v").over(W.partitionBy("u")))
    return with_group(links, "u", "v", total, F.min("v").alias("m"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", windows: bool = False) -> DataFrame:
    """(node, component): component is the smallest node that links reach, the node itself included.

    Only nodes with a link appear.  Nulls and self-links are ignored; repeated links do no harm.
    Each round replaces every node's links by links to its neighbourhood's minimum (the large-star
    and small-star steps), so the number of rounds is about the logarithm of the longest path.
    A node with very many links is split over tasks; with ``windows`` a round first counts each node's links, and where none has many it shuffles them once.  Rounds are written to the shared folder; only a
    count comes to the driver.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs, before = materialize(pairs, "links"), None
    total = pairs.count()
    while True:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        large = _with_least(both, 2 * total, windows).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialize(large.distinct(), "stars")
        small = _with_least(large, total, windows).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.where("u <> v").distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v").distinct().select("v", "v"))
