"""Joining rows with aggregates of their group, when one group may hold most of the rows.

The aggregates are combined map-side.  A group of more than ``HOT_ROWS`` rows is then split by a hash of its
rows, and its aggregates are copied for each part, so no task gets a whole large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that may meet in one task, unless there are more than HOT_GROUPS times as many in all.
HOT_ROWS = 256
#: The most groups that are split; their keys are broadcast (16 bytes each).
HOT_GROUPS = 20_000


def with_group(rows: DataFrame, key: str, spread: str, total: int, *aggregates: Column, having: str = "true") -> DataFrame:
    """The rows with the aggregates of their key's group, of those groups that ``having`` holds for.

    ``spread`` names a column whose hash deals out the rows of a large group; ``total`` is the number of rows.
    Rows with a null key are left out; repeated rows stay.
    """
    most = max(HOT_ROWS, -(-total // HOT_GROUPS))
    groups = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates, F.ceil(F.count("*") / most).cast("int").alias("_parts")).where(having)
    hot = F.broadcast(groups.where("_parts > 1").select(key, "_parts"))  # at most HOT_GROUPS, as each has over total / HOT_GROUPS rows
    dealt = rows.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    groups = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(groups, [key, "_part"]).drop("_part")
