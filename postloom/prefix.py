"""Running sums and maxima over an order that one group may hold most of.

A window over a group is one task, however large the group is.  Here rows are dealt by ranges of the group and the order
together, so a large group lies in many ranges; each range's windows start anew, and what earlier ranges of the same group add up to is
carried in from a table with a row for each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize

KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows, written, with ``_range``: a number that grows with (keys, order) and parts large groups."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or small ranges would be put together
    return materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def before(rows: DataFrame, keys: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """Adds for each name the sum or maximum of a value over all rows of the group that come before in the order.

    ``rows`` are those of ``in_ranges`` with the same keys and order, columns added or not; the order must tell all rows of a group
    apart.  Of no rows the sum is 0 and the maximum null.  Null keys are a group.
    """
    own = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"_v_{name}": value for name, (_, value) in values.items()})
    totals = rows.groupBy(*keys, "_range").agg(*(KINDS[kind][0](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in values.items()))
    ranges = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a group
    carried = totals.select(*(F.col(k).alias(f"_k_{k}") for k in [*keys, "_range"]), *(KINDS[kind][0](f"_t_{name}").over(ranges).alias(f"_c_{name}") for name, (kind, _) in values.items()))
    rows = rows.withColumns({f"_l_{name}": KINDS[kind][0](f"_v_{name}").over(own) for name, (kind, _) in values.items()})
    met = F.lit(True)
    for k in [*keys, "_range"]:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(carried, met, "left").withColumns({name: KINDS[kind][1](F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name, (kind, _) in values.items()})
    return out.drop(*(f"_k_{k}" for k in [*keys, "_range"]), *(f"_{c}_{name}" for name in values for c in "vlc"))
