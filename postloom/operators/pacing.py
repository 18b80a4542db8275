"""When scoring calls are sent: each provider answers one call after another, no faster than its rate allows.

A call that is refused waits and is sent again before the next one's turn, so it holds the line for its waits.  With C the
time that the calls before it hold the line, a call starts at C + max(ready - C) over itself and those before: two
running aggregates give every start at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..prefix import before, in_ranges

PER_MINUTE = 40
#: A refused call's waits: after the first refusal in places of the line, after the second in seconds.
WAITS = (2, 65)
SECOND = 1_000_000


def _waits(per_minute: int) -> tuple[int, int, int]:
    """Microseconds between calls, and after a first and a second refusal (whole seconds, as the line's places give them)."""
    place = 60 * SECOND // per_minute
    return place, WAITS[0] * place // SECOND * SECOND, WAITS[1] * SECOND


def schedule(calls: DataFrame, per_minute: int = PER_MINUTE) -> DataFrame:
    """Adds (position, start, answered, free) to calls (provider, id, ready, refusals): place in line from 0, microseconds, and whether a call is answered in the end.

    ``ready`` is in microseconds; the line goes by it, then by id, and ids are distinct.  ``refusals`` says how often a call is refused before
    it is answered; after the third refusal it is given up, and a fallback may take it from ``free`` on, when the line is free
    again.  A null ``ready`` or provider takes no part; null refusals are none.
    """
    place, first, second = _waits(per_minute)
    refused = F.coalesce(F.col("refusals"), F.lit(0))
    holds = F.lit(place) + F.when(refused >= 1, first).otherwise(0) + F.when(refused >= 2, second).otherwise(0)
    keys, order = ["provider"], ["ready", "id"]
    rows = in_ranges(calls.where("provider is not null and ready is not null").withColumn("_holds", holds.cast("long")), keys, order)
    rows = before(rows, keys, order, _before=("sum", F.col("_holds")), position=("sum", F.lit(1).cast("long")))
    rows = before(rows, keys, order, _latest=("max", F.col("ready") - F.col("_before")))
    start = F.col("_before") + F.greatest("_latest", F.col("ready") - F.col("_before"))
    return rows.withColumns({"start": start, "answered": refused <= 2, "free": start + F.col("_holds")}).drop("_before", "_latest", "_holds", "_range")


def sends(scheduled: DataFrame, per_minute: int = PER_MINUTE) -> DataFrame:
    """(provider, id, attempt, at): every time that a scheduled call is sent, attempts from 1."""
    _, first, second = _waits(per_minute)
    times = F.slice(F.array(F.col("start"), F.col("start") + first, F.col("start") + first + second), 1, F.least(F.coalesce("refusals", F.lit(0)), F.lit(2)).cast("int") + 1)
    return scheduled.select("provider", "id", F.posexplode(times).alias("attempt", "at")).withColumn("attempt", F.col("attempt") + 1)


def busiest(sent: DataFrame, seconds: int = 60) -> DataFrame:
    """(provider, sends, most): all sends, and the most in any ``seconds`` from one of them on.

    A window lies in two neighbouring stretches of time, so rows meet by stretch and no provider is one task.
    """
    wide = seconds * SECOND
    rows = sent.select("provider", "at", F.floor(F.col("at") / wide).cast("long").alias("own"))
    near = rows.select("provider", "at", "own", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("stretch"))
    ahead = W.partitionBy("provider", "stretch").orderBy("at").rangeBetween(0, wide - 1)
    counted = near.withColumn("n", F.count("*").over(ahead)).where("own = stretch")
    return counted.groupBy("provider").agg(F.count("*").alias("sends"), F.max("n").alias("most"))
