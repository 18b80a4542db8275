"""Like-for-like comparison of scoring models over rows (id, model, score, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(scores: DataFrame) -> DataFrame:
    """Per model: scored, average to one decimal (0.0 if none), unreadable and failed replies."""
    ok = F.col("score").isNotNull()
    return scores.groupBy("model").agg(F.count_if(ok).alias("scored"), F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("average"), F.count_if(F.col("status") == "unreadable").alias("unreadable"), F.count_if(F.col("status") == "error").alias("errors"))


def matrix(scores: DataFrame, models: list[str]) -> DataFrame:
    """A row for each id with a column for each model."""
    return scores.groupBy("id").pivot("model", models).agg(F.first("score"))


def flips(scores: DataFrame, base: str, other: str, threshold: int) -> DataFrame:
    """Ids that the two models put on different sides of the threshold."""
    m = matrix(scores.where(F.col("model").isin(base, other)), [base, other])
    a, b = F.col(f"`{base}`"), F.col(f"`{other}`")
    crossed = a.isNotNull() & b.isNotNull() & ((a >= threshold) != (b >= threshold))
    return m.where(crossed).select("id", a.alias("from"), b.alias("to"), F.when(b >= threshold, "gained").otherwise("lost").alias("direction"))


def report(jobs: DataFrame, scores: DataFrame, models: list[str], threshold: int, most: int = 200) -> str:
    """A fixed-width report of at most ``most`` jobs (id, title, company), made on the driver."""
    rows = jobs.join(matrix(scores, models), "id", "left").orderBy("id").limit(most).collect()
    if not rows or not models:
        return "Nothing to compare: no jobs with descriptions."
    width = max(map(len, models)) + 2
    lines = ["Scores by job", "-" * 60, f"{'JOB':<42}" + "".join(f"{m[-18:]:>{width}}" for m in models)]
    for r in rows:
        label = f"{r.title[:26]} @ {r.company[:12]}"
        lines.append(f"{label:<42}" + "".join(f"{'-' if r[m] is None else r[m]:>{width}}" for m in models))
    lines += ["", "Summary", "-" * 60]
    lines += [f"  {r.model}: scored {r.scored}, average {r.average}, unreadable {r.unreadable}, errors {r.errors}" for r in summarize(scores).orderBy("model").collect()]
    if len(models) > 1:
        crossed = flips(scores, models[0], models[1], threshold).join(jobs, "id").orderBy("id").limit(most).collect()
        lines += ["", f"Crossed {threshold} ({models[0]} to {models[1]})", "-" * 60]
        lines += [f"  {r.title[:40]} @ {r.company[:18]}: {r['from']} to {r.to} ({r.direction})" for r in crossed] or ["  none"]
    return "\n".join(lines)


def progress(status: F.Column, since: F.Column, now: F.Column, stale_seconds: int = 2700) -> F.Column:
    """(active, stalled): a record that claims to run for longer than stale_seconds, by any part of a second, has stalled."""
    runs = status.isin("queued", "running")
    stalled = runs & F.coalesce(now - F.make_dt_interval(secs=F.lit(stale_seconds)) > since, F.lit(False))
    return F.struct((runs & ~stalled).alias("active"), stalled.alias("stalled"))
