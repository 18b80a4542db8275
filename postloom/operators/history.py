"""Run history: outcome facts, source rollups, statuses, retention; employment spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..prefix import before, in_ranges

OUTCOMES = ("inserted", "merged", "skipped", "stale")
RETAINED = 200


def outcome_tally(rows: DataFrame, by: str = "source", outcome: str = "outcome", kinds: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """A row for each source with a count for each outcome."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(outcome) == k).alias(k) for k in kinds))


def source_status(enabled: Column, count: Column, errors: Column) -> Column:
    some, bad = F.coalesce(count, F.lit(0)) > 0, F.coalesce(errors, F.lit(0)) > 0
    return F.when(~F.coalesce(enabled, F.lit(True)), "disabled").when(some & bad, "partial").when(some, "ok").when(bad, "failed").otherwise("empty")


def run_status(sources: DataFrame, by: str = "run_id") -> DataFrame:
    """failed if the run has an error, partial if an enabled source has errors and no jobs, else ok."""
    lost = F.coalesce("enabled", F.lit(True)) & (F.coalesce("fetched", F.lit(0)) == 0) & (F.coalesce("n_errors", F.lit(0)) > 0)
    return sources.groupBy(by).agg(F.when(F.bool_or(F.col("run_error").isNotNull()), "failed").when(F.bool_or(lost), "partial").otherwise("ok").alias("status"))


def source_facts(stats: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Union of reported sources (source, count, n_errors, enabled) and tallies; an unreported source's count is its tally."""
    both = stats.join(outcomes, "source", "full_outer")
    tally = sum((F.coalesce(F.col(k), F.lit(0)) for k in OUTCOMES), F.lit(0))
    fetched, enabled = F.coalesce("count", tally), F.coalesce("enabled", F.lit(True))
    return both.select("source", enabled.alias("enabled"), source_status(enabled, fetched, F.col("n_errors")).alias("status"), fetched.alias("fetched"), *(F.coalesce(k, F.lit(0)).alias(k) for k in OUTCOMES))


def recent(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def rollup(runs: DataFrame, sources: DataFrame, n: int = 20) -> DataFrame:
    """Each source over the last n runs, the most inserted first."""
    of = sources.join(recent(runs, n).select("run_id"), "run_id", "left_semi")
    out = of.groupBy("source").agg(F.count("*").alias("runs"), *(F.sum(c).alias(c) for c in ("fetched", "inserted", "merged")), F.sum((F.col("status") == "failed").cast("long")).alias("failures"))
    return out.orderBy(F.desc("inserted"), F.desc("fetched"), "source")


def prune(runs: DataFrame, sources: DataFrame, keep: int = RETAINED) -> tuple[DataFrame, DataFrame]:
    """Runs newer than the one after the newest ``keep``, and their sources; ties at that time go with it."""
    cutoff = runs.select("started_at").orderBy(F.desc("started_at")).offset(keep).limit(1).agg(F.max("started_at").alias("cutoff"))
    kept = runs.join(F.broadcast(cutoff)).where("cutoff is null or started_at > cutoff").drop("cutoff")  # one row
    return kept, sources.join(kept.select("run_id"), "run_id", "left_semi")


def merge_spans(spans: DataFrame, *by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of a group become one."""
    order = W.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col(start) > before)).cast("int")
    rows = spans.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_opens", opens)
    rows = rows.withColumn("_span", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_span").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_span")


def merge_hot_spans(spans: DataFrame, *by: str, start: str = "start", end: str = "end") -> DataFrame:
    """As ``merge_spans``, where a group may hold a large share of all spans: groups are split by ranges of their spans."""
    keys, order = list(by), [start, end]
    rows = spans.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(*by, start, end).distinct()
    rows = before(in_ranges(rows, keys, order), keys, order, _reached=("max", F.col(end)))
    rows = rows.withColumn("_opens", (F.col("_reached").isNull() | (F.col(start) > F.col("_reached"))).cast("long"))
    rows = before(rows, keys, order, _span=("sum", F.col("_opens"))).withColumn("_span", F.col("_span") + F.col("_opens"))
    return rows.groupBy(*by, "_span").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_span")


def total_years(spans: DataFrame, *by: str, start: str = "start", end: str = "end") -> DataFrame:
    merged = merge_spans(spans, *by, start=start, end=end)
    return merged.groupBy(*by).agg(F.round(F.sum(F.datediff(end, start)) / 365.25, 1).alias("years"))


def run_facts(outcomes: DataFrame, sources: DataFrame, boards: DataFrame) -> DataFrame:
    """One row: totals of a run's outcomes, its status, and the active boards that were polled."""
    tally = outcomes.agg(F.count("*").alias("fetched"), *(F.count_if(F.col("outcome") == k).alias(k) for k in OUTCOMES))
    lost = F.coalesce("enabled", F.lit(True)) & (F.coalesce("count", F.lit(0)) == 0) & (F.coalesce("n_errors", F.lit(0)) > 0)
    status = sources.agg(F.when(F.coalesce(F.bool_or(lost), F.lit(False)), "partial").otherwise("ok").alias("status"))
    polled = boards.agg(F.count_if("active").alias("boards_polled"))
    return tally.join(F.broadcast(status)).join(F.broadcast(polled))  # one row each


def with_skipped(stats: DataFrame, sources: DataFrame, only: list[str]) -> DataFrame:
    """Every known source (source): those outside ``only`` are recorded as disabled, not left out."""
    out = sources.join(stats, "source", "left")
    return out.withColumns({"enabled": F.when(~F.col("source").isin(*only), False).otherwise(F.coalesce("enabled", F.lit(True))), "count": F.coalesce("count", F.lit(0)), "n_errors": F.coalesce("n_errors", F.lit(0))})


def capped_errors(errors: DataFrame, most: int = 5, chars: int = 300) -> DataFrame:
    """(source, errors): the first distinct messages of (source, seq, message), cut to a length."""
    first = errors.groupBy("source", F.left("message", F.lit(chars)).alias("message")).agg(F.min("seq").alias("seq"))
    kept = first.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy("seq"))).where(F.col("_n") <= most)
    return kept.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]).alias("errors"))


def empty_runs(polls: DataFrame) -> DataFrame:
    """(ats, slug, consecutive_empty): how many polls (ats, slug, at, jobs) have been empty since the last that was not."""
    last = polls.groupBy("ats", "slug").agg(F.max(F.when(F.col("jobs") > 0, F.col("at"))).alias("_last"))
    since = polls.join(last, ["ats", "slug"]).where("_last is null or at > _last")
    counted = since.groupBy("ats", "slug").agg(F.count("*").alias("n"))
    return last.join(counted, ["ats", "slug"], "left").select("ats", "slug", F.coalesce("n", F.lit(0)).alias("consecutive_empty"))


def empty_reasons(stats: DataFrame, errors: DataFrame) -> DataFrame:
    """(source, reasons): enabled sources of (source, count, enabled) that gave nothing, with the first messages logged for them."""
    empty = stats.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("count", F.lit(0)) == 0)).select("source")
    return empty.join(capped_errors(errors).withColumnRenamed("errors", "reasons"), "source", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
