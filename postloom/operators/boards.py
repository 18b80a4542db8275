"""The registry of company boards: upsert, results of polls, ranking, layered assembly, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Origins that never retire, limits.
PROTECTED_ORIGINS = ("configured", "seed")
MAX_EMPTY = 8
TOTAL_CAP, CAPS = 300, {"workday": 30, "smartrecruiters": 80}
# Boards that are polled from the start, by family.
SEEDS = {
    "greenhouse": (
        "stripe", "airbnb", "robinhood", "coinbase", "databricks", "gitlab", "cloudflare", "doordashusa", "instacart", "pinterest", "reddit", "lyft",
        "twitch", "mongodb", "datadog", "elastic", "asana", "figma", "brex", "affirm", "flexport", "samsara", "vercel", "airtable", "discord",
        "duolingo", "gusto", "okta", "pagerduty", "scaleai", "sofi", "squarespace", "zscaler", "chime", "checkr",
    ),
    "lever": ("netflix", "palantir", "plaid", "voleon", "mistral", "zoox", "matchgroup", "spotify", "kraken", "octoenergy", "highspot", "outreach", "veeva"),
    "ashby": (
        "openai", "linear", "notion", "ramp", "deel", "replit", "supabase", "posthog", "cursor", "perplexity", "vanta", "mercury", "clever", "zip",
        "hightouch", "sierra", "docker", "modal", "elevenlabs",
    ),
    "workday": ("nvidia:wd5:NVIDIAExternalCareerSite", "salesforce:wd12:External_Career_Site", "adobe:wd5:external_experienced", "workday:wd5:Workday"),
}


def upsert(boards: DataFrame, found: DataFrame, now: Column, revive: bool = False) -> DataFrame:
    """Found (ats, slug, company, source_host, origin) boards become rows; known ones are seen again.

    Empty company and host are filled, never replaced; ``revive`` makes retired boards active.
    """
    new = found.withColumn("slug", F.trim("slug")).where("slug <> ''").groupBy("ats", "slug").agg(F.first("company", True).alias("_company"), F.first("source_host", True).alias("_host"), F.first("origin").alias("_origin"), F.lit(True).alias("_found"))
    both = boards.join(new, ["ats", "slug"], "full_outer")
    fresh, seen = F.col("origin").isNull(), F.coalesce("_found", F.lit(False))
    return both.select(
        "ats", "slug", F.coalesce(F.nullif("company", F.lit("")), "_company").alias("company"), F.coalesce("origin", "_origin").alias("origin"), F.coalesce(F.nullif("source_host", F.lit("")), "_host").alias("source_host"),
        F.when(fresh, True).when(seen & F.lit(revive), True).otherwise(F.col("active")).alias("active"),
        F.when(seen & F.lit(revive) & ~F.coalesce("active", F.lit(True)), 0).otherwise(F.coalesce("consecutive_empty", F.lit(0))).alias("consecutive_empty"),
        F.coalesce("last_job_count", F.lit(0)).alias("last_job_count"), F.coalesce("total_job_count", F.lit(0)).alias("total_job_count"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), "last_fetched_at",
    )


def record_results(boards: DataFrame, polled: DataFrame, now: Column, max_empty: int = MAX_EMPTY) -> DataFrame:
    """Polled (ats, slug, jobs, had_errors): jobs reset the run of empty polls, their lack extends it unless the
    family had errors; a run of max_empty retires a board that is neither configured nor a seed."""
    both = boards.join(polled.select("ats", "slug", F.coalesce("jobs", F.lit(0)).alias("_jobs"), F.coalesce("had_errors", F.lit(False)).alias("_bad")), ["ats", "slug"], "left")
    was, got = F.col("_jobs").isNotNull(), F.col("_jobs") > 0
    empty = F.when(got, 0).when(was & ~F.col("_bad"), F.col("consecutive_empty") + 1).otherwise(F.col("consecutive_empty"))
    retire = was & ~got & ~F.col("_bad") & (empty >= max_empty) & ~F.col("origin").isin(*PROTECTED_ORIGINS)
    return both.withColumns({"active": F.when(retire, False).otherwise(F.col("active")), "consecutive_empty": empty, "last_job_count": F.when(was, F.col("_jobs")).otherwise(F.col("last_job_count")), "total_job_count": F.col("total_job_count") + F.coalesce("_jobs", F.lit(0)), "last_fetched_at": F.when(was, now).otherwise(F.col("last_fetched_at"))}).drop("_jobs", "_bad")


def cap_of(ats: Column, caps: dict[str, int] = CAPS, default: int = TOTAL_CAP) -> Column:
    out = F
    for name, n in caps.items():
        out = out.when(ats == name, n)
    return out.otherwise(F.lit(default))


def _capped(rows: DataFrame, caps: dict[str, int], default: int) -> DataFrame:
    """Rows up to their family's cap; the greatest cap is a number, so tasks cut each family to it before rows are shuffled."""
    return rows.where(F.col("rank") <= max([default, *caps.values()])).where(F.col("rank") <= cap_of(F.col("ats"), caps, default))


def ranked(boards: DataFrame, caps: dict[str, int] = CAPS, default: int = TOTAL_CAP) -> DataFrame:
    """Active boards of each family by yield, up to its cap; adds ``rank``."""
    order = W.partitionBy("ats").orderBy(F.desc("last_job_count"), F.desc("total_job_count"), F.desc_nulls_last("last_seen_at"), "slug")
    rows = boards.where("active").withColumn("rank", F.row_number().over(order))
    return _capped(rows, caps, default)


def assemble(layers: list[DataFrame], caps: dict[str, int] = CAPS, default: int = TOTAL_CAP) -> DataFrame:
    """(ats, slug, rank): layers of (ats, slug, pos) in order, the first of each slug (case ignored), up to the cap."""
    rows = layers[0].select("ats", "slug", "pos", F.lit(0).alias("layer"))
    for k, layer in enumerate(layers[1:], 1):
        rows = rows.union(layer.select("ats", "slug", "pos", F.lit(k)))
    first = W.partitionBy("ats", F.lower("slug")).orderBy("layer", "pos", "slug")
    kept = rows.where("slug <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("ats").orderBy("layer", "pos", "slug")))
    return _capped(kept, caps, default).select("ats", "slug", "rank")


def summary(boards: DataFrame) -> DataFrame:
    active = F.sum(F.col("active").cast("long"))
    return boards.groupBy("ats").agg(F.count("*").alias("total"), active.alias("active"), (F.count("*") - active).alias("retired"), F.sum("total_job_count").alias("jobs"))


def retired(boards: DataFrame, most: int = 200) -> DataFrame:
    return boards.where("not active").orderBy(F.desc_nulls_last("last_fetched_at"), "ats", "slug").limit(most)


def leaderboard(boards: DataFrame, most: int = 25) -> DataFrame:
    return boards.where("total_job_count > 0").orderBy(F.desc("total_job_count"), "ats", "slug").limit(most)


def reactivate(boards: DataFrame, ats: str, slug: str) -> DataFrame:
    hit = (F.col("ats") == ats) & (F.col("slug") == slug)
    return boards.withColumns({"active": F.col("active") | hit, "consecutive_empty": F.when(hit, 0).otherwise(F.col("consecutive_empty"))})


def seeds(spark: SparkSession) -> DataFrame:
    """(ats, slug, pos) of the seeds, a layer for ``assemble``."""
    return spark.createDataFrame([(ats, slug, k) for ats, slugs in SEEDS.items() for k, slug in enumerate(slugs)], "ats string, slug string, pos int")
