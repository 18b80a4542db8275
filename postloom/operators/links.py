"""Work lists with budgets: known urls first, one attempt for each url or host, results fanned back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.extract import board_slugs, company_host, is_interstitial
from ..functions.pages import is_challenge

# Fixed values.
LINK_BUDGET, HOST_BUDGET, MISS_DAYS = 400, 40, 30


def within_budget(df: DataFrame, most: int, order: str, *by: str) -> DataFrame:
    """Adds ``chosen``: the first ``most`` rows in order (of each group, if given); the rest are skipped, not lost.

    Without groups the first rows are found by a top-k, so no task gets all rows.
    """
    if by:
        return df.withColumn("chosen", F.row_number().over(W.partitionBy(*by).orderBy(order)) <= most)
    # rows that share an order are told apart by all their columns, so no more than ``most`` are chosen
    at = F.struct(F.col(order), F.xxhash64(*df.columns))
    last = df.select(at.alias("_at")).orderBy("_at").limit(most).agg(F.max("_at").alias("_last"), F.count("*").alias("_n"))
    return df.join(F.broadcast(last)).withColumn("chosen", (F.col("_n") > 0) & (at <= F.col("_last"))).drop("_last", "_n")  # one row


def to_resolve(incoming: DataFrame, known: DataFrame, most: int = LINK_BUDGET) -> DataFrame:
    """(url, seq, chosen): distinct interstitial urls that no known url (one column) covers, in first-seen order."""
    urls = incoming.where(is_interstitial(F.col("url"))).groupBy("url").agg(F.min("seq").alias("seq"))
    return within_budget(urls.join(known.toDF("url").distinct(), "url", "left_anti"), most, "seq")


def apply_resolved(incoming: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fan (url, target) back to every row with that url, where it has no apply_url yet."""
    out = incoming.join(resolved.select("url", F.col("target").alias("_target")), "url", "left")
    return out.withColumn("apply_url", F.coalesce("apply_url", "_target")).select(*incoming.columns)


def hosts_to_sniff(postings: DataFrame, cache: DataFrame, now: Column, most: int = HOST_BUDGET) -> DataFrame:
    """(host, company, seq, chosen): each company host with its first company, without fresh cache entries (host, found, at)."""
    hosts = postings.select(company_host(F.col("url")).alias("host"), "company", "seq").where("host is not null")
    hosts = hosts.groupBy("host").agg(F.min_by("company", "seq").alias("company"), F.min("seq").alias("seq"))
    fresh = cache.where(F.col("found") | F.coalesce(now - F.col("at") < F.make_dt_interval(days=F.lit(MISS_DAYS)), F.lit(False))).select("host").distinct()
    return within_budget(hosts.join(fresh, "host", "left_anti"), most, "seq")


def sniff_stored(pages: DataFrame) -> DataFrame:
    """Distinct (host, ats, slug) that stored pages (url, html) reveal."""
    rows = pages.select(company_host(F.col("url")).alias("host"), "html").where("host is not null")
    return board_slugs(rows, "html", "host").distinct()


def describe_page(url: Column, title: Column, body: Column) -> Column:
    body = F.left(F.coalesce(body, F.lit("")), F.lit(2000))
    note = F.when(is_challenge(title, body), " (looks like a bot check or block, not a markup change)").otherwise("")
    start = F.left(F.trim(F.regexp_replace(body, r"\s+", " ")), F.lit(300))
    return F.concat(F.lit("url="), F.coalesce(url, F.lit("")), F.lit(" title="), F.coalesce(title, F.lit("")), F.lit(" body_chars="), F.length(body).cast("string"), note, F.when(start != "", F.concat(F.lit(" starts: "), start)).otherwise(""))
