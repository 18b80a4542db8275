"""Finding boards: slugs in postings and lists, merged under caps; validation of slugs; yields and the backfill's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import BOARD_PATTERNS, board_slugs, candidate_slugs
from .boards import assemble

# How many slugs a family may have by discovery.
DISCOVERED_CAP, DISCOVERED_CAPS = 100, {"workday": 15, "smartrecruiters": 30}
BACKFILL_ATTEMPTS = 3


def merge_found(existing: DataFrame, found: DataFrame) -> DataFrame:
    """(ats, slug, rank): existing (ats, slug, pos) boards in their order, then found (ats, slug) by name, up to the caps."""
    new = found.select("ats", "slug").distinct().withColumn("pos", F.lit(0))
    return assemble([existing, new], DISCOVERED_CAPS, DISCOVERED_CAP)


def discover(postings: DataFrame, existing: DataFrame) -> DataFrame:
    """Boards that postings (source, url, apply_url, description) link to, merged into the existing ones.

    Postings that a board itself gave are left out.
    """
    from_elsewhere = ~F.coalesce(F.col("source").isin(*BOARD_PATTERNS, "workday"), F.lit(False))
    said = postings.where(from_elsewhere).select(F.concat_ws("\n", "url", "apply_url", "description").alias("said"))
    return merge_found(existing, board_slugs(said, "said"))


def harvest(lists: DataFrame, existing: DataFrame, text_col: str = "value") -> DataFrame:
    """Boards that community lists (whole texts, as ``spark.read.text(wholetext=True)`` gives them) name."""
    return merge_found(existing, board_slugs(lists, text_col))


def validate(configured: DataFrame, cache: DataFrame, probed: DataFrame) -> DataFrame:
    """(ats, slug, resolved, status) of configured (ats, slug); repeated ones come out once.

    A cached (ats, slug, resolved) answer stands, null meaning that nothing works.  Otherwise the slug and
    then its variants are tried against probed (ats, slug, valid); one that could not be probed counts as
    valid.  The status is ``ok``, ``fixed`` or ``invalid``.
    """
    rows = configured.select("ats", "slug").distinct()
    tries = rows.join(cache.select("ats", "slug"), ["ats", "slug"], "left_anti")
    tries = tries.select("ats", "slug", F.posexplode(F.concat(F.array("slug"), candidate_slugs(F.col("slug")))).alias("pos", "candidate"))
    tries = tries.join(probed.select("ats", F.col("slug").alias("candidate"), "valid"), ["ats", "candidate"], "left")
    works = F.when(F.coalesce("valid", F.lit(True)), F.struct("pos", "candidate"))
    found = tries.groupBy("ats", "slug").agg(F.min(works).alias("best")).select("ats", "slug", F.col("best.candidate").alias("resolved"))
    found = found.unionByName(rows.join(cache.select("ats", "slug", "resolved"), ["ats", "slug"]))
    return found.withColumn("status", F.when(F.col("resolved").isNull(), "invalid").when(F.col("resolved") != F.col("slug"), "fixed").otherwise("ok"))


def yields(postings: DataFrame) -> DataFrame:
    """(ats, slug, jobs): postings that each board gave."""
    return postings.where("ats is not null and slug is not null").groupBy("ats", "slug").agg(F.count("*").alias("jobs"))


def backfill_report(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """One row of a backfill's counters.

    ``scanned`` has a row for each posting (host, attempted, resolved, given); ``found`` the boards (ats,
    slug, sniffed) that it led to.  per_ats maps a family to its number of distinct slugs.
    """
    of_postings = scanned.agg(
        F.count("*").alias("jobs_scanned"), F.countDistinct("host").alias("hosts_seen"), F.count_if(F.col("attempted")).alias("links_attempted"),
        F.count_if(F.col("resolved")).alias("links_resolved"), F.count_if(F.col("given")).alias("jobs_given_apply_url"),
    )
    per_ats = found.groupBy("ats").agg(F.countDistinct("slug").alias("n"), F.countDistinct(F.when(F.col("sniffed"), F.col("slug"))).alias("s"))
    of_boards = per_ats.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("boards_found"), F.coalesce(F.sum("s"), F.lit(0)).alias("boards_sniffed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ats", "n")))).alias("per_ats"),
    )
    return of_postings.crossJoin(F.broadcast(of_boards))  # one row each


def backfill_due(done: Column, attempts: Column, most: int = BACKFILL_ATTEMPTS) -> Column:
    """Whether the one-time backfill of a profile is to run: not yet done, and not failed too often."""
    return ~F.coalesce(done, F.lit(False)) & (F.coalesce(attempts, F.lit(0)) < most)


def backfill_record(done: Column, attempts: Column, error: Column) -> Column:
    """(done, attempts, error) after an attempt: without an error it is done, with one it counts."""
    return F.struct((F.coalesce(done, F.lit(False)) | error.isNull()).alias("done"), (F.coalesce(attempts, F.lit(0)) + error.isNotNull().cast("int")).alias("attempts"), F.left(error, F.lit(200)).alias("error"))
