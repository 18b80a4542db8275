"""The faceted search over stored postings: conditional filters, null-aware sorts, pages, facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regions import search_location
from ..scratch import new_path

VISIBLE = ("new", "matched", "filtered_out", "docs_generated")
PAGE = 50


@dataclass(frozen=True)
class Query:
    status: str = ""
    source: str = ""
    level: str = ""
    location: str = ""
    text: str = ""
    remote: bool = False
    min_score: str = ""
    reason: str = ""
    sort: str = "score_desc"
    page: int = 0


def order(sort: str, tie: str = "id") -> list[Column]:
    """Unknown keys mean score_desc; the tie column makes pages stable."""
    date = F.coalesce("posted_at", "fetched_at")
    known = {"score_desc": F.desc_nulls_last("llm_score"), "score_asc": F.asc_nulls_first("llm_score"), "date_desc": date.desc(), "date_asc": date.asc(), "company": F.asc("company")}
    return [known.get(sort, known["score_desc"]), F.asc(tie)]


def matching(postings: DataFrame, q: Query) -> DataFrame:
    """Blank parameters filter nothing; an unknown status or a minimum that is no integer is ignored."""
    df = postings.where(F.col("status") == q.status if q.status in VISIBLE else F.col("status").isin(*VISIBLE))
    for column, value in (("source", q.source), ("experience_level", q.level), ("filter_reason", q.reason)):
        if value:
            df = df.where(F.col(column) == value)
    if q.text:
        df = df.where(F.col("title").ilike(f"%{q.text}%") | F.col("company").ilike(f"%{q.text}%"))
    if q.location.strip():
        df = df.where(search_location(F.col("location"), F.col("is_remote"), q.location))
    if q.remote:
        df = df.where("is_remote")
    if q.min_score.strip().lstrip("-").isdigit():
        df = df.where(F.col("llm_score") >= int(q.min_score))
    return df


def page(postings: DataFrame, q: Query, size: int = PAGE) -> DataFrame:
    return matching(postings, q).orderBy(*order(q.sort)).offset(q.page * size).limit(size)


class Pages:
    """Any page of a search, read from its own range of the order alone.

    The matching rows are written once, by ranges of the order; a histogram of the ranges (a number for each, kept on the driver)
    tells which of them a page lies in.  A page then sorts those ranges only, however deep it is.
    """

    def __init__(self, postings: DataFrame, q: Query, ranges: int = 200, size: int = PAGE):
        self.spark, self.order, self.size, self.path = postings.sparkSession, order(q.sort), size, new_path(postings.sparkSession, "pages")
        rows = matching(postings, q).repartitionByRange(ranges, *self.order).withColumn("_range", F.spark_partition_id())
        self.schema = rows.drop("_range").schema
        rows.write.parquet(self.path, partitionBy="_range")
        written = self.spark.read.schema(rows.schema).parquet(self.path)
        self.counts = sorted((r["_range"], r["n"]) for r in written.groupBy("_range").agg(F.count("*").alias("n")).collect())

    def page(self, number: int) -> DataFrame:
        """The rows of a page, in order; none beyond the last one."""
        low, high, before, paths, skipped = number * self.size, (number + 1) * self.size, 0, [], 0
        for part, n in self.counts:
            if before < high and before + n > low:
                skipped = skipped if paths else low - before
                paths.append(f"{self.path}/_range={part}")
            before += n
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).orderBy(*self.order).offset(skipped).limit(self.size)


def total(postings: DataFrame, q: Query) -> int:
    return matching(postings, q).count()


def sources(postings: DataFrame) -> DataFrame:
    return postings.where("source <> ''").select("source").distinct().orderBy("source")


def latest_or_given(postings: DataFrame, given) -> DataFrame:
    """At most one row with a description: that with the given id, else the one fetched last (no time counts as latest; then by id)."""
    described = postings.where("description <> ''")
    return described.orderBy((F.col("id") != F.lit(given)).asc_nulls_last(), F.desc_nulls_first("fetched_at"), "id").limit(1)
