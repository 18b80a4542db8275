"""Applications and their documents beside postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_application(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """Adds application_id: the first created one of each posting, null if none."""
    first = applications.groupBy("job_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("application_id"))
    return postings.join(first.withColumnRenamed("job_id", "id"), "id", "left")


def missing_applications(postings: DataFrame, applications: DataFrame, now: Column) -> DataFrame:
    """New application rows (id, job_id, status, created_at) for matched postings without one; ids are deterministic."""
    lacking = postings.where("status = 'matched'").join(applications.select(F.col("job_id").alias("id")), "id", "left_anti")
    return lacking.select(F.sha2(F.concat(F.lit("application:"), F.col("id").cast("string")), 256).alias("id"), F.col("id").alias("job_id"), F.lit("pending").alias("status"), now.alias("created_at"))


def listed(applications: DataFrame) -> DataFrame:
    """Newest first; those without a time come before all."""
    return applications.orderBy(F.desc_nulls_first("created_at"), "id")


def documents_by_type(documents: DataFrame) -> DataFrame:
    return documents.orderBy("application_id", "type", F.desc("version"))


def with_current_documents(applications: DataFrame, documents: DataFrame, types: tuple[str, ...] = ("resume", "cover_letter")) -> DataFrame:
    """Adds for each type the newest version, null if none."""
    newest = documents.groupBy("application_id").pivot("type", list(types)).agg(F.max("version"))
    return applications.join(newest.select(F.col("application_id").alias("id"), *(F.col(t).alias(f"{t}_version") for t in types)), "id", "left")


def next_status(status: Column, passed: Column, score_status: Column, available: Column) -> Column:
    """new -> filtered_out, matched, or new again while no scorer is available; other states stay."""
    return F.when(status != "new", status).when(~passed, "filtered_out").when(~available, "new").otherwise(score_status)


def join_bullets(experience: DataFrame, tailored: DataFrame) -> DataFrame:
    """Tailored bullets (company, title, bullets, seq) on experience; the last duplicate wins, none keeps the original."""
    rank = F.row_number().over(W.partitionBy("company", "title").orderBy(F.desc("seq")))
    last = tailored.withColumn("_n", rank).where("_n = 1").select("company", "title", F.col("bullets").alias("_bullets"))
    return experience.join(last, ["company", "title"], "left").withColumn("bullets", F.coalesce("_bullets", "bullets")).drop("_bullets")


def profile_gaps(skills: Column, roles: Column, experience: Column, years: Column, summary: Column, name: Column) -> Column:
    """What a profile lacks that scoring uses, the worst first, as stable keys."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    flat = F.flatten(F.map_values(skills))
    gaps = F.array(
        F.when(~some(flat), "skills"), F.when(~some(roles), "target_roles"), F.when(~some(experience), "experience").when(F.coalesce(years, F.lit(0.0)) == 0, "experience_dates"),
        F.when(F.coalesce(summary, F.lit("")) == "", "summary"), F.when(F.coalesce(name, F.lit("")) == "", "name"),
    )
    return F.array_compact(gaps)
