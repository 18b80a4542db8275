"""Document assembly: keyword coverage, selection, grounding of numbers, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import numbers_in, text


def coverage(said: Column, keywords: Column) -> Column:
    """(present, missing) keywords, as substrings with case ignored."""
    low = F.lower(text(said))
    return F.struct(F.filter(keywords, lambda k: low.contains(F.lower(k))).alias("present"), F.filter(keywords, lambda k: ~low.contains(F.lower(k))).alias("missing"))


def keyword_score(said: Column, keywords: Column) -> Column:
    return F.size(coverage(said, keywords)["present"])


def select_best(items: DataFrame, by: str, score: str, pos: str, most: int) -> DataFrame:
    """The best-scoring items above 0 of each group, stable in their first order."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), pos))
    return items.where(F.col(score) > 0).withColumn("rank", rank).where(F.col("rank") <= most)


def first_spellings(items: DataFrame, by: str, order: str, item: str, most: int = 10) -> DataFrame:
    """(by, items): each group's items in order as ``text.ordered_distinct`` keeps them, for groups of any size.

    Spellings are reduced map-side, so a group is as many rows as it has spellings.
    """
    said = items.select(by, order, F.trim(item).alias("_said")).where("_said <> ''")
    first = said.groupBy(by, F.lower("_said").alias("_low")).agg(F.min(F.struct(order, "_said")).alias("_first"))
    rank = F.row_number().over(W.partitionBy(by).orderBy("_first"))
    kept = first.withColumn("_n", rank).where(F.col("_n") <= most)
    return kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("_first")), lambda x: x["_said"]).alias("items"))


def ungrounded(tailored: Column, originals: Column) -> Column:
    """Numbers that the tailored text has and the originals lack."""
    return F.array_except(numbers_in(tailored), numbers_in(originals))


def ground(tailored: Column, originals: Column) -> Column:
    """Bullets that bring new numbers go back to the original of the same place (or vanish where there is none)."""
    known = F.array_distinct(F.flatten(F.transform(originals, lambda b: numbers_in(b))))
    kept = F.transform(tailored, lambda b, i: F.when(F.size(F.array_except(numbers_in(b), known)) == 0, b).otherwise(F.try_element_at(originals, i + 1)))
    return F.filter(kept, lambda b: b.isNotNull())


def ordered_skills(skills: Column, canonical: Column) -> Column:
    """Canonical skills in their order, then the others with capitals."""
    low = F.transform(skills, lambda s: F.lower(s))
    return F.concat(F.filter(canonical, lambda c: F.array_contains(low, F.lower(c))), F.transform(F.filter(skills, lambda s: ~F.array_contains(F.transform(canonical, lambda c: F.lower(c)), F.lower(s))), lambda s: F.initcap(s)))


def current_versions(documents: DataFrame, *by: str, version: str = "version") -> DataFrame:
    """Adds is_current: the newest version of each group."""
    return documents.withColumn("is_current", F.col(version) == F.max(version).over(W.partitionBy(*by)))


def next_version(documents: DataFrame, *by: str) -> DataFrame:
    return documents.groupBy(*by).agg((F.count("*") + 1).alias("next_version"))


def trim_level(bullets: Column, level: int) -> Column:
    return F.slice(bullets, 1, max(1, 5 - level))


def grounded_selection(chosen: Column, known: Column) -> Column:
    """What a reply chose of the known ids, in the profile's order; null where it chose none, so that a fallback can stand in."""
    kept = F.filter(F.array_distinct(known), lambda x: F.array_contains(F.coalesce(chosen, F.array().cast("array<string>")), x))
    return F.when(F.size(kept) > 0, kept)
