"""The rule cascade with reasons, the score gate, and status transitions."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regions import Preferences, describe, location_allowed
from ..functions.text import STOP_WORDS, skill_matches, text, title_words, word

# Title words, and the stable keys of reasons with their labels.
SENIOR_WORDS = ("senior", "sr", "staff", "principal", "lead", "director", "vp", "head")
REASONS = {"title_mismatch": "Title doesn't match target roles", "seniority": "Too senior for your experience", "location": "Outside your locations", "excluded_company": "Excluded company", "few_skills": "Too few skills in description", "no_description": "No job description available", "low_score": "AI score below your minimum", "manual": "You filtered it manually"}


@dataclass(frozen=True)
class Profile:
    target_roles: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    excluded_companies: tuple[str, ...] = ()
    prefs: Preferences = field(default_factory=Preferences)
    total_years: float = 0.0
    junior_max_years: float = 3.0
    filter_senior: bool = True
    min_skills: int = 2
    min_score: int = 70


def _role_words(roles: tuple[str, ...]) -> set[str]:
    import re

    return {w for r in roles for w in re.findall(r"\b[a-z]+\b", r.lower())}


def shares_word(title: Column, roles: tuple[str, ...]) -> Column:
    words = sorted(_role_words(roles) - set(STOP_WORDS))
    return F.arrays_overlap(title_words(title), F.array(*map(F.lit, words)).cast("array<string>")) if words else F.lit(False)


def resembles_role(roles: tuple[str, ...], least: float = 0.7):
    """A pandas UDF: whether a title's difference ratio to any role reaches the least.  For titles that share no word."""
    from difflib import SequenceMatcher

    @F.pandas_udf("boolean")
    def run(titles: pd.Series) -> pd.Series:
        def ratio(t: str | None) -> bool:
            found = (SequenceMatcher(None, (t or "").lower(), r.lower()) for r in roles)
            return any(m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least for m in found)  # the quick ones are upper bounds

        known = {t: ratio(t) for t in titles.unique()}
        return titles.map(known)

    return run


def matches_role(title: Column, roles: tuple[str, ...]) -> Column:
    """Whether a title shares a word with a role or resembles one; no shuffle, each batch's distinct titles are compared once."""
    shares = F.coalesce(shares_word(title, roles), F.lit(False))
    return shares | resembles_role(roles)(F.when(~shares, title)) if roles else shares


def blocked_by_seniority(title: Column, p: Profile) -> Column:
    if not p.filter_senior or p.total_years >= p.junior_max_years:
        return F.lit(False)
    blocked = [w for w in SENIOR_WORDS if w not in _role_words(p.target_roles)]
    return F.lower(text(title)).rlike(word("|".join(blocked))) if blocked else F.lit(False)


def evaluate(postings: DataFrame, p: Profile, title_matches: Column | None = None) -> DataFrame:
    """Adds ``outcome`` (passed, score, reason, detail) to postings (title, company, location, is_remote, description).

    The order of the rules is fixed and the first that rejects names itself.  Unless ``title_matches`` is given,
    a title matches by a word or, as in ``title_matches()``, by its difference ratio to a role.
    """
    title = F.col("title")
    matches = title_matches if title_matches is not None else matches_role(title, p.target_roles)
    matched = skill_matches("description", list(p.skills))
    first_senior = F.coalesce(*(F.when(F.lower(text(title)).rlike(word(w)), w) for w in SENIOR_WORDS), F.lit("senior"))

    def out(passed: bool, score: Column, reason: str | None, detail: Column) -> Column:
        return F.struct(F.lit(passed).alias("passed"), score.cast("double").alias("score"), F.lit(reason).cast("string").alias("reason"), detail.cast("string").alias("detail"))

    none, zero = F.lit(None), F.lit(0.0)
    roles = ", ".join(p.target_roles[:5]) or "none set"
    cascade = F.when(~matches, out(False, zero, "title_mismatch", F.format_string(f"Title '%s' shares no keyword with your target roles ({roles.replace('%', '%%')}).", title)))
    cascade = cascade.when(blocked_by_seniority(title, p), out(False, zero, "seniority", F.format_string(f"Title contains '%s', which is filtered while your profile shows under {p.junior_max_years:g} years of experience.", first_senior)))
    cascade = cascade.when(location_allowed(F.col("location"), F.col("is_remote"), p.prefs) == F.lit(False), out(False, zero, "location", F.concat(F.lit("Location '"), F.coalesce(F.nullif("location", F.lit("")), F.lit("unknown")), F.lit(f"' is outside your preferences ({describe(p.prefs)})."))))
    cascade = cascade.when(F.lower(text("company")).isin(*(c.lower() for c in p.excluded_companies)) & (text("company") != ""), out(False, zero, "excluded_company", F.concat(F.col("company"), F.lit(" is on your excluded-companies list."))))
    if not p.skills:
        return postings.withColumn("outcome", cascade.otherwise(out(True, F.lit(1.0), None, none)))
    few = matched < p.min_skills
    cascade = cascade.when(few & (F.trim(text("description")) == ""), out(False, zero, "no_description", F.lit("The source returned no description, so skills couldn't be matched.")))
    cascade = cascade.when(few, out(False, zero, "few_skills", F.format_string(f"Only %d of your {len(p.skills)} skills appear in the description; the minimum is {p.min_skills}.", matched)))
    return postings.withColumn("outcome", cascade.otherwise(out(True, matched / len(p.skills), None, none)))


def gate(score: Column, seniority_fit: Column, min_score: int) -> Column:
    """(llm_score, status, reason, detail): a misfit in seniority costs 15 points, floor 0."""
    fits = F.coalesce(seniority_fit, F.lit(True))
    final = F.when(fits, score).otherwise(F.greatest(F.lit(0), score - 15))
    penalty = F.when(fits, "").otherwise(" (after a 15-point seniority penalty)")
    detail = F.concat(F.lit("AI scored this "), final.cast("int").cast("string"), F.lit("/100"), penalty, F.lit(f", below your minimum of {min_score}."))
    passed = final >= min_score
    return F.struct(final.alias("llm_score"), F.when(passed, "matched").otherwise("filtered_out").alias("status"), F.when(~passed, "low_score").alias("reason"), F.when(~passed, detail).alias("detail"))


def toggle(postings: DataFrame, ids: list[str]) -> DataFrame:
    """Flip chosen postings between matched and filtered_out by hand."""
    chosen = F.col("id").isin(*ids)
    to = F.when(F.col("status") == "filtered_out", "matched").otherwise("filtered_out")
    return postings.withColumns({"status": F.when(chosen, to).otherwise(F.col("status")), "filter_reason": F.when(chosen, F.when(to == "filtered_out", "manual")).otherwise(F.col("filter_reason"))})


def title_matches(postings: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Adds ``title_ok``.  The costly ratio runs once for each distinct title that shares no word with a role."""
    titles = postings.select("title").distinct().withColumn("_shares", shares_word(F.col("title"), roles))
    alike = titles.where("not _shares").withColumn("title_ok", resembles_role(roles)("title")).select("title", "title_ok")
    known = titles.where("_shares").select("title", F.lit(True).alias("title_ok")).union(alike)
    return postings.join(known.withColumnRenamed("title", "_t"), postings["title"].eqNullSafe(F.col("_t")), "left").drop("_t")


def reason_histogram(postings: DataFrame) -> DataFrame:
    return postings.where("status = 'filtered_out' and filter_reason is not null").groupBy("filter_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "filter_reason")
