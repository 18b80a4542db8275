"""Profiles against postings: search queries, insights, skills, summaries, previews, and a cycle's counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import entry_years, month
from ..functions.text import ordered_distinct, strip_fence, text

# Skill categories in the order they are shown, with their labels; limits.
CATEGORIES = {"languages": "Languages", "frameworks": "Frameworks", "ai_ml": "AI/ML", "databases": "Databases", "clouds": "Cloud", "tools": "Tools"}
MOST_QUERIES, MOST_KEYWORDS, MOST_REQUIREMENTS, MOST_SIGNALS = 10, 15, 6, 4
SUMMARY_LENGTHS, PROMPT_CHARS = (40, 800), 4000


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def basis_hash(roles: Column, skills: Column) -> Column:
    """A key of what queries are made from: roles and skills, whatever their order."""
    return F.sha1(F.to_json(F.array(F.array_sort(_strings(roles)), F.array_sort(_strings(skills)))))


def expand_queries(profiles: DataFrame) -> DataFrame:
    """Profiles (id, roles, skills, cached_basis, cached_queries, reply) to (id, basis, queries, fresh).

    Cached queries of the same basis are used again; otherwise the roles come first and then those of the
    reply's JSON array, up to ten.  An unreadable reply leaves the roles and is not ``fresh``, so it is
    never cached.  Without roles there are no queries.
    """
    basis = basis_hash(F.col("roles"), F.col("skills"))
    more = F.try_variant_get(F.try_parse_json(strip_fence(F.col("reply"))), "$", "array<string>")
    some = F.size(_strings(F.col("roles"))) > 0
    cached = some & (F.col("cached_basis") == basis) & (F.size(_strings(F.col("cached_queries"))) > 0)
    found = F.when(~some, F.array().cast("array<string>")).when(cached, F.col("cached_queries")).when(more.isNull(), F.col("roles")).otherwise(ordered_distinct(F.concat("roles", more), MOST_QUERIES))
    return profiles.select("id", basis.alias("basis"), found.alias("queries"), F.coalesce(some & more.isNotNull() & ~F.coalesce(cached, F.lit(False)), F.lit(False)).alias("fresh"))


def literal_keywords(description: Column, terms: Column, most: int = MOST_KEYWORDS) -> Column:
    """Terms that stand in the description (case ignored), in alphabetical order."""
    low = F.lower(text(description))
    named = F.filter(F.array_distinct(_strings(terms)), lambda t: (t != "") & low.contains(F.lower(t)))
    by_case = F.array_sort(F.transform(named, lambda t: F.struct(F.lower(t).alias("low"), t.alias("term"))))
    return F.slice(F.transform(by_case, lambda x: x["term"]), 1, most)


def insights(reply: Column, description: Column, terms: Column) -> Column:
    """(keywords, requirements, company_signals) of a scorer's reply; literal keywords where it has none.

    A blank description has no insights at all.
    """
    v = F.try_parse_json(strip_fence(reply))

    def listed(name: str, most: int) -> Column:
        found = F.transform(_strings(F.try_variant_get(v, f"$.{name}", "array<string>")), lambda x: F.trim(x))
        return F.slice(F.filter(found, lambda x: x != ""), 1, most)

    none = F.array().cast("array<string>")
    said = text(description) != ""
    keywords = listed("keywords", MOST_KEYWORDS)
    return F.struct(
        F.when(~said, none).when(F.size(keywords) > 0, keywords).otherwise(literal_keywords(description, terms)).alias("keywords"),
        F.when(said, listed("requirements", MOST_REQUIREMENTS)).otherwise(none).alias("requirements"),
        F.when(said, listed("company_signals", MOST_SIGNALS)).otherwise(none).alias("company_signals"),
    )


def restore_skills(own: Column, selected: Column, missing: Column) -> Column:
    """The selected skills by category, with those of the profile's own that a posting asks for and misses."""
    wanted = F.transform(_strings(missing), F.lower)
    empty = F.expr("cast(map() as map<string, array<string>>)")
    back = F.transform_values(F.coalesce(own, empty), lambda _, items: F.filter(_strings(items), lambda s: F.array_contains(wanted, F.lower(s))))
    back = F.map_filter(back, lambda _, items: F.size(items) > 0)
    return F.map_zip_with(F.coalesce(selected, empty), back, lambda _, a, b: F.concat(_strings(a), F.array_except(_strings(b), _strings(a))))


def labelled_skills(skills: Column) -> Column:
    """(label, items) of the categories that have items: the known ones in their order, then the others."""
    known = F.array(*(F.struct(F.lit(label).alias("label"), F.try_element_at(skills, F.lit(key)).alias("items")) for key, label in CATEGORIES.items()))
    others = F.filter(F.map_entries(skills), lambda e: ~e["key"].isin(*CATEGORIES))
    others = F.transform(others, lambda e: F.struct(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))).alias("label"), e["value"].alias("items")))
    return F.filter(F.concat(known, others), lambda x: x["items"].isNotNull() & (F.size(x["items"]) > 0))


def accepted_summary(reply: Column, base: Column) -> Column:
    """The reply without quotes around it, if it is a short paragraph; else the base summary."""
    said = F.btrim(F.trim(text(reply)), F.lit('"'))
    return F.when(F.length(said).between(*SUMMARY_LENGTHS), said).otherwise(base)


def labels_used(calls: DataFrame, by: str = "id") -> DataFrame:
    """Calls (id, seq, label) to (id, labels): each label once, in the order of its first use."""
    first = calls.groupBy(by, "label").agg(F.min("seq").alias("seq"))
    return first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", "label"))).alias("l")).select(by, F.col("l.label").alias("labels"))


def role_previews(profiles: DataFrame, today: Column) -> DataFrame:
    """Profiles (id, experience) to (id, pos, label, dates, years), a row for each role held."""
    e = profiles.select("id", F.posexplode("experience").alias("pos", "e")).select("id", "pos", "e.*")
    or_else = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c), F.lit("?"))
    spelled = F.concat_ws(" – ", F.nullif("start_date", F.lit("")), F.nullif("end_date", F.lit("")))
    years = entry_years(F.col("years"), month(F.col("start_date"), today), month(F.col("end_date"), today, True))
    return e.select("id", "pos", F.concat(or_else("role", "title"), F.lit(" @ "), or_else("company")).alias("label"), spelled.alias("dates"), years.alias("years"))


def prompt(posting_title: Column, company: Column, place: Column, description: Column, roles: Column, skills: Column) -> Column:
    """What an injected scorer is asked: the posting, its description cut to a fixed length, and the profile."""
    lines = (("Posting", posting_title), ("Company", company), ("Place", place), ("Wanted roles", F.array_join(_strings(roles), ", ")), ("Skills", F.array_join(_strings(skills), ", ")))
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), text(c)) for name, c in lines))
    return F.concat(head, F.lit("\nDescription:\n"), F.left(text(description), F.lit(PROMPT_CHARS)))


def cycle_counters(results: DataFrame, result: str = "result") -> DataFrame:
    """One row: processed, matched, filtered_out, rate_limited and errors of a matching cycle."""
    r = F.col(result)
    error = F.coalesce(r == "error", F.lit(False))
    return results.agg(
        F.count_if(~error).alias("processed"), F.count_if(r == "matched").alias("matched"),
        F.count_if(~error & ~F.coalesce(r.isin("matched", "rate_limited"), F.lit(False))).alias("filtered_out"),
        F.count_if(r == "rate_limited").alias("rate_limited"), F.count_if(error).alias("errors"),
    )


def patch_section(sections: Column, name: str, value: Column) -> Column:
    """A profile's sections (a map of name to JSON text) with one replaced or added; the others stay as they are."""
    rest = F.map_filter(F.coalesce(sections, F.expr("cast(map() as map<string, string>)")), lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), value))
