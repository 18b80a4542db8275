"""Text expressions: normalised keys, levels, skill matches, small parsers.  All are Column -> Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COMPANY_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "bv", "sa", "plc", "pvt", "pte", "holdings")
TITLE_TOKENS = {"sr": "senior", "jr": "junior", "engr": "engineer", "dev": "developer"}
TITLE_DROPPED = ("remote", "hybrid", "onsite", "urgent", "fulltime")
REMOTE_PLACE = "remote|anywhere|worldwide|work from home|wfh"
SENIOR_PATTERN = r"\b(senior|sr|lead|principal|staff|director|vp)\b"
ENTRY_PATTERN = r"\bjunior\b|\bjr\b|\bentry[\s\-]level\b|\b0[\s\-]?[-–][\s\-]?[12]\s*years?\b|\bnew\s+grad\b|\bfresh(man|er)?\b"
#: Of a class of characters: letters, marks, digits and the underscore of any script.
WORD = r"\p{L}\p{M}\p{N}_"
STOP_WORDS = ("a", "an", "the", "and", "or", "of", "in", "at", "for", "to", "with", "as", "is", "be", "are", "was", "were", "it", "on", "by", "from")


# LaTeX for characters that are special there, and for punctuation beyond ASCII.
LATEX = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "#": r"\#", "$": r"\$", "_": r"\_", "{": r"\{", "}": r"\}", "^": r"\^{}", "~": r"\textasciitilde{}",
    "\u2014": "---", "\u2013": "--", "\u2018": "`", "\u2019": "'", "\u201c": "``", "\u201d": "''", "\u2022": r"\textbullet{}", "\u2026": "...", "\u2192": " to ", "\u00d7": "x", "\u00a0": " ",
}


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; other letters separate."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_company(c: Column | str) -> Column:
    """Tokens without trailing legal suffixes; a single token always stays."""
    return F.regexp_replace(F.array_join(tokens(c), " "), f"(?<=[a-z0-9])( ({'|'.join(COMPANY_SUFFIXES)}))+$", "")


def normalize_title(c: Column | str) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TITLE_TOKENS.items() for x in kv))
    mapped = F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(known, t), t))
    return F.array_join(F.filter(mapped, lambda t: ~t.isin(*TITLE_DROPPED)), " ")


def normalize_location(c: Column | str) -> Column:
    """Empty, ``remote``, or the tokens before the first of , ; / |."""
    place = F.trim(text(c))
    first = F.array_join(tokens(F.split(place, r"[,;/|]")[0]), " ")
    return F.when(place == "", "").when(place.rlike(f"(?i){REMOTE_PLACE}"), "remote").otherwise(first)


def dedupe_hash(company: Column | str, title: Column | str, location: Column | str) -> Column:
    """The first 32 hex digits of the SHA-256 of the three normalised fields."""
    return normalized_hash(normalize_company(company), normalize_title(title), normalize_location(location))


def normalized_hash(company: Column | str, title: Column | str, location: Column | str) -> Column:
    """``dedupe_hash`` of fields that are normalised already, as where a join repeats each of them in many rows."""
    return F.substring(F.sha2(F.concat_ws("|", company, title, location), 256), 1, 32)


def experience_level(title: Column | str, description: Column | str) -> Column:
    both = F.lower(F.concat_ws(" ", text(title), text(description)))
    return F.when(both.rlike(SENIOR_PATTERN), "senior").when(both.rlike(ENTRY_PATTERN), "entry").otherwise("mid")


def flatten_skills(skills: Column) -> Column:
    """All values of a map of category to skills, in order, repeats kept."""
    return F.flatten(F.map_values(skills))


def skill_matches(description: Column | str, skills: list[str]) -> Column:
    """How many of the listed skills a description names; a skill listed twice counts twice."""
    said, total = F.lower(text(description)), F.lit(0)
    for skill in (s.lower() for s in skills):
        quoted = "\\Q" + skill.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        if " " in skill:
            hit = said.contains(skill)
        elif all(c.isalnum() or c == "_" for c in skill) and skill:
            hit = said.rlike(rf"\b{quoted}\b")
        else:
            hit = said.rlike(f"(?<![a-z0-9]){quoted}(?![a-z0-9])")
        total = total + hit.cast("int")
    return total


def word(pattern: str) -> str:
    """The pattern as a whole word: no letter, mark, digit or underscore of any script beside it.

    To be searched for and not taken out, as what stands beside the word is matched too; Java's look-behind misses letters beyond U+FFFF.
    """
    return rf"(?:^|[^{WORD}])(?:{pattern})(?:$|[^{WORD}])"


def title_words(title: Column | str) -> Column:
    words = F.filter(F.split(F.lower(text(title)), f"[^{WORD}]+"), lambda w: w.rlike("^[a-z]+$"))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def is_remote(location: Column | str, title: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", text(location), text(title))).contains("remote")


def strip_tags(c: Column | str, by: str = " ") -> Column:
    return F.regexp_replace(text(c), "<[^>]+>", by)


def html_to_lines(c: Column | str) -> Column:
    """Block tags become line feeds, other tags vanish; three or more line feeds become two."""
    lines = F.regexp_replace(text(c), r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr)\b[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, "<[^>]+>", ""), r"\n{3,}", "\n\n"))


def strip_fence(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def numbers_in(c: Column | str) -> Column:
    """The distinct numbers of a text, without their thousands commas."""
    found = F.regexp_extract_all(text(c), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def numbered_list(c: Column | str) -> Column:
    lines = F.transform(F.split(text(c), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d+\.\s*", "")))
    return F.filter(lines, lambda x: x != "")


def role_slug(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def ordered_distinct(items: Column, most: int = 10) -> Column:
    """Trimmed items, the first of each spelling (case ignored), at most ``most``."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    low = F.transform(trimmed, F.lower)
    return F.transform(F.slice(F.array_distinct(low), 1, most), lambda x: F.element_at(trimmed, F.array_position(low, x).cast("int")))


def age(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("int").cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).otherwise(
        F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m"))
    )


def latex_escape(c: Column | str) -> Column:
    """A text as LaTeX: special characters escaped, others folded to ASCII or left out; null is empty.

    Folding needs Unicode's decompositions, which no built-in function has, so Arrow batches go through Python.
    """
    class Table(dict):
        def __missing__(self, code: int) -> str:
            folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode() if code > 127 else chr(code)
            self[code] = folded if code < 128 else "".join(LATEX.get(x, x) for x in folded)
            return self[code]

    def escape(said: pd.Series) -> pd.Series:
        table = Table({ord(k): v for k, v in LATEX.items()})
        return said.fillna("").map(lambda x: x.translate(table))

    return F.pandas_udf(escape, "string")(text(c))
