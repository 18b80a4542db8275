"""How far the sources of each language differ in the terms they use, from wide term vectors.

Each kept term becomes one row whose array has a place for every source of its language.  Higher-order
functions turn the counts into smoothed shares, and each pair of places into its contribution, the
difference of the two shares; contributions are summed map-side by pair, so only one number for a pair
and task is shuffled.  All arithmetic is on integers; numerators are decimals, so no corpus is too large.

A term's row is as wide as its language has sources, and so is a language's row of sources and sizes:
both must fit a task.  No row depends on the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import materialize

#: A language keeps the terms that are in at least so many of its documents.
MIN_DOCS = 30
#: So many terms of a group are reported.
TOP = 50
SHARE, SMOOTH = 1_000_000_000, 5
#: So many (lang, source) groups at most are broadcast (their names, and 16 bytes each); more are joined by shuffles.
BROADCAST_GROUPS = 100_000

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, of rows (lang, source, text).

    A document's terms are followed by its distinct terms, so one exploded pass gives both counts, and
    both are summed map-side.
    """
    terms = docs.select("lang", "source", F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0)).alias("terms"))
    rows = terms.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    occurs = (F.col("at") < F.col("size")).cast("long")
    return rows.groupBy("lang", "source", "term").agg(F.sum(occurs).alias("n"), F.sum(1 - occurs).alias("docs"))


def _dense(entries: Column, width: Column) -> Column:
    """An array of ``width`` counts from (place, n) entries in order of place, zeros elsewhere, in linear time."""
    zeros = lambda k: F.array_repeat(F.lit(0).cast("long"), k.cast("int"))
    before = lambda k: F.coalesce(F.get(entries, k - 1)["place"], F.lit(-1))
    filled = F.flatten(F.transform(entries, lambda e, k: F.concat(zeros(e["place"] - before(k) - 1), F.array(e["n"]))))
    return F.concat(filled, zeros(width - 1 - F.element_at(entries, -1)["place"]))


def _share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (size + 5 * terms)), exactly."""
    wide = [((count + SMOOTH).cast("decimal(20,0)") * F.lit(SHARE)).cast("decimal(38,0)"), (size + SMOOTH * terms).cast("decimal(20,0)")]
    return F.lit(1).cast("long") + F.call_function("div", *wide)


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring (lang, source) group.

    Part ``pair``: each other source of the language and the sum of differences over all kept terms, all ranks
    (0 without kept terms).  Part ``term``: the ``top`` kept terms that the group uses more than its language does.
    Ranks go by value downwards, then by item in UTF-8 order.  Null langs, sources and texts are ''; a group whose
    texts have no terms still has its pairs; repeated rows count each; other columns are ignored; no rows give none.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source"), said(text_col).alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(docs.select("lang", "source").distinct().withColumn("place", place), "groups")
    bounded = F.broadcast if groups.count() <= BROADCAST_GROUPS else lambda df: df

    counts = term_counts(docs).join(bounded(groups), ["lang", "source"])
    entries = F.array_sort(F.collect_list(F.struct("place", "n"))).alias("entries")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), entries).where(F.col("docs") >= min_docs).select("lang", "term", "entries"), "terms")

    sizes = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.place").alias("place")).agg(F.sum("e.n").alias("size"))
    sized = groups.join(sizes, ["lang", "place"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    by_place = F.array_sort(F.collect_list(F.struct("place", "source", "size")))
    langs = sized.groupBy("lang").agg(by_place.alias("sources"), F.sum("size").alias("total"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long")))
    langs = materialize(langs, "langs")

    vectors = kept.join(bounded(langs), "lang").withColumn("counts", _dense(F.col("entries"), F.size("sources")))
    shares = F.transform("counts", lambda c, k: _share(c, F.get("sources", k)["size"], F.col("terms")))
    whole = _share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c), F.col("total"), F.col("terms"))
    vectors = materialize(vectors.select("lang", "term", "counts", shares.alias("shares"), whole.alias("whole")), "vectors")

    each = vectors.select("lang", "shares", F.posexplode("shares").alias("a", "x")).where("a + 1 < size(shares)")
    gaps = F.transform(F.slice("shares", F.col("a") + 2, F.size("shares")), lambda y: F.abs(F.col("x") - y))
    given = each.select("lang", "a", F.posexplode(gaps).alias("b", "value")).withColumn("b", F.col("a") + 1 + F.col("b"))
    places = langs.select("lang", F.size("sources").alias("width"))
    a = places.where("width > 1").select("lang", "width", F.explode(F.sequence(F.lit(0), F.col("width") - 2)).alias("a"))
    none = a.select("lang", "a", F.explode(F.sequence(F.col("a") + 1, F.col("width") - 1)).alias("b"), F.lit(0).cast("long").alias("value"))
    sums = given.unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("p"), "value")
    name = lambda c: F.get("sources", F.col(c))["source"]
    pairs = both.join(bounded(langs), "lang").select("lang", name("p.own").alias("source"), F.lit("pair").alias("part"), name("p.other").alias("item"), "value")

    used = vectors.select("lang", "term", "whole", F.posexplode(F.arrays_zip("counts", "shares")).alias("place", "v")).where("v.counts > 0 and v.shares > whole")
    used = used.select("lang", "place", F.col("term").alias("item"), (F.col("v.shares") - F.col("whole")).alias("value"))
    order = [F.col("value").desc(), F.col("item").asc()]
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    best = used.withColumn("rank", rank("lang", "place")).where(F.col("rank") <= top)
    best = best.join(bounded(groups), ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", rank("lang", "source")).unionByName(best)


ORACLE_SQL = rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as text from documents),
o as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from o group by lang, term having count(distinct id) >= {MIN_DOCS}),
g as (select distinct lang, source from d), v as (select lang, count(*) as v from kept group by lang),
c as (select lang, source, term, count(*) as n from o join kept using (lang, term) group by all),
full_c as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join kept k using (lang) left join c using (lang, source, term)),
sizes as (select lang, source, sum(n) as size from full_c group by all),
p as (select f.lang, f.source, f.term, f.n, cast(1 + (1000000000::hugeint * (f.n + 5)) // (s.size + 5 * v.v) as bigint) as p from full_c f join sizes s using (lang, source) join v using (lang)),
ls as (select lang, sum(size) as size from sizes group by lang),
q as (select x.lang, x.term, cast(1 + (1000000000::hugeint * (x.n + 5)) // (ls.size + 5 * v.v) as bigint) as q from (select lang, term, sum(n) as n from full_c group by all) x join ls using (lang) join v using (lang)),
pair as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, p.p - q.q as value from p join q using (lang, term) where p.n > 0 and p.p > q.q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= {TOP}"""
