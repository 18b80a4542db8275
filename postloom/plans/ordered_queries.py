"""Queries that follow an order over very large groups, state that grows by changes, JSON of any shape, boards and previews; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..backfill import backfill
from ..functions import preferences
from ..operators import applications, boards, discovery, history, pacing, profile, search
from ..scratch import new_path
from ..sources import json_levels, payloads
from ..streaming.state import KeyedTable

_PLACED = """
e as (select event_type as provider, event_id as id, epoch_us(ts) as ready, user_id % 4 as refusals, 1500000 + case when user_id % 4 >= 1 then 3000000 else 0 end + case when user_id % 4 >= 2 then 65000000 else 0 end as holds from events),
b as (select *, coalesce(sum(holds) over (partition by provider order by ready, id rows between unbounded preceding and 1 preceding), 0) as c, row_number() over (partition by provider order by ready, id) - 1 as position from e),
s as (select *, c + max(ready - c) over (partition by provider order by ready, id rows between unbounded preceding and current row) as start from b)"""

_SPANS = """
with s as (select event_type, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + user_id % 50 as b from events),
f as (select *, max(b) over (partition by event_type order by a, b rows between unbounded preceding and 1 preceding) as m from s),
g as (select *, sum(case when m is null or a > m then 1 else 0 end) over (partition by event_type order by a, b rows between unbounded preceding and current row) as k from f)
select event_type, min(a) as first, max(b) as last from g group by event_type, k"""


def _micros() -> F.Column:
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def _calls(t):
    return t.events.select(F.col("event_type").alias("provider"), F.col("event_id").alias("id"), _micros().alias("ready"), (F.col("user_id") % 4).alias("refusals"))


def register(query) -> None:
    """Add each query to the catalogue."""

    @query("paced_calls", f"with {_PLACED} select id, position, cast(start as bigint) as start, cast(start + holds as bigint) as free, refusals <= 2 as answered from s")
    def paced_calls(t):
        return pacing.schedule(_calls(t)).select("id", "position", "start", "free", "answered")

    @query("paced_windows", f"""with {_PLACED},
    x as (select provider, start as send from s union all select provider, start + 3000000 from s where refusals >= 1 union all select provider, start + 68000000 from s where refusals >= 2),
    w as (select provider, count(*) over (partition by provider order by send range between current row and 59999999 following) as n from x)
    select provider, count(*) as sends, max(n) as most, max(n) <= 40 as kept from w group by provider""")
    def paced_windows(t):
        return pacing.busiest(pacing.sends(pacing.schedule(_calls(t)))).withColumn("kept", F.col("most") <= pacing.PER_MINUTE)

    @query("span_union_hot", _SPANS)
    def span_union_hot(t):
        seconds = F.floor(_micros() / 1_000_000).cast("long")
        spans = t.events.select("event_type", seconds.alias("start"), (seconds + F.col("user_id") % 50).alias("end"))
        return history.merge_hot_spans(spans, "event_type").select("event_type", F.col("start").alias("first"), F.col("end").alias("last"))

    @query("keyed_state_latest", "select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey")
    def keyed_state_latest(t):
        table = KeyedTable(t.spark, new_path(t.spark, "state"), "o_custkey", "o_custkey long, o_orderkey long, o_totalprice double", buckets=16, most_logs=2)
        most = t.orders.agg(F.max("o_orderkey")).first()[0] or 0
        for version in range(4):
            low, high = (most + 1) * version // 4, (most + 1) * (version + 1) // 4
            rows = t.orders.where((F.col("o_orderkey") >= low) & (F.col("o_orderkey") < high))
            price = F.max_by("o_totalprice", "o_orderkey").cast("double").alias("o_totalprice")
            table.apply(rows.groupBy(F.col("o_custkey").cast("long").alias("o_custkey")).agg(F.max("o_orderkey").cast("long").alias("o_orderkey"), price), version)
        return table.read()

    @query("json_walk_levels", """
    select p_partkey as k, n, case n when 0 then p_name else p_type end as title, case when n = 0 then p_brand else 'Acme' end as company, case when n = 0 then 'https://x.example/' || p_partkey else 'https://x.example/b' || p_partkey end as url
    from part, (values (0), (1)) v(n) where case when n = 0 then p_size % 10 <= 8 else p_size % 3 = 0 end""")
    def json_walk_levels(t):
        text = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
        url = lambda mark: F.concat(F.lit('"https://x.example/' + mark), F.col("p_partkey").cast("string"), F.lit('"'))
        # the first posting lies below p_size % 10 lists and an object each second one is in; the other one is two levels deep
        inner = F.concat(F.lit('{"name":'), text("p_name"), F.lit(',"company":'), text("p_brand"), F.lit(',"url":'), url(""), F.lit(',"deep":{"title":"hidden","url":"https://x.example/no"}}'))
        deep = F.concat(F.repeat(F.lit("["), F.col("p_size") % 10), inner, F.repeat(F.lit("]"), F.col("p_size") % 10))
        other = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"job":{"title":'), text("p_type"), F.lit(',"startup":{"name":"Acme"},"jobUrl":'), url("b"), F.lit("}}"))).otherwise(F.lit('{"title":"elsewhere","url":"https://y.example/1"}'))
        # a part is a few bytes and its blob long work, so parts are dealt out first: one file would be few tasks
        blobs = t.part.repartition("p_partkey").select(F.col("p_partkey").alias("k"), F.concat(F.lit('{"a":['), deep, F.lit("],"), F.lit('"b":'), other, F.lit("}")).alias("payload"))
        found = json_levels.postings_in(blobs, "x.example", "s", ("k",))
        return found.select("k", F.when(F.col("url").contains("/b"), 1).otherwise(0).alias("n"), "title", "company", "url")

    @query("app_state_pages", """
    select 'https://www.dice.com/job-detail/' || p_partkey as url, p_name as title, p_brand as company from part where p_size % 3 = 0
    union all select 'https://www.dice.com/job-detail/b' || p_partkey, p_type, 'Acme' from part where p_size % 3 = 0
    union all select 'https://www.dice.com/job-detail/' || p_partkey, 'Role ' || p_partkey, '' from part where p_size % 3 <> 0""")
    def app_state_pages(t):
        key = F.col("p_partkey").cast("string")
        nested = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("p_name").alias("jobTitle"), key.alias("guid"), F.col("p_brand").alias("companyName"), F.struct(F.col("p_type").alias("title"), F.concat(F.lit("b"), key).alias("id"), F.struct(F.lit("Acme").alias("name")).alias("company")).alias("more"))).alias("list")).alias("props")))
        links = F.concat(F.lit('<a href="/job-detail/'), key, F.lit('">Role '), key, F.lit("</a>"))
        state = F.when(F.col("p_size") % 3 == 0, nested).otherwise('{"props":{"list":[]}}')
        # a part is a few bytes and its page long work, so parts are dealt out first: one file would be few tasks
        pages = t.part.repartition("p_partkey").select(F.concat(F.lit("https://www.dice.com/p"), key).alias("url"), F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"), links, F.lit("</html>")).alias("payload"))
        return payloads.FAMILIES["dice"](pages).select("url", "title", "company")

    @query("customer_preferences", """
    with c as (select c_custkey, case when c_custkey % 3 = 0 then 's' || c_custkey % 2 || case when c_custkey % 5 = 0 then 'n' else 'y' end else 'l' || c_custkey % 5 end as kind from customer),
    d(kind, places, countries, geos, said) as (values
      ('s0y', 'London, United Kingdom|Europe|Bath|Remote|United Kingdom|Berlin, Germany|Amsterdam, Netherlands', 'gb,de,nl,fr,es,it,pl', 'uk,europe', 'United Kingdom, Europe, Bath, Remote'),
      ('s0n', 'London, United Kingdom|Europe|Bath|United Kingdom|Berlin, Germany|Amsterdam, Netherlands', 'gb,de,nl,fr,es,it,pl', 'uk,europe', 'United Kingdom, Europe, Bath'),
      ('s1y', 'Bath|Remote', 'us', '-', 'Bath, Remote'), ('s1n', 'Bath', 'us', '-', 'Bath'), ('l0', 'Remote|United States', 'us', '-', 'No restriction'),
      ('l1', 'Bengaluru, India|India', 'in', 'india', 'India'), ('l2', 'Bengaluru, India|Oslo|India', 'in', 'india', 'India, Oslo'), ('l3', 'Bengaluru, India|Oslo|India', 'in', 'india', 'India, Oslo'),
      ('l4', 'Bengaluru, India|Oslo|Remote|India', 'in', 'india', 'India, Oslo, Remote'))
    select c_custkey, places, countries, geos, said from c join d using (kind)""")
    def customer_preferences(t):
        k, texts = F.col("c_custkey"), lambda *x: F.array(*map(F.lit, x))
        own = k % 3 == 0
        regions = F.when(own & (k % 2 == 0), texts("uk", "europe", "nowhere", "uk"))
        legacy = F.when(~own, F.slice(texts(" India ", "Oslo ", "Anywhere", "Remote (EU)"), 1, (k % 5).cast("int")))
        p = preferences.normalized(regions, F.when(own, texts(" Bath ", "")), F.when(own & (k % 5 == 0), False), legacy)
        rows = t.customer.select("c_custkey", p.alias("p"))
        said = [preferences.search_places(F.col("p")), preferences.countries(F.col("p")), F.transform(preferences.geos(F.col("p")), lambda g: F.coalesce(g, F.lit("-")))]
        return rows.select("c_custkey", F.array_join(said[0], "|").alias("places"), F.array_join(said[1], ",").alias("countries"), F.array_join(said[2], ",").alias("geos"), preferences.describe(F.col("p")).alias("said"))

    @query("seeds_over_suppliers", """
    with d as (select case s_suppkey % 3 when 0 then 'lever' when 1 then 'workday' else 'other' end as ats, 's' || s_suppkey as slug, s_suppkey as pos from supplier),
    n as (select ats, count(*) as found from d group by ats)
    select 'lever' as ats, 13 + least(287, (select found from n where ats = 'lever')) as n union all select 'workday', 4 + least(26, (select found from n where ats = 'workday'))
    union all select 'other', least(300, (select found from n where ats = 'other')) union all select 'ashby', 19 union all select 'greenhouse', 35""")
    def seeds_over_suppliers(t):
        k = F.col("s_suppkey")
        found = t.supplier.select(F.when(k % 3 == 0, "lever").when(k % 3 == 1, "workday").otherwise("other").alias("ats"), F.concat(F.lit("s"), k.cast("string")).alias("slug"), k.cast("int").alias("pos"))
        return boards.assemble([boards.seeds(t.spark), found]).groupBy("ats").agg(F.count("*").alias("n"))

    @query("deep_result_page", "select l_orderkey * 10 + l_linenumber as id, l_extendedprice as score from lineitem where l_quantity > 5 order by l_extendedprice desc nulls last, l_orderkey * 10 + l_linenumber limit 50 offset 20000")
    def deep_result_page(t):
        none = F.lit(None).cast("timestamp")
        rows = t.lineitem.where("l_quantity > 5").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("llm_score"), F.lit("new").alias("status"), none.alias("posted_at"), none.alias("fetched_at"))
        return search.Pages(rows, search.Query()).page(400).select("id", F.col("llm_score").alias("score"))

    @query("documents_by_type", "select l_orderkey, l_returnflag, l_linenumber from lineitem")
    def documents_by_type(t):
        papers = t.lineitem.select(F.col("l_orderkey").alias("application_id"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("version"))
        return applications.documents_by_type(papers).select(F.col("application_id").alias("l_orderkey"), F.col("type").alias("l_returnflag"), F.col("version").alias("l_linenumber"))

    @query("role_previews", """
    select p_partkey as id, 0 as pos, p_name || ' @ ' || p_brand as label, 'Jan 2020 – 2021-01' as dates, 1.0::double as years from part
    union all select p_partkey, 1, '? @ ' || p_type, case when p_size % 2 = 0 then '03/2022' else '' end, case when p_size % 2 = 0 then round(date_diff('day', date '2022-03-01', date '2024-02-01') / 365.25, 1) end from part""")
    def role_previews(t):
        texts = "role string, title string, company string, start_date string, end_date string, years double"
        none = F.lit(None).cast("string")
        first = F.struct(none.alias("role"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.lit("Jan 2020").alias("start_date"), F.lit("2021-01").alias("end_date"), F.lit(None).cast("double").alias("years"))
        second = F.struct(none.alias("role"), F.lit("").alias("title"), F.col("p_type").alias("company"), F.when(F.col("p_size") % 2 == 0, "03/2022").alias("start_date"), none.alias("end_date"), F.lit(None).cast("double").alias("years"))
        held = t.part.select(F.col("p_partkey").alias("id"), F.array(first, second).cast(f"array<struct<{texts.replace(' ', ':').replace(',:', ',')}>>").alias("experience"))
        return profile.role_previews(held, F.lit("2024-02-01").cast("date"))

    @query("community_lists", "select distinct case p_partkey % 3 when 0 then 'lever' when 1 then 'greenhouse' else 'ashby' end as ats, 'b' || p_size as slug from part union select 'lever', 'known'")
    def community_lists(t):
        k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
        base = F.when(k == 0, "https://jobs.lever.co/B").when(k == 1, "https://boards.greenhouse.io/B").otherwise("https://jobs.ashbyhq.com/B")
        lists = t.part.select(F.concat(F.lit("| Acme | [apply]("), base, n, F.lit("/1) |\n| old | https://jobs.lever.co/ |")).alias("value"))
        known = t.spark.createDataFrame([("lever", "known", 0)], "ats string, slug string, pos int")
        return discovery.harvest(lists, known).select("ats", "slug")

    @query("offline_backfill", "select (select count(*) from part) as jobs_scanned, (select count(*) from part where p_partkey % 5 = 0) as jobs_given_apply_url, (select count(distinct p_size) from part where p_partkey % 2 = 0) as boards_found")
    def offline_backfill(t):
        k = F.col("p_partkey")
        link = F.concat(F.lit("https://jobs.lever.co/b"), F.col("p_size").cast("string"), F.lit("/1"))
        postings = t.part.select(F.lit("adzuna").alias("source"), F.when(k % 5 == 0, "https://www.adzuna.com/details/1").otherwise("https://acme.example/x").alias("url"), F.when(k % 5 == 0, "https://acme.example/y").alias("apply_url"), F.when(k % 2 == 0, link).otherwise("no link").alias("description"))
        known = t.spark.createDataFrame([], "ats string, slug string, pos int")
        return backfill(postings, known)[1].select("jobs_scanned", "jobs_given_apply_url", "boards_found")

    @query("all_adapters", "select 'jooble' as source, p_name as title, 'https://x.example/a' || p_partkey as url from part union all select 'greenhouse', p_type, 'https://x.example/b' || p_partkey from part")
    def all_adapters(t):
        key = F.col("p_partkey").cast("string")
        blank = F.lit("")
        one = t.part.select(F.to_json(F.struct(F.array(F.struct(key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), blank.alias("location"), F.concat(F.lit("https://x.example/a"), key).alias("link"), blank.alias("snippet"))).alias("jobs"))).alias("payload"))
        two = t.part.select(F.to_json(F.struct(F.array(F.struct(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), F.concat(F.lit("https://x.example/b"), key).alias("absolute_url"), blank.alias("content"), F.struct(blank.alias("name")).alias("location"))).alias("jobs"))).alias("payload"), F.lit("s").alias("slug"))
        return payloads.union_all([payloads.FAMILIES["jooble"](one), payloads.FAMILIES["greenhouse"](two)]).select("source", "title", "url")

    @query("scorer_prompts", "select doc_id, 'Posting: ' || coalesce(source, '') || chr(10) || 'Company: ' || coalesce(lang, '') || chr(10) || 'Place: ' || chr(10) || 'Wanted roles: dev, cook' || chr(10) || 'Skills: sql' || chr(10) || 'Description:' || chr(10) || left(coalesce(text, ''), 4000) as prompt from documents")
    def scorer_prompts(t):
        texts = lambda *x: F.array(*map(F.lit, x))
        return t.documents.select("doc_id", profile.prompt(F.col("source"), F.col("lang"), F.lit(""), F.col("text"), texts("dev", "cook"), texts("sql")).alias("prompt"))
