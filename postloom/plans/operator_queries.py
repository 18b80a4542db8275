"""More operators of postings over the provided tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, extract, regions, text
from ..operators import applications, assemble, boards, cascade, compare, discovery, history, links, profile, resolve, search
from ..sources import payloads


def _day() -> F.Column:
    return F.lit("2024-02-01").cast("date")


def _now() -> F.Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


_PREFERENCES = ((("uk", "europe"), ("Bath",), True), ((), (), True), (("india",), (), False))


def register(query) -> None:  # noqa: PLR0915
    """Add each query to the catalogue."""

    @query("posting_dates", """
    with r as (select p_partkey as k, case p_partkey % 4 when 0 then cast(1704067200 + p_partkey as varchar) when 1 then strftime(date '2024-01-01' + cast(p_partkey % 50 as int), '%Y-%m-%d') when 2 then 'Tue, 02 Jan 2024 03:04:05 +0000' else 'soon' end as raw from part)
    select k, case k % 4 when 0 then cast(1704067200 + k as bigint) when 1 then cast(epoch(cast(raw as timestamp)) as bigint) end as at from r""")
    def posting_dates(t):
        k = F.col("p_partkey")
        raw = F.when(k % 4 == 0, (k + 1704067200).cast("string")).when(k % 4 == 1, F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).cast("string")).when(k % 4 == 2, "Tue, 02 Jan 2024 03:04:05 +0000").otherwise("soon")
        return t.part.select(k.alias("k"), F.unix_timestamp(dates.posted_at(raw)).alias("at"))

    @query("relative_dates", """
    select p_partkey as k, strftime(case p_partkey % 4 when 0 then date '2024-02-01' when 1 then date '2024-01-31' when 2 then date '2024-02-01' - cast(p_size as int) when 3 then date '2024-02-01' - cast(p_size + 1 as int) end, '%Y-%m-%d') as day from part""")
    def relative_dates(t):
        k, n = F.col("p_partkey"), F.col("p_size").cast("string")
        said = F.when(k % 4 == 0, "Posted Today").when(k % 4 == 1, "posted yesterday").when(k % 4 == 2, F.concat(F.lit("Posted "), n, F.lit(" Days Ago"))).otherwise(F.concat(n, F.lit("+ days ago")))
        return t.part.select(k.alias("k"), F.date_format(dates.relative_date(said, _day()), "yyyy-MM-dd").alias("day"))

    @query("free_text_months", """
    with r as (select p_partkey as k, 2000 + cast(p_partkey % 20 as int) as y, 1 + cast(p_partkey % 12 as int) as m from part)
    select k, case k % 5 when 4 then '2020-07-01' else strftime(make_date(y, m, 1), '%Y-%m-%d') end as month,
      round(greatest(0, date_diff('day', case k % 5 when 4 then date '2020-07-01' else make_date(y, m, 1) end, date '2024-02-01')) / 365.25, 1) as years from r""")
    def free_text_months(t):
        k = F.col("p_partkey")
        y, m = (k % 20 + 2000).cast("string"), (k % 12 + 1).cast("int")
        name = F.element_at(F.array(*map(F.lit, ("January", "feb", "Mar.", "April,", "may", "June", "jul", "aug", "Sept", "October", "nov", "December"))), m)
        said = F.when(k % 5 == 0, F.concat(name, F.lit(" "), y)).when(k % 5 == 1, F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"))).when(k % 5 == 2, F.concat(m.cast("string"), F.lit("/"), y)).when(k % 5 == 3, F.concat(F.upper(name), F.lit("  "), y)).otherwise("2020")
        start = dates.month(said, _day())
        return t.part.select(k.alias("k"), F.date_format(start, "yyyy-MM-dd").alias("month"), dates.entry_years(F.lit(None).cast("double"), start, dates.month(F.lit("Present"), _day(), True)).alias("years"))

    @query("query_words", "select p_partkey as k from part where contains(lower(p_name), 'bolt') or contains(lower(p_name), 'cold') or contains(lower(p_type), 'bolt') or contains(lower(p_type), 'cold')")
    def query_words(t):
        return t.part.where(payloads.matches_query(F.col("p_name"), F.array("p_type"), " Bolt COLD ")).select(F.col("p_partkey").alias("k"))

    rows = lambda t: t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("location"), (F.col("p_size") % 2 == 0).alias("is_remote"), F.when(F.col("p_partkey") % 11 == 0, "archived").when(F.col("p_partkey") % 3 == 0, "filtered_out").otherwise("new").alias("status"), F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit("r"), F.col("p_size") % 4)).alias("filter_reason"), F.col("p_brand").alias("source"), F.when(F.col("p_size") > 25, "senior").otherwise("mid").alias("experience_level"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("llm_score"), F.lit(None).cast("timestamp").alias("posted_at"), F.lit(None).cast("timestamp").alias("fetched_at"))

    @query("search_filters", "select p_partkey as id from part where p_partkey % 11 <> 0 and p_brand = 'Brand#13' and p_size > 25 and p_size % 2 = 0 and p_size >= 30")
    def search_filters(t):
        return search.matching(rows(t), search.Query(source="Brand#13", level="senior", remote=True, min_score=" 30 ")).select("id")

    @query("search_total", "select count(*) as n from part where p_partkey % 11 <> 0 and p_name ilike '%bolt%'")
    def search_total(t):
        return t.spark.createDataFrame([(search.total(rows(t), search.Query(text="BOLT")),)], "n long")

    @query("reason_histogram", "select 'r' || (p_size % 4) as filter_reason, count(*) as n from part where p_partkey % 11 <> 0 and p_partkey % 3 = 0 and p_partkey % 7 > 0 group by 1")
    def reason_histogram(t):
        return cascade.reason_histogram(rows(t))

    @query("merge_found_boards", """
    with a as (select case when s_suppkey % 2 = 0 then 'workday' else 'lever' end as ats, 's' || s_suppkey as slug, row_number() over (partition by s_suppkey % 2 order by s_suppkey) as n from supplier where s_suppkey % 5 = 0),
    b as (select ats, slug, n from a union all select ats, slug, 1000000 + row_number() over (partition by ats order by slug) from (select case when s_suppkey % 2 = 0 then 'workday' else 'lever' end as ats, 's' || s_suppkey as slug from supplier where s_suppkey % 5 <> 0)),
    r as (select ats, slug, row_number() over (partition by ats order by n) as rank from b) select ats, slug, cast(rank as int) as rank from r where rank <= case ats when 'workday' then 15 else 100 end""")
    def merge_found_boards(t):
        k = F.col("s_suppkey")
        all_ = t.supplier.select(F.when(k % 2 == 0, "workday").otherwise("lever").alias("ats"), F.concat(F.lit("s"), k.cast("string")).alias("slug"), k.alias("pos"))
        return discovery.merge_found(all_.where("pos % 5 = 0"), all_.where("pos % 5 <> 0").select("ats", "slug"))

    @query("hash_group_remerge", """
    with d as (select doc_id as id, md5(text) as h, row_number() over (partition by md5(text) order by doc_id) as n, count(*) over (partition by md5(text)) as copies from documents)
    select id, case when n = 1 then h else h || '-' || id end as dedupe_hash, case when n = 1 then copies else 1 end as n_urls from d where n = 1 or id % 2 = 0""")
    def hash_group_remerge(t):
        d = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("dedupe_hash"), F.array(F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("source_urls"), F.col("doc_id").alias("fetched_at"))
        used = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("job_id"))
        return resolve.remerge(d, used).select("id", "dedupe_hash", F.size("source_urls").cast("bigint").alias("n_urls"))

    @query("first_wins_by_brand", "select min(p_partkey) as k, p_brand from part group by p_brand")
    def first_wins_by_brand(t):
        return resolve.first_by(t.part, ["p_brand"], "p_partkey").select(F.col("p_partkey").alias("k"), "p_brand")

    @query("tailored_bullets_join", """
    with l as (select l_orderkey, l_partkey, last(l_quantity order by l_linenumber) as q from lineitem where l_linenumber > 1 group by 1, 2)
    select o_orderkey, coalesce(cast(q as bigint), -1) as bullets from orders left join l on l_orderkey = o_orderkey and l_partkey = o_custkey""")
    def tailored_bullets_join(t):
        held = t.orders.select("o_orderkey", F.col("o_orderkey").alias("company"), F.col("o_custkey").alias("title"), F.array(F.lit(-1).cast("bigint")).alias("bullets"))
        told = t.lineitem.where("l_linenumber > 1").select(F.col("l_orderkey").alias("company"), F.col("l_partkey").alias("title"), F.array(F.col("l_quantity").cast("bigint")).alias("bullets"), F.col("l_linenumber").alias("seq"))
        return applications.join_bullets(held, told).select("o_orderkey", F.col("bullets")[0].alias("bullets"))

    @query("grounded_bullets", "select p_partkey as k, case when p_size % 2 = 0 then 'made ' || p_size || ' of them' else 'sold ' || p_size end as said, cast(1 as bigint) as n from part")
    def grounded_bullets(t):
        size = F.col("p_size").cast("string")
        own = F.array(F.concat(F.lit("sold "), size))
        tailored = F.array(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("made "), size, F.lit(" of them"))).otherwise(F.concat(F.lit("made 1,000 of "), size)), F.lit("new 77777"))
        kept = assemble.ground(tailored, own)
        return t.part.select(F.col("p_partkey").alias("k"), kept[0].alias("said"), F.size(kept).cast("bigint").alias("n"))

    @query("trimmed_bullets", "select p_partkey as k, cast(greatest(1, 5 - p_size % 6) as bigint) as n from part where p_size % 6 = 2")
    def trimmed_bullets(t):
        five = F.array(*(F.lit(f"b{k}") for k in range(5)))
        return t.part.where("p_size % 6 = 2").select(F.col("p_partkey").alias("k"), F.size(assemble.trim_level(five, 2)).cast("bigint").alias("n"))

    @query("total_years_by_customer", """
    with s as (select o_custkey as c, cast(o_orderdate as date) as a, cast(o_orderdate as date) + 90 as b from orders),
    m as (select *, max(b) over (partition by c order by a, b rows between unbounded preceding and 1 preceding) as before from s),
    g as (select *, sum(case when before >= a then 0 else 1 end) over (partition by c order by a, b) as span from m),
    u as (select c, span, max(b) - min(a) as days from g group by 1, 2) select c, round(sum(days) / 365.25, 1) as years from u group by c""")
    def total_years_by_customer(t):
        spans = t.orders.select(F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 90).alias("end"))
        return history.total_years(spans, "c")

    registry = lambda t: t.supplier.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("ats"), F.col("s_name").alias("slug"), (F.col("s_suppkey") % 3 > 0).alias("active"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey")).alias("last_fetched_at"), (F.col("s_suppkey") % 17).alias("total_job_count"))

    @query("retired_boards", "select 'n' || s_nationkey as ats, s_name as slug from supplier where s_suppkey % 3 = 0 order by case when s_suppkey % 4 > 0 then s_suppkey end desc nulls last, ats, slug limit 20")
    def retired_boards(t):
        return boards.retired(registry(t), 20).select("ats", "slug")

    @query("board_leaderboard", "select 'n' || s_nationkey as ats, s_name as slug, s_suppkey % 17 as total_job_count from supplier where s_suppkey % 17 > 0 order by 3 desc, 1, 2 limit 25")
    def board_leaderboard(t):
        return boards.leaderboard(registry(t)).select("ats", "slug", "total_job_count")

    @query("board_yields", "select 'n' || s_nationkey as ats, s_name as slug, count(*) as jobs from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2")
    def board_yields(t):
        got = t.lineitem.join(registry(t).select("ats", "slug").join(t.supplier.select("s_name", "s_suppkey"), F.col("slug") == F.col("s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
        return discovery.yields(got)

    @query("backfill_report", """
    with p as (select page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as host from pages)
    select count(*) as jobs_scanned, count(distinct host) as hosts_seen, count(*) filter (page_id % 2 = 0) as links_attempted, count(*) filter (page_id % 4 = 0) as links_resolved, count(*) filter (page_id % 8 = 0) as jobs_given_apply_url,
      (select count(*) from supplier) as boards_found, (select count(*) from supplier where s_suppkey % 2 = 0) as boards_sniffed, (select count(*) from supplier where s_nationkey = 3) as of_n3 from p""")
    def backfill_report(t):
        k = F.col("page_id")
        scanned = t.pages.select(extract.host(F.col("url")).alias("host"), (k % 2 == 0).alias("attempted"), (k % 4 == 0).alias("resolved"), (k % 8 == 0).alias("given"))
        found = registry(t).join(t.supplier, F.col("slug") == F.col("s_name")).select("ats", "slug", (F.col("s_suppkey") % 2 == 0).alias("sniffed"))
        out = discovery.backfill_report(scanned, found)
        return out.withColumn("of_n3", F.coalesce(F.try_element_at("per_ats", F.lit("n3")), F.lit(0))).drop("per_ats")

    @query("stored_page_boards", "select distinct 'h' || (p_partkey % 5) || '.example.com' as host, 'lever' as ats, 'b' || p_size as slug from part")
    def stored_page_boards(t):
        k = F.col("p_partkey")
        pages = t.part.select(F.concat(F.lit("https://h"), (k % 5).cast("string"), F.lit(".example.com/x")).alias("url"), F.concat(F.lit('<a href="https://jobs.lever.co/B'), F.col("p_size").cast("string"), F.lit('/1">x</a> https://jobs.lever.co/api')).alias("html"))
        return links.sniff_stored(pages)

    @query("redirect_targets", """
    select page_id, case page_id % 4 when 0 then 'https://a.example/y' || page_id when 1 then 'https://b.example/' || page_id when 2 then 'https://a.example/go/' || page_id end as target from pages""")
    def redirect_targets(t):
        k, n = F.col("page_id"), F.col("page_id").cast("string")
        page = F.when(k % 4 == 0, F.concat(F.lit('<meta content="0; URL=/y'), n, F.lit('" http-equiv=refresh>'))).when(k % 4 == 1, F.concat(F.lit("<script>window.location.href = 'https://b.example/"), n, F.lit("'</script>"))).when(k % 4 == 2, F.concat(F.lit('<a href="/go/'), n, F.lit('" class="btn apply-now">Go</a>'))).otherwise('<meta http-equiv="refresh" content="0;url=/x">')
        return t.pages.select("page_id", extract.redirect_target(page, F.lit("https://a.example/x")).alias("target"))

    @query("interstitial_urls", "select p_partkey as k, p_partkey % 3 = 0 as interstitial, p_partkey % 3 < 2 as aggregator from part")
    def interstitial_urls(t):
        url = F.when(F.col("p_partkey") % 3 == 0, "https://www.adzuna.com/details/1").when(F.col("p_partkey") % 3 == 1, "https://www.indeed.com/viewjob").otherwise("https://acme.example/jobs")
        return t.part.select(F.col("p_partkey").alias("k"), extract.is_interstitial(url).alias("interstitial"), extract.is_aggregator(url).alias("aggregator"))

    @query("resolved_links_fan_back", "select page_id, case when page_id % 3 = 0 then 'kept' when page_id % 5 < 3 then 'https://to.example/' || page_id % 5 end as apply_url from pages")
    def resolved_links_fan_back(t):
        k = F.col("page_id")
        rows = t.pages.select("page_id", F.concat(F.lit("https://jooble.org/away/"), (k % 5).cast("string")).alias("url"), F.when(k % 3 == 0, "kept").alias("apply_url"), k.alias("seq"))
        chosen = links.to_resolve(rows, t.pages.limit(0).select("url"), 3).where("chosen")
        resolved = chosen.select("url", F.concat(F.lit("https://to.example/"), F.substring_index("url", "/", -1)).alias("target"))
        ordered = resolved.where(F.substring_index("url", "/", -1).cast("int") < 3)
        return links.apply_resolved(rows, ordered).select("page_id", "apply_url")

    @query("hosts_to_sniff", """
    with h as (select lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as host, min(page_id) as seq from pages group by 1),
    o as (select *, row_number() over (order by host) as n from h), k as (select host, seq from o where not (n % 4 = 0 or n % 4 = 1)), r as (select *, row_number() over (order by seq) as n from k) select host, seq, n <= 12 as chosen from r""")
    def hosts_to_sniff(t):
        from pyspark.sql import Window as W

        rows = t.pages.select("url", F.lit("Acme").alias("company"), F.col("page_id").alias("seq"))
        hosts = rows.select(extract.company_host(F.col("url")).alias("host")).distinct()
        n = F.row_number().over(W.orderBy("host"))  # a dimension: one row a host
        cache = hosts.select("host", (n % 4 == 0).alias("found"), F.when(n % 4 == 1, F.lit("2024-01-20")).otherwise("2023-01-01").cast("timestamp_ntz").alias("at"))
        return links.hosts_to_sniff(rows, cache, _now(), 12).select("host", "seq", "chosen")

    @query("stalled_records", "select event_id, event_type in ('click', 'view') and not (date_diff('second', ts, timestamp '2024-02-01 00:00:00') > 1296000) as active, event_type in ('click', 'view') and date_diff('second', ts, timestamp '2024-02-01 00:00:00') > 1296000 as stalled from events")
    def stalled_records(t):
        status = F.when(F.col("event_type").isin("click", "view"), "running").otherwise("done")
        return t.events.select("event_id", compare.progress(status, F.col("ts"), _now(), 1296000).alias("p")).select("event_id", "p.active", "p.stalled")

    @query("run_totals", "select count(*) as fetched, count(*) filter (n_chars > 1000) as inserted, count(*) filter (n_chars <= 1000) as merged, cast(0 as bigint) as skipped, 'partial' as status, (select count(*) from supplier where s_suppkey % 3 > 0) as boards_polled from documents")
    def run_totals(t):
        outcomes = t.documents.select(F.when(F.col("n_chars") > 1000, "inserted").otherwise("merged").alias("outcome"))
        stats = t.spark.createDataFrame([("x", 0, 1, True), ("y", 5, 0, True)], "source string, count int, n_errors int, enabled boolean")
        return history.run_facts(outcomes, stats, registry(t)).select("fetched", "inserted", "merged", "skipped", "status", "boards_polled")

    @query("skipped_sources", "with d as (select source, count(*) as c from documents where source < 'src2' group by 1), s as (select distinct source from documents) select s.source, s.source in ('src1', 'src10') as enabled, coalesce(c, 0) as count, 0 as n_errors from s left join d on d.source = s.source")
    def skipped_sources(t):
        stats = t.documents.where("source < 'src2'").groupBy("source").agg(F.count("*").alias("count")).withColumns({"n_errors": F.lit(0), "enabled": F.lit(True)})
        return history.with_skipped(stats, t.documents.select("source").distinct(), ["src1", "src10"]).select("source", "enabled", "count", "n_errors")

    @query("small_text_shapes", r"""
    select p_partkey as k, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug, p_name || ',' || p_type as skills, p_name || '|' || p_brand as listed, '{' || p_size || '}' as fenced,
      case when p_size < 20 then (p_size * 3)::varchar || 's' else (p_size * 3 // 60)::varchar || 'm' end as age from part""")
    def small_text_shapes(t):
        size = F.col("p_size")
        skills = F.create_map(F.lit("a"), F.array("p_name"), F.lit("b"), F.array("p_type"))
        listed = F.concat(F.lit("1. "), "p_name", F.lit("\n\n 2.  "), "p_brand")
        fenced = F.concat(F.lit(" ```json\n{"), size.cast("string"), F.lit("}\n``` "))
        return t.part.select(F.col("p_partkey").alias("k"), text.role_slug("p_name").alias("slug"), F.array_join(text.flatten_skills(skills), ",").alias("skills"), F.array_join(text.numbered_list(listed), "|").alias("listed"), text.strip_fence(fenced).alias("fenced"), text.age(size * 3).alias("age"))

    @query("region_clause", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
    def region_clause(t):
        place = F.when(F.col("c_mktsegment") == "BUILDING", "Leeds, England").when(F.col("c_mktsegment") == "MACHINERY", "Somewhere, UK").otherwise("Paris duke")
        return t.customer.where(regions.in_region(place, "uk")).select("c_custkey")

    @query("region_preferences", """select * from (values (0, 'London, United Kingdom|Europe|Bath|Remote|United Kingdom|Berlin, Germany|Amsterdam, Netherlands', 'gb,de,nl,fr,es,it,pl', 'uk,europe', 'United Kingdom, Europe, Bath, Remote'),
      (1, 'Remote|United States', 'us', '-', 'No restriction'), (2, 'Bengaluru, India|India', 'in', 'india', 'India')) v(i, places, countries, geos, said)""")
    def region_preferences(t):
        found = [regions.preferences({"regions": list(r), "custom": list(c), "remote_ok": far}) for r, c, far in _PREFERENCES]
        rows = [(i, "|".join(regions.search_places(p)), ",".join(regions.countries(p)), ",".join(g or "-" for g in regions.geos(p)), regions.describe(p)) for i, p in enumerate(found)]
        return t.spark.createDataFrame(rows, "i int, places string, countries string, geos string, said string")

    @query("ordered_skill_list", "select p_partkey as k, case when p_size % 2 = 0 then 'Python,' else '' end || 'SQL,' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) as skills from part where not contains(p_type, ' ')")
    def ordered_skill_list(t):
        own = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_type"), F.lit("sql"), F.lit("PYTHON"))).otherwise(F.array(F.col("p_type"), F.lit("Sql")))
        return t.part.where("not contains(p_type, ' ')").select(F.col("p_partkey").alias("k"), F.array_join(assemble.ordered_skills(own, F.array(F.lit("Python"), F.lit("SQL"))), ",").alias("skills"))

    @query("profile_gap_keys", "select p_partkey as k, case when p_size % 2 = 0 then '' else 'skills,' end || 'experience_dates' || case when p_size % 3 = 0 then '' else ',summary' end as gaps from part")
    def profile_gap_keys(t):
        skills = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("a"), F.array("p_name")))
        gaps = applications.profile_gaps(skills, F.array(F.lit("dev")), F.array("p_type"), F.lit(0.0), F.when(F.col("p_size") % 3 == 0, F.col("p_name")), F.col("p_brand"))
        return t.part.select(F.col("p_partkey").alias("k"), F.array_join(gaps, ",").alias("gaps"))

    @query("accepted_summaries", "select doc_id, case when length(trim(left(text, n))) between 40 and 800 then trim(left(text, n)) else 'base' end as summary from (select doc_id, replace(replace(text, '\"', ''), chr(10), ' ') as text, cast(doc_id % 60 as int) as n from documents)")
    def accepted_summaries(t):
        said = F.trim(F.left(F.replace(F.replace("text", F.lit('"'), F.lit("")), F.lit("\n"), F.lit(" ")), (F.col("doc_id") % 60).cast("int")))
        return t.documents.select("doc_id", profile.accepted_summary(F.concat(F.lit(' "'), said, F.lit('" ')), F.lit("base")).alias("summary"))

    @query("restored_skills", "select p_partkey as k, p_name || case when p_size % 2 = 0 then ',' || p_type else '' end as skills from part where p_name <> p_type")
    def restored_skills(t):
        own, chosen = F.create_map(F.lit("a"), F.array("p_name", "p_type")), F.create_map(F.lit("a"), F.array("p_name"))
        asked = F.when(F.col("p_size") % 2 == 0, F.array(F.lower("p_type"), F.lit("other")))
        return t.part.where("p_name <> p_type").select(F.col("p_partkey").alias("k"), F.array_join(profile.restore_skills(own, chosen, asked)["a"], ",").alias("skills"))

    @query("expanded_queries", "select p_partkey as k, case p_partkey % 3 when 0 then 'cached' when 1 then p_name || ',' || p_type || ' dev' else p_name end as queries, p_partkey % 3 = 1 as fresh from part")
    def expanded_queries(t):
        k = F.col("p_partkey")
        roles, skills = F.array("p_name"), F.array("p_type", "p_brand")
        rows = t.part.select(k.alias("id"), roles.alias("roles"), skills.alias("skills"), F.when(k % 3 == 0, profile.basis_hash(roles, F.array("p_brand", "p_type"))).otherwise("old").alias("cached_basis"), F.array(F.lit("cached")).alias("cached_queries"), F.when(k % 3 == 1, F.concat(F.lit('```json\n["'), F.upper("p_name"), F.lit('", "'), "p_type", F.lit(' dev"]\n```'))).otherwise("sorry").alias("reply"))
        return profile.expand_queries(rows).select(F.col("id").alias("k"), F.array_join("queries", ",").alias("queries"), "fresh")

    @query("challenge_pages", "select page_id, page_id % 2 = 0 as challenge from pages")
    def challenge_pages(t):
        return t.pages.select("page_id", links.is_challenge(F.when(F.col("page_id") % 2 == 0, "Just a Moment").otherwise("Jobs"), F.lit("<p>hello</p>")).alias("challenge"))

    @query("fanned_searches", "select r.r_name as role, n.n_name as place from region r cross join nation n")
    def fanned_searches(t):
        return payloads.fan_out(t.region.select(F.col("r_name").alias("role")), t.nation.select(F.col("n_name").alias("place")))

    @query("application_lists", "select o_orderkey as id from orders order by case when o_orderkey % 50 > 0 then o_orderdate end desc nulls first, o_orderkey limit 30")
    def application_lists(t):
        made = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderdate")).alias("created_at"))
        return applications.listed(made).limit(30).select("id")

    @query("latest_or_given", "(select 'given' as asked, 3 as page_id) union all select 'none', (select max(page_id) from pages where page_id % 2 = 0)")
    def latest_or_given(t):
        stored = t.pages.select(F.col("page_id").alias("id"), F.when((F.col("page_id") % 2 == 0) | (F.col("page_id") == 3), "x").otherwise("").alias("description"), F.col("page_id").alias("fetched_at"))
        got = search.latest_or_given(stored, 3).select(F.lit("given").alias("asked"), F.col("id").alias("page_id"))
        return got.unionByName(search.latest_or_given(stored.where("id <> 3"), -1).select(F.lit("none").alias("asked"), F.col("id").alias("page_id")))

    @query("seed_layer", "select 'workday' as ats, 4 as n union all select 'lever', 13 union all select 'ashby', 19 union all select 'greenhouse', 35")
    def seed_layer(t):
        return boards.seeds(t.spark).groupBy("ats").agg(F.count("*").cast("int").alias("n"))

    @query("latex_escaped", r"select p_partkey as k, 'R\&D \#' || p_size || ' at 5\% \textasciitilde{} caf' || 'e -- ' || p_name as said from part")
    def latex_escaped(t):
        said = F.concat(F.lit("R&D #"), F.col("p_size").cast("string"), F.lit(" at 5% ~ café – "), "p_name")
        return t.part.select(F.col("p_partkey").alias("k"), text.latex_escape(said).alias("said"))

    @query("backfill_attempts", "select s_suppkey as k, s_suppkey % 5 < 3 and s_suppkey % 7 > 0 as due from supplier")
    def backfill_attempts(t):
        k = F.col("s_suppkey")
        return t.supplier.select(k.alias("k"), discovery.backfill_due(F.when(k % 7 > 0, False).otherwise(True), k % 5).alias("due"))

    @query("empty_source_reasons", "with f as (select event_type as source, 'code ' || cast(json_extract(props, '$.k') as varchar) as message, min(event_id) as seq from events group by 1, 2), r as (select *, row_number() over (partition by source order by seq) as n from f) select source, string_agg(message, ',' order by seq) as reasons from r where n <= 5 and source <> 'purchase' group by source")
    def empty_source_reasons(t):
        stats = t.events.select(F.col("event_type").alias("source")).distinct().withColumns({"count": F.when(F.col("source") == "purchase", 3).otherwise(0), "enabled": F.lit(True)})
        errors = t.events.select(F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.concat(F.lit("code "), F.get_json_object("props", "$.k")).alias("message"))
        return history.empty_reasons(stats, errors).select("source", F.array_join("reasons", ",").alias("reasons"))

    @query("grounded_selection", "select p_partkey as k, case when p_size % 2 = 0 then p_name || ',' || p_brand when p_size % 3 = 0 then p_brand end as ids from part")
    def grounded_selection(t):
        chosen = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("made up"), "p_name")).when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_brand"))
        return t.part.select(F.col("p_partkey").alias("k"), F.array_join(assemble.grounded_selection(chosen, F.array("p_name", "p_brand", "p_type")), ",").alias("ids"))

    @query("profile_patch", """select p_partkey as k, '{"a":1}' as a, '"' || p_name || '"' as b from part""")
    def profile_patch(t):
        before = F.create_map(F.lit("a"), F.lit('{"a":1}'), F.lit("b"), F.lit("old"))
        after = profile.patch_section(before, "b", F.to_json(F.array("p_name")))
        return t.part.select(F.col("p_partkey").alias("k"), after["a"].alias("a"), F.btrim(after["b"], F.lit("[]")).alias("b"))
