"""One query for each payload family: the parts table is written as the family's payloads, which are projected back.

Both engines read the same base rows; the SQL says what each posting must come out as, from those rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import payloads

#: Base rows, in SQL that both engines read: some titles are senior, some companies and places missing, some places remote.
BASE = """
select p_partkey as k, case when p_partkey % 3 = 0 then concat('Senior ', p_name) else p_name end as title,
  case when p_partkey % 7 = 0 then null else p_brand end as company, case when p_partkey % 5 = 0 then concat('Remote ', p_type) when p_partkey % 11 = 0 then null else p_type end as place,
  concat('https://x.example/j/', cast(p_partkey as string)) as url, concat('<p>about <b>', p_name, '</b></p>') as html, concat('2024-01-0', cast(p_partkey % 9 + 1 as string)) as day,
  concat('board', cast(p_partkey % 4 as string)) as slug, p_partkey % 2 = 0 as far, p_size as size from part
"""

_PLAIN = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
_REMOTE = "contains(lower(concat(coalesce({place}, ''), ' ', {title})), 'remote')"
_LEVEL = "case when k % 3 = 0 then 'senior' else 'mid' end"


def expected(source: str, **said: str) -> str:
    """DuckDB SQL for the postings of a source; what is not said is as in most families."""
    said = {"id": "cast(k as string)", "title": "title", "company": "coalesce(company, '')", "location": "coalesce(place, '')", "url": "url", "description": _PLAIN, "posted": "day", "level": _LEVEL, "where": "true"} | said
    remote = said.get("remote") or _REMOTE.format(place=said["location"], title=said["title"])
    return f"""with b as ({BASE}) select '{source}' as source, {said['id']} as source_job_id, {said['title']} as title, {said['company']} as company, {said['location']} as location, {remote} as is_remote,
      {said['url']} as url, {said['description']} as description, {said['level']} as experience_level, {said['posted']} as posted_at_raw from b where {said['where']}"""


def _pages(t, item: str, path: str | None, extra: str = "", *keys: str) -> DataFrame:
    """Payloads of up to 50 rows: the items listed under a path in the order of k, with the keys as columns."""
    t.part.createOrReplaceTempView("part")
    base = t.spark.sql(BASE).withColumn("page", F.expr("k div 50"))
    listed = base.groupBy(*keys, "page").agg(F.expr(f"transform(array_sort(collect_list(struct(k, {item} as said))), x -> x.said)").alias("items"))
    body = "to_json(items)" if path is None else f"to_json(named_struct({extra}'{path}', items))"
    return listed.select(*keys, F.expr(body).alias("payload"))


def _markup(t, item: str, before: str, after: str, *keys: str) -> DataFrame:
    """Pages whose items are markup."""
    t.part.createOrReplaceTempView("part")
    base = t.spark.sql(BASE).withColumn("page", F.expr("k div 50"))
    listed = base.groupBy(*keys, "page").agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(k, {item} as said))), x -> x.said), '')").alias("body"))
    return listed.select(*keys, F.col("page").alias("seq"), F.concat(F.lit(before), "body", F.lit(after)).alias("payload"))


_BOARD = "slug"
#: By family: (payloads, SQL of what they come out as, the projection's further arguments; a pair of a text and a type is a literal).
FAMILIES: dict[str, tuple] = {
    "adzuna": (lambda t: _pages(t, "struct(k as id, title, struct(company as display_name) as company, struct(place as display_name) as location, url as redirect_url, html as description, day as created)", "results"), expected("adzuna", description="html"), {}),
    "jsearch": (
        lambda t: _pages(t, "struct(k as job_id, title as job_title, company as employer_name, place as job_city, 'XY' as job_state, 'us' as job_country, far as job_is_remote, url as job_apply_link, html as job_description, day as job_posted_at_datetime_utc)", "data"),
        expected("jsearch", description="html", location="case when place is null then 'XY' else concat(place, ', XY') end", remote="far"), {},
    ),
    "greenhouse": (lambda t: _pages(t, "struct(k as id, title, struct(place as name) as location, url as absolute_url, html as content, day as updated_at)", "jobs", "", _BOARD), expected("greenhouse", company="slug", where="day >= '2024-01-05'"), {"now": ("2024-02-04 00:00:00", "timestamp"), "max_days": 30}),
    "lever": (lambda t: _pages(t, "struct(k as id, title as text, html as descriptionPlain, struct(place as location) as categories, url as hostedUrl, 1704067200000 + 500 * k as createdAt)", None, "", _BOARD), expected("lever", company="slug", description="html", posted="1704067200 + 0.5 * k"), {}),
    "ashby": (
        lambda t: _pages(t, "struct(k as id, title, place as location, far as isRemote, size <> 7 as isListed, day as publishedAt, if(k % 3 = 0, null, url) as jobUrl, url as applyUrl, html as descriptionPlain)", "jobs", "", _BOARD),
        expected("ashby", company="slug", description="html", remote="far or contains(lower(coalesce(place, '')), 'remote')", where="size <> 7"), {},
    ),
    "smartrecruiters": (
        lambda t: _pages(t, "struct(k as id, title as name, struct(place as city, '' as region, 'US' as country, far as remote) as location, struct(company as name) as company, day as releasedDate)", "content", "", _BOARD),
        expected("smartrecruiters", company="coalesce(company, slug)", description="''", location="case when place is null then 'US' else concat(place, ', US') end", remote="far", url="concat('https://jobs.smartrecruiters.com/', slug, '/', cast(k as string))"), {},
    ),
    "workable": (
        lambda t: _pages(t, "struct(k as shortcode, title, place as city, 'CA' as state, cast(null as string) as country, far as telecommuting, url, html as description, day as published_on)", "jobs", "'name', concat('Firm ', slug), ", _BOARD),
        expected("workable", company="concat('Firm ', slug)", location="case when place is null then 'CA' else concat(place, ', CA') end", remote="far or contains(lower(coalesce(place, '')), 'remote')"), {},
    ),
    "recruitee": (lambda t: _pages(t, "struct(k as id, title, company as company_name, place as location, 'Delft' as city, far as remote, url as careers_url, html as description, day as published_at)", "offers", "", _BOARD), expected("recruitee", company="coalesce(company, slug)", location="coalesce(place, 'Delft')", remote="far"), {}),
    "workday": (
        lambda t: _pages(t, "struct(title, concat('/job/', k) as externalPath, place as locationsText, concat('Posted ', k % 9 + 1, if(far, '+', ''), ' Days Ago') as postedOn)", "jobPostings", "", _BOARD).withColumn("slug", F.concat("slug", F.lit(":wd5:Site"))),
        expected("workday", id="concat(slug, '/job/', cast(k as string))", company="slug", description="''", url="concat('https://', slug, '.wd5.myworkdayjobs.com/Site/job/', cast(k as string))", posted="strftime(date '2024-02-01' - cast(k % 9 + 1 + cast(far as int) as int), '%Y-%m-%d')"), {"today": ("2024-02-01", "date")},
    ),
    "jooble": (lambda t: _pages(t, "struct(k as id, title, company, place as location, url as link, html as snippet, day as updated)", "jobs"), expected("jooble"), {}),
    "careerjet": (lambda t: _pages(t, "struct(title, company, place as locations, url, html as description, day as date)", "jobs", "'type', if(page % 2 = 0, 'JOBS', 'LOCATIONS'), "), expected("careerjet", id="cast(null as string)", where="(k // 50) % 2 = 0"), {}),
    "findwork": (lambda t: _pages(t, "struct(k as id, title as role, company as company_name, place as location, far as remote, url, html as text, day as date_posted)", "results"), expected("findwork", location="coalesce(place, case when far then 'Remote' else '' end)", remote="far"), {}),
    "linkedin": (
        lambda t: _markup(t, """concat('<li><div data-entity-urn="urn:li:jobPosting:', 10000000 + k div 2, '"><a href="https://www.linkedin.com/jobs/view/', k, '?x=1">z</a><h3 class="base-search-card__title"> ', title, ' </h3><h4 class="base-search-card__subtitle"><a class="hidden-nested-link" href="/c">', coalesce(company, ''), '</a></h4><span class="job-search-card__location">', coalesce(place, ''), '</span><time datetime="', day, '">then</time></div></li>')""", "<ul>", "</ul>"),
        expected("linkedin", id="cast(10000000 + k // 2 as string)", url="concat('https://www.linkedin.com/jobs/view/', cast(k as string))", description="''", where="k % 2 = 0"), {},
    ),
    "remotive": (lambda t: _pages(t, "struct(k div 2 as id, title, company as company_name, place as candidate_required_location, url, html as description, day as publication_date)", "jobs"), expected("remotive", id="cast(k // 2 as string)", remote="true", where="k % 2 = 0"), {}),
    "arbeitnow": (lambda t: _pages(t, "struct(concat('s', k) as slug, title, company as company_name, place as location, far as remote, url, html as description, 1704067200 + k as created_at, array('x') as tags)", "data"), expected("arbeitnow", id="concat('s', cast(k as string))", location="coalesce(place, 'Ulm')", remote="far", posted="cast(1704067200 + k as string)", where="contains(lower(title), 'widget') or contains(lower(title), 'senior')"), {"searches": [("widget", "Ulm"), ("Senior anything", "Ulm")]}),
    "remoteok": (lambda t: _pages(t, "struct(k as id, if(size = 7, '', title) as position, company, place as location, url, html as description, day as date)", None), expected("remoteok", location="coalesce(place, 'Remote')", remote="true", where="size <> 7"), {}),
    "indeed": (
        lambda t: _markup(t, "concat('<item><title>', title, if(far, concat(' - ', coalesce(company, 'Nobody')), ''), '</title><link>', url, '</link>', if(far, '', concat('<source>', coalesce(company, 'Nobody'), '</source>')), '<description>about &lt;b&gt;it</description></item>')", "<rss><channel>", "</channel></rss>"),
        expected("indeed", id="cast(null as string)", company="coalesce(company, 'Nobody')", location="''", description="'about  it'", posted="cast(null as string)"), {},
    ),
    "weworkremotely": (
        lambda t: _markup(t, "concat('<item><title>', if(far, concat(coalesce(company, 'Nobody'), ': '), ''), title, '</title><link>', url, '</link>', if(place is null, '', concat('<region>', place, '</region>')), '<description>about it</description><pubDate>', day, '</pubDate></item>')", "<rss><channel>", "</channel></rss>"),
        expected("weworkremotely", id="url", company="case when far then coalesce(company, 'Nobody') else '' end", location="coalesce(place, 'Remote')", description="'about it'", remote="true"), {},
    ),
    "themuse": (
        lambda t: _pages(t, "struct(k as id, title as name, struct(company as name) as company, array(struct(place as name), struct('Ulm' as name)) as locations, array(struct(if(far, 'entry', 'unknown') as short_name)) as levels, struct(url as landing_page) as refs, html as contents, day as publication_date)", "results"),
        expected("themuse", location="case when place is null then 'Ulm' else concat(place, '; Ulm') end", remote="contains(lower(coalesce(place, '')), 'remote')", level=f"case when far then 'entry' else {_LEVEL} end"), {},
    ),
    "himalayas": (
        lambda t: _pages(t, "struct(if(k % 3 = 0, null, concat('g', k)) as guid, title, company as companyName, if(place is null, array(), array(place, 'EU')) as locationRestrictions, url as applicationLink, html as description, cast(1704067200 + k as string) as pubDate)", "jobs"),
        expected("himalayas", id="case when k % 3 = 0 then url else concat('g', cast(k as string)) end", location="case when place is null then 'Remote' else concat(place, ', EU') end", posted="cast(1704067200 + k as string)", remote="true"), {},
    ),
    "jobicy": (lambda t: _pages(t, "struct(k as id, title as jobTitle, company as companyName, place as jobGeo, if(far, 'Junior', 'Any') as jobLevel, url, html as jobDescription, day as pubDate)", "jobs"), expected("jobicy", remote="true", level="case when k % 3 = 0 then 'senior' when far then 'entry' else 'mid' end"), {}),
    "hnhiring": (
        lambda t: _pages(t, "struct(k as id, day as created_at, if(size = 7, '', concat(coalesce(company, 'Nobody'), ' | ', title, ' engineer | ', coalesce(place, 'Ulm'), '<p>More.')) as text)", "children"),
        expected("hnhiring", company="coalesce(company, 'Nobody')", title="concat(title, ' engineer')", location="case when contains(lower(coalesce(place, '')), 'remote') then 'Remote' else '' end", remote="contains(lower(coalesce(place, '')), 'remote')", url="concat('https://news.ycombinator.com/item?id=', cast(k as string))", description="concat(coalesce(company, 'Nobody'), ' | ', title, ' engineer | ', coalesce(place, 'Ulm'), chr(10), 'More.')", where="size <> 7"), {},
    ),
}


def _ld_pages(t) -> DataFrame:
    t.part.createOrReplaceTempView("part")
    posting = "named_struct('@type', 'JobPosting', 'title', title, 'hiringOrganization', named_struct('name', company), 'jobLocation', named_struct('address', named_struct('addressLocality', place)), 'jobLocationType', if(far, 'TELECOMMUTE', null), 'url', url, 'description', html, 'datePosted', day)"
    body = f"case when k % 3 = 0 then concat('[', to_json({posting}), ']') when k % 3 = 1 then concat('{{\"@graph\":[', to_json({posting}), ']}}') else to_json({posting}) end"
    return t.spark.sql(BASE).select(F.expr("concat('https://p.example/', k)").alias("url_of"), F.expr(f"concat('<html><script type=\"application/ld+json\">', {body}, '</script>')").alias("payload")).withColumnRenamed("url_of", "url")


for _name in ("wellfound", "dice"):
    FAMILIES[_name] = (_ld_pages, expected(_name, id="cast(null as string)", remote="far or contains(lower(coalesce(place, '')), 'remote')"), {})


def run(t, name: str) -> DataFrame:
    """The postings of one family's payloads."""
    rows, _, more = FAMILIES[name]
    pages = rows(t)
    more = {k: F.lit(v[0]).cast(v[1]) if isinstance(v, tuple) else v for k, v in more.items()}
    if "searches" in more:
        more = {"searches": t.spark.createDataFrame(more["searches"], "role string, location string")}
    out = payloads.FAMILIES[name](pages, **more)
    return out.withColumn("posted_at_raw", F.col("posted_at_raw").cast("double")) if name == "lever" else out
