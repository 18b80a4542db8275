"""Payload families projected onto one posting schema.

Each projection takes rows with a ``payload`` (JSON text as landed), where needed a ``slug`` (the board) and
searched ``location``, and gives RawPosting rows.  Payloads are parsed once with an explicit schema, so
only named fields are read and nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import posted_at, relative_date
from ..functions.extract import absolute, anchors, search_cards, tenant_parts, thread_header
from ..functions.pages import is_challenge
from ..functions.text import experience_level, html_to_lines, is_remote, strip_tags, text
from .json_levels import app_state

RAW_COLUMNS = ("source", "source_job_id", "title", "company", "location", "is_remote", "url", "description", "experience_level", "posted_at_raw")
#: Levels of one family, locales of another.
LEVELS = {"internship": "entry", "entry": "entry", "mid": "mid", "senior": "senior", "management": "senior"}
LOCALES = {"united kingdom": "en_GB", "london": "en_GB", "canada": "en_CA", "india": "en_IN", "australia": "en_AU", "germany": "de_DE", "france": "fr_FR"}

#: A column of landed rows that projections keep, with a posting's place in its payload, ``pos``.
ARRIVAL = "_arrival"

Projection = Callable[[DataFrame], DataFrame]


def raw(df: DataFrame, source: str, *, id: Column, title: Column, company: Column, location: Column, url: Column, description: Column, posted: Column, remote: Column | None = None, level: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: A002
    """RawPosting rows; remote defaults to the word in place or title, the level to that of the text."""
    if ARRIVAL in df.columns:
        keep = (*keep, ARRIVAL, *(("pos",) if "pos" in df.columns else ()))
    rows = df.select(F.lit(source).alias("source"), id.cast("string").alias("source_job_id"), text(title).alias("title"), text(company).alias("company"), text(location).alias("location"), url.alias("url"), text(description).alias("description"), posted.cast("string").alias("posted_at_raw"), (remote if remote is not None else F.lit(None)).cast("boolean").alias("_remote"), (level if level is not None else F.lit(None)).cast("string").alias("_level"), *keep)
    rows = rows.withColumns({"is_remote": F.coalesce("_remote", is_remote("location", "title")), "experience_level": F.coalesce("_level", experience_level("title", "description"))})
    return rows.select(*RAW_COLUMNS, *keep)


def items(df: DataFrame, schema: str, path: str | None) -> DataFrame:
    """One row ``j`` for each element of the payload's list, its context columns kept."""
    parsed = df.withColumn("_p", F.from_json("payload", schema))
    listed = F.col("_p" if path is None else f"_p.{path}")
    return parsed.select(*(c for c in df.columns if c != "payload"), F.posexplode(listed).alias("pos", "j"))


def _kept(df: DataFrame, *columns: str) -> list[str]:
    return [c for c in (*columns, ARRIVAL) if c in df.columns]


def _parts(*columns: str) -> Column:
    return F.concat_ws(", ", *(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def _first_of(df: DataFrame, *keys: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("pos"))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def adzuna(df: DataFrame) -> DataFrame:
    j = items(df, "results array<struct<id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,description:string,created:string>>", "results")
    c = F.col
    return raw(j, "adzuna", id=c("j.id"), title=c("j.title"), company=c("j.company.display_name"), location=c("j.location.display_name"), url=c("j.redirect_url"), description=c("j.description"), posted=c("j.created"))


def jsearch(df: DataFrame) -> DataFrame:
    j = items(df, "data array<struct<job_id:string,job_title:string,employer_name:string,job_city:string,job_state:string,job_country:string,job_is_remote:boolean,job_apply_link:string,job_description:string,job_posted_at_datetime_utc:string>>", "data")
    c, place = F.col, F.nullif(_parts("j.job_city", "j.job_state"), F.lit(""))
    return raw(j, "jsearch", id=c("j.job_id"), title=c("j.job_title"), company=c("j.employer_name"), location=F.coalesce(place, "j.job_country"), url=c("j.job_apply_link"), description=c("j.job_description"), posted=c("j.job_posted_at_datetime_utc"), remote=F.coalesce("j.job_is_remote", F.lit(False)))


def fresh(posted: Column, now: Column | None, max_days: int) -> Column:
    """Kept unless it parses and is older; unparseable dates are kept."""
    return F.lit(True) if now is None or max_days <= 0 else F.coalesce(posted >= now - F.make_dt_interval(days=F.lit(max_days)), F.lit(True))


def greenhouse(df: DataFrame, now: Column | None = None, max_days: int = 30) -> DataFrame:
    j = items(df, "jobs array<struct<id:string,title:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:string>>", "jobs").where(fresh(posted_at(F.col("j.updated_at")), now, max_days))
    c = F.col
    return raw(j, "greenhouse", id=c("j.id"), title=c("j.title"), company=c("slug"), location=c("j.location.name"), url=c("j.absolute_url"), description=strip_tags(c("j.content")), posted=c("j.updated_at"))


def lever(df: DataFrame, now: Column | None = None, max_days: int = 30) -> DataFrame:
    j = items(df, "array<struct<id:string,text:string,descriptionPlain:string,categories:struct<location:string>,hostedUrl:string,createdAt:bigint>>", None).where(fresh(F.timestamp_millis(F.col("j.createdAt")), now, max_days))
    c = F.col
    return raw(j, "lever", id=c("j.id"), title=c("j.text"), company=c("slug"), location=c("j.categories.location"), url=c("j.hostedUrl"), description=c("j.descriptionPlain"), posted=c("j.createdAt") / 1000)


def ashby(df: DataFrame, now: Column | None = None, max_days: int = 30) -> DataFrame:
    j = items(df, "jobs array<struct<id:string,title:string,location:string,isRemote:boolean,isListed:boolean,publishedAt:string,jobUrl:string,applyUrl:string,descriptionPlain:string>>", "jobs")
    j = j.where(F.coalesce("j.isListed", F.lit(True)) & fresh(posted_at(F.col("j.publishedAt")), now, max_days))
    c = F.col
    return raw(j, "ashby", id=c("j.id"), title=c("j.title"), company=c("slug"), location=c("j.location"), url=F.coalesce("j.jobUrl", "j.applyUrl"), description=c("j.descriptionPlain"), posted=c("j.publishedAt"), remote=F.coalesce("j.isRemote", F.lit(False)) | F.lower(text("j.location")).contains("remote"))


def smartrecruiters(df: DataFrame, details: DataFrame | None = None, most: int = 25) -> DataFrame:
    """Details (slug, id, payload) supply the descriptions of each board's first postings."""
    j = items(df, "content array<struct<id:string,name:string,location:struct<city:string,region:string,country:string,remote:boolean>,company:struct<name:string>,releasedDate:string>>", "content").withColumn("id", F.col("j.id"))
    if details is not None:
        sections = F.from_json("payload", "jobAd struct<sections:map<string,struct<text:string>>>")
        told = details.select("slug", "id", F.array_join(F.filter(F.transform(F.map_values(sections["jobAd"]["sections"]), lambda s: strip_tags(s["text"])), lambda s: F.trim(s) != ""), "\n\n").alias("_told"))
        j = j.withColumn("_n", F.row_number().over(W.partitionBy("slug").orderBy("pos"))).join(told, ["slug", "id"], "left").withColumn("_told", F.when(F.col("_n") <= most, F.col("_told")))
    else:
        j = j.withColumn("_told", F.lit(""))
    c, place = F.col, _parts("j.location.city", "j.location.region", "j.location.country")
    return raw(j, "smartrecruiters", id=c("id"), title=c("j.name"), company=F.coalesce("j.company.name", "slug"), location=place, url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"), "id"), description=c("_told"), posted=c("j.releasedDate"), remote=F.coalesce("j.location.remote", F.lit(False)))


def workable(df: DataFrame) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json("payload", "name string, jobs array<struct<shortcode:string,title:string,city:string,state:string,country:string,telecommuting:boolean,url:string,description:string,published_on:string>>"))
    j = parsed.select(*_kept(df, "slug"), F.col("_p.name").alias("name"), F.posexplode("_p.jobs").alias("pos", "j"))
    c, place = F.col, _parts("j.city", "j.state", "j.country")
    return raw(j, "workable", id=c("j.shortcode"), title=c("j.title"), company=F.coalesce(F.nullif("name", F.lit("")), "slug"), location=place, url=c("j.url"), description=strip_tags(c("j.description")), posted=c("j.published_on"), remote=F.coalesce("j.telecommuting", F.lit(False)) | F.lower(place).contains("remote"))


def recruitee(df: DataFrame) -> DataFrame:
    j = items(df, "offers array<struct<id:string,title:string,company_name:string,location:string,city:string,remote:boolean,careers_url:string,description:string,published_at:string>>", "offers")
    c = F.col
    return raw(j, "recruitee", id=c("j.id"), title=c("j.title"), company=F.coalesce("j.company_name", "slug"), location=F.coalesce(F.nullif("j.location", F.lit("")), "j.city"), url=c("j.careers_url"), description=strip_tags(c("j.description")), posted=c("j.published_at"), remote=F.coalesce("j.remote", F.lit(False)))


def workday(df: DataFrame, details: DataFrame | None = None, today: Column | None = None, most: int = 20) -> DataFrame:
    """Rows need slug as tenant:host:site; details (slug, path, payload) as fetched.  A path counts once."""
    j = items(df, "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", "jobPostings").withColumn("path", F.col("j.externalPath")).where("path is not null")
    j = _first_of(j, "slug", "path").withColumn("t", tenant_parts(F.col("slug"))).where("t is not null")
    if details is not None:
        info = F.from_json("payload", "jobPostingInfo struct<jobDescription:string,location:string,externalUrl:string,startDate:string>")["jobPostingInfo"]
        j = j.withColumn("_n", F.row_number().over(W.partitionBy("slug").orderBy("pos"))).join(details.select("slug", "path", info.alias("d")), ["slug", "path"], "left").withColumn("d", F.when(F.col("_n") <= most, F.col("d")))
    else:
        j = j.withColumn("d", F.lit(None).cast("struct<jobDescription:string,location:string,externalUrl:string,startDate:string>"))
    c = F.col
    said = relative_date(c("j.postedOn"), today if today is not None else F.current_date()).cast("string")
    own = F.concat(F.lit("https://"), "t.tenant", F.lit("."), "t.host", F.lit(".myworkdayjobs.com/"), "t.site", "path")
    return raw(j, "workday", id=F.concat("t.tenant", "path"), title=c("j.title"), company=c("t.tenant"), location=F.coalesce(F.nullif("d.location", F.lit("")), "j.locationsText"), url=F.coalesce("d.externalUrl", own), description=strip_tags(c("d.jobDescription")), posted=F.coalesce("d.startDate", said))


def jooble(df: DataFrame) -> DataFrame:
    j = items(df, "jobs array<struct<id:string,title:string,company:string,location:string,link:string,snippet:string,updated:string>>", "jobs")
    c = F.col
    return raw(j, "jooble", id=c("j.id"), title=c("j.title"), company=c("j.company"), location=c("j.location"), url=c("j.link"), description=strip_tags(c("j.snippet")), posted=c("j.updated"))


def careerjet(df: DataFrame) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json("payload", "type string, jobs array<struct<title:string,company:string,locations:string,url:string,description:string,date:string>>")).where("_p.type = 'JOBS'")
    j = parsed.select(*_kept(df), F.posexplode("_p.jobs").alias("pos", "j"))
    c = F.col
    return raw(j, "careerjet", id=F.lit(None), title=c("j.title"), company=c("j.company"), location=c("j.locations"), url=c("j.url"), description=strip_tags(c("j.description")), posted=c("j.date"))


def careerjet_locale(place: Column) -> Column:
    out = F.lit("en_US")
    for hint, locale in reversed(LOCALES.items()):
        out = F.when(F.lower(place).contains(hint), locale).otherwise(out)
    return out


def findwork(df: DataFrame) -> DataFrame:
    j = items(df, "results array<struct<id:string,role:string,company_name:string,location:string,remote:boolean,url:string,text:string,date_posted:string>>", "results")
    c, far = F.col, F.coalesce("j.remote", F.lit(False))
    return raw(j, "findwork", id=c("j.id"), title=c("j.role"), company=c("j.company_name"), location=F.coalesce(F.nullif("j.location", F.lit("")), F.when(far, "Remote")), url=c("j.url"), description=strip_tags(c("j.text")), posted=c("j.date_posted"), remote=far)


def linkedin(df: DataFrame, details: DataFrame | None = None, most: int = 200) -> DataFrame:
    """Result pages (payload, seq): cards with an id count once over all pages, those without all stay.

    Details (id, payload) as fetched supply the descriptions of the first ``most`` postings that have an id, in
    page order; a page that is a bot check tells nothing.
    """
    cards = search_cards(df.withColumnRenamed("payload", "html"), "html", *_kept(df, "seq"))
    named = cards.where("source_job_id is not null").groupBy("source_job_id").agg(F.min_by(F.struct(*(c for c in cards.columns if c != "source_job_id")), F.struct("seq", "pos")).alias("x"))
    j = named.select("source_job_id", "x.*").unionByName(cards.where("source_job_id is null"))
    c, told = F.col, F.lit("")
    if details is not None:
        body = F.regexp_extract("payload", r"(?is)<div[^>]*description__text[^>]*>(.*?)</(?:section|main|body)>", 1)
        text_of = details.where(~is_challenge(F.lit(""), F.col("payload"))).select(F.col("id").alias("source_job_id"), F.regexp_replace(html_to_lines(body), r"^\s+|\s+$", "").alias("_told"))
        first = j.where("source_job_id is not null").select("source_job_id", "seq", "pos").orderBy("seq", "pos").limit(most).select("source_job_id").join(text_of, "source_job_id")
        j, told = j.join(F.broadcast(first), "source_job_id", "left"), F.coalesce("_told", F.lit(""))  # at most ``most`` rows
    return raw(j, "linkedin", id=c("source_job_id"), title=c("title"), company=c("company"), location=c("location"), url=c("url"), description=told, posted=c("posted_at_raw"))


def remotive(df: DataFrame) -> DataFrame:
    j = items(df, "jobs array<struct<id:string,title:string,company_name:string,candidate_required_location:string,url:string,description:string,publication_date:string>>", "jobs")
    j = _first_of(j.withColumn("id", F.col("j.id")), "id")
    c = F.col
    return raw(j, "remotive", id=c("id"), title=c("j.title"), company=c("j.company_name"), location=c("j.candidate_required_location"), url=c("j.url"), description=strip_tags(c("j.description")), posted=c("j.publication_date"), remote=F.lit(True))


def arbeitnow(df: DataFrame, searches: DataFrame | None = None) -> DataFrame:
    """The feed against searches (role, location), of which there are few: each posting once for each that it fits.

    A posting fits if a word of the role is in its title or tags; the searched location stands in for a missing
    one.  Postings that several searches give alike come out once.  Without searches, rows carry ``location``.
    """
    j = items(df, "data array<struct<slug:string,title:string,company_name:string,location:string,remote:boolean,url:string,description:string,created_at:bigint,tags:array<string>>>", "data")
    c = F.col
    if searches is not None:
        said = F.lower(F.concat_ws(" ", "j.title", "j.tags"))
        fits = F.exists(F.filter(F.split(F.lower("role"), r"\s+"), lambda w: w != ""), lambda w: said.contains(w)) | (F.trim("role") == "")
        j = j.drop("location").join(F.broadcast(searches.select("role", "location").distinct()), fits)
        j = j.withColumn("_place", F.coalesce(F.nullif("j.location", F.lit("")), "location")).dropDuplicates(["j", "_place"])
    else:
        j = j.withColumn("_place", F.coalesce(F.nullif("j.location", F.lit("")), "location"))
    return raw(j, "arbeitnow", id=c("j.slug"), title=c("j.title"), company=c("j.company_name"), location=c("_place"), url=c("j.url"), description=strip_tags(c("j.description")), posted=c("j.created_at"), remote=F.coalesce("j.remote", F.lit(False)))


def remoteok(df: DataFrame) -> DataFrame:
    j = items(df, "array<struct<id:string,position:string,company:string,location:string,url:string,description:string,date:string>>", None).where("j.position <> ''")
    c = F.col
    return raw(j, "remoteok", id=c("j.id"), title=c("j.position"), company=c("j.company"), location=F.coalesce(F.nullif("j.location", F.lit("")), F.lit("Remote")), url=c("j.url"), description=strip_tags(c("j.description")), posted=c("j.date"), remote=F.lit(True))


RSS = "channel struct<item:array<struct<title:string,link:string,description:string,source:string,pubDate:string,region:string>>>"


def _feed(df: DataFrame) -> DataFrame:
    return df.select(*_kept(df), F.posexplode(F.from_xml("payload", RSS)["channel"]["item"]).alias("pos", "j"))


def indeed(df: DataFrame) -> DataFrame:
    j, c = _feed(df), F.col
    company = F.coalesce(F.nullif("j.source", F.lit("")), F.regexp_extract("j.title", r"^.* - (.*)$", 1))
    title = F.when(F.coalesce("j.source", F.lit("")) != "", c("j.title")).otherwise(F.regexp_replace("j.title", r"^(.*) - .*$", "$1"))
    return raw(j, "indeed", id=F.lit(None), title=title, company=company, location=F.lit(""), url=c("j.link"), description=strip_tags(c("j.description")), posted=F.lit(None))


def weworkremotely(df: DataFrame) -> DataFrame:
    j, c = _first_of(_feed(df).withColumn("link", F.col("j.link")), "link"), F.col
    split = F.split("j.title", ": ", 2)
    named = F.size(split) == 2
    return raw(j, "weworkremotely", id=c("link"), title=F.when(named, split[1]).otherwise(c("j.title")), company=F.when(named, split[0]).otherwise(""), location=F.coalesce(F.nullif("j.region", F.lit("")), F.lit("Remote")), url=c("link"), description=strip_tags(c("j.description")), posted=c("j.pubDate"), remote=F.lit(True))


def themuse(df: DataFrame) -> DataFrame:
    j = items(df, "results array<struct<id:string,name:string,company:struct<name:string>,locations:array<struct<name:string>>,levels:array<struct<short_name:string>>,refs:struct<landing_page:string>,contents:string,publication_date:string>>", "results")
    c, names = F.col, F.transform("j.locations", lambda x: x["name"])
    known = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    far = F.exists(names, lambda n: F.lower(n).contains("remote") | F.lower(n).contains("flexible"))
    return raw(j, "themuse", id=c("j.id"), title=c("j.name"), company=c("j.company.name"), location=F.array_join(names, "; "), url=c("j.refs.landing_page"), description=strip_tags(c("j.contents")), posted=c("j.publication_date"), remote=F.coalesce(far, F.lit(False)), level=F.try_element_at(known, F.try_element_at(c("j.levels"), F.lit(1))["short_name"]))


def himalayas(df: DataFrame) -> DataFrame:
    j = items(df, "jobs array<struct<guid:string,title:string,companyName:string,locationRestrictions:array<string>,applicationLink:string,description:string,pubDate:string>>", "jobs")
    c = F.col
    return raw(j, "himalayas", id=F.coalesce("j.guid", "j.applicationLink"), title=c("j.title"), company=c("j.companyName"), location=F.coalesce(F.nullif(F.array_join("j.locationRestrictions", ", "), F.lit("")), F.lit("Remote")), url=F.coalesce("j.applicationLink", "j.guid"), description=strip_tags(c("j.description")), posted=c("j.pubDate").try_cast("bigint"), remote=F.lit(True))


def jobicy(df: DataFrame) -> DataFrame:
    j = items(df, "jobs array<struct<id:string,jobTitle:string,companyName:string,jobGeo:string,jobLevel:string,url:string,jobDescription:string,pubDate:string>>", "jobs")
    c = F.col
    return raw(j, "jobicy", id=c("j.id"), title=c("j.jobTitle"), company=c("j.companyName"), location=c("j.jobGeo"), url=c("j.url"), description=strip_tags(c("j.jobDescription")), posted=c("j.pubDate"), remote=F.lit(True), level=experience_level(F.concat_ws(" ", "j.jobTitle", "j.jobLevel"), F.lit("")))


def hnhiring(df: DataFrame) -> DataFrame:
    j = items(df, "children array<struct<id:string,created_at:string,text:string>>", "children").where("j.text <> ''")
    j = j.withColumn("said", html_to_lines(F.col("j.text"))).withColumn("h", thread_header(F.col("said")))
    c, far = F.col, F.lower("said").contains("remote")
    return raw(j, "hnhiring", id=c("j.id"), title=c("h.title"), company=c("h.company"), location=F.when(far, "Remote").otherwise(""), url=F.concat(F.lit("https://news.ycombinator.com/item?id="), "j.id"), description=c("said"), posted=c("j.created_at"), remote=far)


def json_ld(df: DataFrame, source: str = "jsonld") -> DataFrame:
    """JobPosting objects of pages' JSON-LD scripts: single, listed, or inside @graph; broken blobs are skipped."""
    body = F.regexp_extract_all("payload", F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    v = df.select(*_kept(df, "url"), F.explode(body).alias("b")).select(*_kept(df, "url"), F.try_parse_json("b").alias("v")).where("v is not null")
    several = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    j = v.select(*_kept(df, "url"), F.posexplode(several).alias("pos", "o")).where(F.try_variant_get("o", "$['@type']", "string") == "JobPosting")
    got = lambda path: F.try_variant_get("o", path, "string")
    first = lambda name: F.coalesce(got(f"$.jobLocation[0].address.{name}"), got(f"$.jobLocation.address.{name}"))
    place = F.concat_ws(", ", first("addressLocality"), first("addressRegion"))
    link = F.coalesce(absolute(got("$.url"), F.col("url")), F.col("url"))
    return raw(j, source, id=F.lit(None), title=got("$.title"), company=F.coalesce(got("$.hiringOrganization.name"), F.when(~got("$.hiringOrganization").rlike(r"^\s*[{\[]"), got("$.hiringOrganization"))), location=place, url=link, description=strip_tags(got("$.description")), posted=got("$.datePosted"), remote=F.coalesce(got("$.jobLocationType") == "TELECOMMUTE", F.lit(False)) | F.lower(place).contains("remote"))


def _has_ld() -> Column:
    return F.coalesce(F.col("payload").rlike(r"[\"']@type[\"']\s*:\s*[\"']JobPosting"), F.lit(False))


def _link(href: Column, origin: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(origin), href))


def result_pages(df: DataFrame, source: str, origin: str, path: str, once: str) -> DataFrame:
    """Pages' JSON-LD postings; a page (url, payload) without any gives its links into a path, each once by title or href."""
    bare = df.where(~_has_ld())
    j = bare.select(*_kept(df, "url"), F.posexplode(anchors(F.col("payload"), path)).alias("pos", "j"))
    j = _first_of(j.withColumn("_once", F.col(f"j.{once}")), "url", "_once")
    blank = F.lit("")
    linked = raw(j, source, id=F.lit(None), title=F.col("j.title"), company=blank, location=blank, url=_link(F.col("j.href"), origin), description=blank, posted=F.lit(None), remote=F.lit(False))
    return json_ld(df, source).unionByName(linked)


def state_pages(df: DataFrame, source: str, origin: str, path: str, once: str) -> DataFrame:
    """As ``result_pages``, where a page without JSON-LD postings may embed them as app state, each url of a page once, which comes before its links.

    Pages are read row by row; only what was found is shuffled, once, to drop what comes again.
    """
    payload, blank = F.col("payload"), F.lit("")
    bare = ~_has_ld()
    told = F.when(bare & payload.contains("__NEXT_DATA__"), app_state(payload, origin, path))
    # exploding one array into one row keeps the optimizer from walking the state again for each use
    pages = df.select(*_kept(df, "url"), "payload", F.xxhash64("url", "payload").alias("_page"), F.explode(F.array(told)).alias("told"))
    stated = F.transform("told", lambda x: F.struct(F.lit(True).alias("stated"), x["url"].alias("once"), *(x[c].alias(c) for c in ("title", "company", "location", "url", "description"))))
    linked = F.transform(anchors(payload, path), lambda x: F.struct(F.lit(False).alias("stated"), x[once].alias("once"), x["title"].alias("title"), blank.alias("company"), blank.alias("location"), _link(x["href"], origin).alias("url"), blank.alias("description")))
    j = pages.select(*_kept(df, "url"), "_page", F.posexplode(F.when(F.size("told") > 0, stated).when(bare, linked)).alias("pos", "j"))
    # app state is told apart by page, links by the page's url
    own = F.when(F.col("j.stated"), F.struct(*_kept(pages, "_page")))
    first = _first_of(j.select(*j.columns, own.alias("_own"), F.when(~F.col("j.stated"), F.col("url")).alias("_at"), F.col("j.once").alias("_once")), "_own", "_at", "_once")
    rows = raw(first, source, id=F.lit(None), posted=F.lit(None), remote=F.lower("j.location").contains("remote"), **{c: F.col(f"j.{c}") for c in ("title", "company", "location", "url", "description")})
    plain = df.where(~bare | (payload.rlike(r"(?i)application/ld\+json") & (F.coalesce(F.size(told), F.lit(0)) <= 0)))
    return json_ld(plain, source).unionByName(rows)


FAMILIES: dict[str, Projection] = {f.__name__: f for f in (adzuna, jsearch, greenhouse, lever, ashby, smartrecruiters, workable, recruitee, workday, jooble, careerjet, findwork, linkedin, remotive, arbeitnow, remoteok, indeed, weworkremotely, themuse, himalayas, jobicy, hnhiring)} | {
    "wellfound": lambda df: result_pages(df, "wellfound", "https://wellfound.com", "/jobs/", "title"),
    "dice": lambda df: state_pages(df, "dice", "https://www.dice.com", "/job-detail/", "href"),
}


def matches_query(title: Column, tags: Column, query: str) -> Column:
    """Any word of the query is part of the title or a tag."""
    said = F.lower(F.concat_ws(" ", title, tags))
    words = [w for w in query.lower().split() if w]
    return F.exists(F.array(*map(F.lit, words)), lambda w: said.contains(w)) if words else F.lit(True)


def fan_out(roles: DataFrame, places: DataFrame) -> DataFrame:
    """Searches: small dimensions only, every role with every place."""
    return roles.crossJoin(F.broadcast(places))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
