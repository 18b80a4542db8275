"""JSON of unknown shape, walked in the engine: breadth first, one level of a blob at a time, as variants.

A level is the values inside the objects and lists of the level before, so no schema is named and no Python runs.  A blob's levels are
steps of one expression over its row: nothing is written or shuffled.  A node's path, its place in each level, gives depth-first order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import experience_level, strip_tags

#: How deep a walk for postings goes, and one over app state, which only has to end.
DEPTH, STATE_DEPTH = 10, 100
_FIELDS = ("source_job_id", "title", "company", "location", "is_remote", "url", "description")


def _field(node: Column, name: str) -> tuple[Column, Column]:
    """A field as text, null where it is missing, blank, false, zero or empty; and whether it is text."""
    said = F.try_variant_get(node, f"$.{name}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(node, f"$.{name}", "variant")) == "STRING"
    # in this order, as each test that is needed reads the node again
    return F.when(said.isNotNull() & (said != "") & (~said.isin("false", "0", "0.0", "[]", "{}") | is_text), said), is_text


def got(node: Column, *names: str) -> Column:
    """The first of some fields that holds anything, as text, else ''."""
    return F.coalesce(*(_field(node, n)[0] for n in names), F.lit(""))


def got_text(node: Column, *names: str) -> Column:
    """The first of some fields that holds anything, if it is text, else ''."""
    found = (_field(node, n) for n in names)
    return F.coalesce(*(F.when(said.isNotNull(), F.when(is_text, said).otherwise("")) for said, is_text in found), F.lit(""))


def _opened(nodes: Column, hit: Callable[[Column], Column]) -> Column:
    """Those of some nodes (path, node) that are objects or lists, with the values inside and whether they are hits; each is read once."""
    read = F.transform(nodes, lambda x: F.struct(x["path"].alias("path"), x["node"].alias("node"), F.try_variant_get(x["node"], "$", "map<string,variant>").alias("named"), F.try_variant_get(x["node"], "$", "array<variant>").alias("listed")))
    inner = F.filter(read, lambda x: x["named"].isNotNull() | x["listed"].isNotNull())
    return F.transform(inner, lambda x: F.struct(x["path"].alias("path"), x["node"].alias("node"), F.coalesce(x["listed"], F.map_values(x["named"])).alias("inside"), (x["named"].isNotNull() & F.coalesce(hit(x["node"]), F.lit(False))).alias("hit")))


def objects(payload: Column, hit: Callable[[Column], Column], below: bool, depth: int = DEPTH) -> Column:
    """(path, node) of every object of a blob for which ``hit`` holds, level by level; ``below`` a hit is walked only if said so.

    Null and broken blobs have none.  A blob itself is at depth 0; what is deeper than ``depth`` is not visited.
    """
    nodes = "array<struct<path:array<int>,node:variant>>"
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.try_parse_json(payload).alias("node")))
    hits = lambda level: F.transform(F.filter(level, lambda x: x["hit"]), lambda x: F.struct(x["path"].alias("path"), x["node"].alias("node")))

    def inside(level: Column) -> Column:
        walked = level if below else F.filter(level, lambda x: ~x["hit"])
        return F.flatten(F.transform(walked, lambda x: F.transform(x["inside"], lambda v, k: F.struct(F.concat(x["path"], F.array(k)).alias("path"), v.alias("node")))))

    # a blob has no more levels than opening brackets
    brackets = F.length(payload) - F.length(F.translate(payload, "{[", ""))
    steps = F.array_repeat(F.lit(0), F.least(F.coalesce(brackets - 1, F.lit(0)), F.lit(depth)))
    none = F.struct(F.array().cast(nodes).alias("found"), _opened(root, hit).alias("level"))
    step = lambda a, _: F.struct(F.concat(a["found"], hits(a["level"])).alias("found"), _opened(inside(a["level"]), hit).alias("level"))
    return F.aggregate(steps, none, step, lambda a: F.concat(a["found"], hits(a["level"])))


def postings_in(blobs: DataFrame, host: str, source: str, keep: tuple[str, ...] = (), payload_col: str = "payload") -> DataFrame:
    """RawPosting rows of the objects with a title and a url on the host; nothing below one is visited."""
    url = lambda node: got(node, "url", "jobUrl", "applyUrl")
    found = objects(F.col(payload_col), lambda node: (got(node, "title", "name") != "") & url(node).contains(host), False)
    hits = blobs.select(*keep, F.explode(found).alias("o")).select(*keep, "o.node")
    node = F.col("node")
    place, company = got_text(node, "remote", "locationStr", "location"), F.when(got(node, "startupName", "company") != "", got_text(node, "startupName", "company")).otherwise(got_text(node, "startup.name"))
    remote = F.lower(got(node, "remote", "locationStr", "location")).contains("remote") | (got(node, "remote") != "")
    values = [got(node, "id"), got(node, "title", "name"), company, place, remote, url(node), got(node, "description")]
    rows = hits.select(*keep, *(v.alias(n) for v, n in zip(values, _FIELDS, strict=True)))
    return rows.select(*keep, F.lit(source).alias("source"), *_FIELDS, experience_level("title", F.lit("")).alias("experience_level"), F.lit(None).cast("string").alias("posted_at_raw"))


def app_state(payload: Column, origin: str, path: str) -> Column:
    """(path, title, company, location, url, description) of the postings in a page's embedded app state, in depth-first order.

    Postings are objects with a title, an id and a company at any depth, also inside one another.  A url may come again.
    """
    body = F.regexp_extract(payload, r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    key = lambda node: got(node, "id", "jobId", "guid")
    is_posting = lambda node: (got(node, "title", "jobTitle") != "") & (key(node) != "") & (got(node, "companyName", "company") != "")

    def read(x: Column) -> Column:
        node = x["node"]
        company = F.when(got(node, "companyName", "company").rlike(r"^\s*\{"), got(node, "companyName.name", "company.name")).otherwise(got(node, "companyName", "company"))
        about = F.trim(strip_tags(got(node, "summary", "description")))
        return F.struct(x["path"].alias("path"), F.trim(got(node, "title", "jobTitle")).alias("title"), F.trim(company).alias("company"), F.trim(got(node, "jobLocation", "location", "formattedLocation")).alias("location"), F.concat(F.lit(origin + path), key(node)).alias("url"), about.alias("description"))

    # the body is bound once: the walk reads it several times
    hits = F.flatten(F.transform(F.array(body), lambda said: objects(said, is_posting, True, STATE_DEPTH)))
    return F.sort_array(F.transform(hits, read))
