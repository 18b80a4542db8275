"""Entity resolution of postings: three-layer probe, exact sequential merge, re-merge of hash groups.

A posting is the same as another by url, by (source, id), or by content hash.  The merge's outcome depends
on arrival order, so postings that any key connects are first gathered into components (large-star and
small-star steps over joins).  Only the first row of each combination of keys can make a key known, so a small component's
first rows are replayed in order by one grouped function; all other rows follow by joins.

A large component is settled in waves instead: a row is settled once none of the rows before it that share a key with it,
and could still make that key known, is open.  In a random order of arrival a few waves settle nearly all rows.
Where a wave settles little, as on a chain in which each row waits for the one before, the first open rows in order of arrival are
replayed, a bounded number at a time; so no task ever holds a whole large component.
Blank keys connect nothing, so they cannot make one giant component.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..components import connected_components
from ..functions.dates import is_stale
from ..scratch import materialize
from ..skew import with_group

#: First rows of a component that one task replays, and open rows that are replayed at a time.
REPLAY_ROWS = 50_000
#: About how many rows of small components are replayed by one call, whatever the number of components.
BATCH_ROWS = 10_000
#: The share of the open rows that a wave must settle, or else the first of them are replayed.
WAVE_SHARE = 0.1


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the first in order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def probe(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds (match_id, layer) to incoming rows (url, source, source_job_id, dedupe_hash).

    Layer 1 is a url among the existing row's source_urls, 2 the source and id, 3 the hash; the first that
    hits wins, and within one the row fetched first, then the smallest id.
    """
    order = F.struct("fetched_at", "id")
    urls = existing.select(F.explode("source_urls").alias("url"), "fetched_at", "id").groupBy("url").agg(F.min_by("id", order).alias("by_url"))
    ids = existing.where("source_job_id <> ''").groupBy("source", "source_job_id").agg(F.min_by("id", order).alias("by_id"))
    hashes = existing.groupBy("dedupe_hash").agg(F.min_by("id", order).alias("by_hash"))
    out = incoming.join(urls, "url", "left").join(ids, ["source", "source_job_id"], "left").join(hashes, "dedupe_hash", "left")
    layer = F.when(F.col("by_url").isNotNull(), 1).when(F.col("by_id").isNotNull(), 2).when(F.col("by_hash").isNotNull(), 3)
    return out.select(*incoming.columns, F.coalesce("by_url", "by_id", "by_hash").alias("match_id"), layer.alias("layer"))


def vias(postings: DataFrame, *columns: str) -> DataFrame:
    """(key, via, columns) for each key that a row may be found by; blank ones are left out."""
    keys = F.array(F.concat(F.lit("u:"), F.nullif("url", F.lit(""))), F.concat(F.lit("i:"), F.col("source"), F.lit(":"), F.nullif("source_job_id", F.lit(""))), F.concat(F.lit("h:"), F.col("dedupe_hash")))
    return postings.select("key", F.explode(keys).alias("via"), *columns).where("via is not null").distinct()


def _labels(edges: DataFrame) -> DataFrame:
    """(node, component) of the rows that share a key with another row, until no label changes."""
    total = edges.count()
    links = with_group(edges, "via", "key", total, F.min("key").alias("least"), F.count("*").alias("n"), having="n > 1")
    return connected_components(links, "key", "least", windows=True)


def components(postings: DataFrame) -> DataFrame:
    """Adds ``component``: the least row key among rows that urls, ids or hashes connect, over any number of links."""
    label = _labels(materialize(vias(postings), "vias")).withColumnRenamed("node", "key")
    return postings.join(label, "key", "left").withColumn("component", F.coalesce("component", "key")).where("key is not null")


def settle(rows: pd.DataFrame) -> pd.DataFrame:
    """When each key is first known and whose it is: (via, seq, key, keeper).

    ``rows`` has the first row of each combination of keys (u, i, h) of whole components, one or more; old_u, old_i and old_h are the
    existing rows' keepers, known before all.  Components share no key that a row could make known, so they do not meet.
    """
    known: dict[str, str] = {}
    out = []
    rows = rows.sort_values(["seq", "key"])
    for seq, key, *keys in zip(*(rows[c].to_list() for c in ("seq", "key", "u", "i", "h", "old_u", "old_i", "old_h")), strict=True):
        r, old = dict(zip("uih", keys[:3], strict=True)), dict(zip("uih", keys[3:], strict=True))
        found = next((c for c in "uih" if isinstance(old[c], str) or r[c] in known), None)
        keeper = key if found is None else known.get(r[found], old[found])
        for c in "uih" if found is None else "u" if found == "h" else "":
            if isinstance(r[c], str):
                known[r[c]] = keeper
                out.append((r[c], seq, key, keeper))
    return pd.DataFrame(out, columns=["via", "seq", "key", "keeper"])


_SETTLED = "via string, seq {kind}, key string, keeper string"


def _wave(rows: DataFrame, fresh: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(open rows, settled keys (via, at, keeper)) of one wave.

    ``rows`` are open first rows (at, key, u, i, h, old_u, old_i, old_h); ``fresh`` are the keys that were settled
    since the last wave.  A row sees a key as known only if it was made known before the row; a row that has found
    its url or id makes nothing known, whichever it turns out to follow, and so keeps no other row waiting.
    """
    found = [F.col(f"old_{c}").isNotNull() for c in "uih"]
    makes = {"u": ~(found[0] | found[1]), "i": ~(found[0] | found[1] | found[2]), "h": ~(found[0] | found[1] | found[2])}
    holds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("via"), makes[c].alias("makes")) for c in "uih"))).alias("e")
    kept, none = F.lit(None).cast("string").alias("keeper"), F.lit(None).cast("string").alias("key")
    edges = rows.select("key", "at", holds).select("key", "e.kind", "e.via", "at", "e.makes", kept).where("via is not null")
    if fresh is not None:
        edges = edges.unionByName(fresh.select(none, F.lit(None).cast("string").alias("kind"), "via", "at", F.lit(None).cast("boolean").alias("makes"), "keeper"))
    edges = materialize(edges, "edges")
    made = F.col("keeper").isNotNull()
    sums = [F.min(F.when(made, F.col("at"))).alias("known_at"), F.min_by("keeper", F.when(made, F.col("at"))).alias("known"), F.min(F.when(F.col("makes"), F.col("at"))).alias("first")]
    met = with_group(edges, "via", "at", edges.count(), *sums).where("key is not null")
    seen = met.select("key", "kind", F.when(F.col("known_at") < F.col("at"), F.col("known")).alias("known"), (F.col("first") < F.col("at")).alias("waits"))
    told = seen.groupBy("key").agg(*(F.max(F.when(F.col("kind") == c, F.col("known"))).alias(f"by_{c}") for c in "uih"), *(F.max(F.when(F.col("kind") == c, F.col("waits"))).alias(f"waits_{c}") for c in "uih"))
    told = rows.join(told, "key", "left").select("at", "key", *"uih", *(F.coalesce(f"old_{c}", f"by_{c}").alias(f"old_{c}") for c in "uih"), *((F.coalesce(f"waits_{c}", F.lit(False)) & F.col(f"old_{c}").isNull()).alias(f"waits_{c}") for c in "uih"))
    outcome = (
        F.when(F.col("old_u").isNotNull() | (~F.col("waits_u") & F.col("old_i").isNotNull()), "skipped")
        .when(F.expr("waits_u or waits_i"), None)
        .when(F.col("old_h").isNotNull() & F.col("old_i").isNull(), "merged")
        .when(F.expr("not waits_h and old_i is null"), "inserted")
    )
    told = materialize(told.withColumn("outcome", outcome), "wave")
    vias = F.when(F.col("outcome") == "inserted", F.array(*"uih")).when(F.col("outcome") == "merged", F.array("u"))
    settled = told.select(F.explode(vias).alias("via"), "at", F.when(F.col("outcome") == "merged", F.col("old_h")).otherwise(F.col("key")).alias("keeper")).where("via is not null")
    return told.where("outcome is null").select(*rows.columns), settled


def settle_in_waves(rows: DataFrame) -> DataFrame:
    """(via, seq, key, keeper) as ``settle`` gives them, of first rows of components of any size, all together."""
    kind = dict(rows.dtypes)["seq"]
    rows = materialize(rows.select(F.struct("seq", "key").alias("at"), "key", *"uih", *(f"old_{c}" for c in "uih")), "open")
    left, fresh, settled = rows.count(), None, []
    while left:
        if left > REPLAY_ROWS:
            rows, made = _wave(rows, fresh)
            now = rows.count()
        else:
            made, now = None, left
        if now and now > left * (1 - WAVE_SHARE):
            rows = _known_before(rows, made if made is not None else fresh)
            first = materialize(rows.orderBy("at").limit(REPLAY_ROWS).select("at.seq", "key", *"uih", *(f"old_{c}" for c in "uih")), "first")
            replayed = first.withColumn("_all", F.lit("all")).groupBy("_all").applyInPandas(lambda pdf: settle(pdf), _SETTLED.format(kind=kind))
            replayed = materialize(replayed.select("via", F.struct("seq", "key").alias("at"), "keeper"), "replayed")
            rows = materialize(rows.join(F.broadcast(first.select("key")), "key", "left_anti"), "open")  # at most REPLAY_ROWS keys
            made = replayed if made is None else made.unionByName(replayed)
            now = rows.count()
        settled.append(made)
        left, fresh = now, made
    out = settled[0] if settled else rows.select(F.col("u").alias("via"), "at", F.col("old_u").alias("keeper")).limit(0)
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("via", "at.seq", "at.key", "keeper")


def _known_before(rows: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """Open rows with the keepers of the keys that ``fresh`` made known before them."""
    if fresh is None:
        return rows
    for c in "uih":
        known = fresh.select(F.col("via").alias(c), F.col("at").alias("_at"), F.col("keeper").alias("_keeper"))
        rows = rows.join(known, c, "left").withColumn(f"old_{c}", F.coalesce(f"old_{c}", F.when(F.col("_at") < F.col("at"), F.col("_keeper")))).drop("_at", "_keeper")
    return materialize(rows.select("at", "key", *"uih", *(f"old_{c}" for c in "uih")), "open")


def outcomes(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, outcome, keeper) of rows (key, seq, url, source, source_job_id, dedupe_hash, is_existing), for each that is not existing.

    ``known`` may give keys that are known already as (via, keeper), each once.  Keys are only ever added, and only the first row of a combination of keys can add any, so only those first
    rows are replayed; every other row's outcome follows from when its keys became known.  A key that one row
    alone has finds nothing and is left out, so rows that share just a hash or a url are one combination.
    """
    order = F.struct("seq", "key")
    edges = vias(rows, "seq", "is_existing")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("keeper").alias("key"), "via", F.lit(None).cast(edges.schema["seq"].dataType).alias("seq"), F.lit(True).alias("is_existing")))
    edges = materialize(edges, "vias")
    old = F.min_by(F.when(F.col("is_existing"), F.col("key")), F.when(F.col("is_existing"), order)).alias("old")
    total = edges.count()
    shared = materialize(with_group(edges, "via", "key", total, old, F.count("*").alias("n"), having="n > 1").where("not is_existing"), "shared")  # read twice
    kinds = {c: F.col("via").startswith(f"{c}:") for c in "uih"}
    keyed = shared.groupBy("key").agg(F.first("seq").alias("seq"), *(F.max(F.when(is_kind, F.col("via"))).alias(c) for c, is_kind in kinds.items()), *(F.max(F.when(is_kind, F.col("old"))).alias(f"old_{c}") for c, is_kind in kinds.items()))
    firsts = keyed.groupBy(*"uih").agg(F.min(order).alias("at"), *(F.max(f"old_{c}").alias(f"old_{c}") for c in "uih"))
    firsts = materialize(firsts.select("at.seq", "at.key", *"uih", *(f"old_{c}" for c in "uih")), "firsts")

    links = firsts.select("key", F.explode(F.array(*(F.when(F.col(f"old_{c}").isNull(), F.col(c)) for c in "uih"))).alias("via")).where("via is not null")
    labelled = materialize(firsts.join(_labels(links).withColumnRenamed("node", "key"), "key", "left"), "labelled")
    kind = dict(labelled.dtypes)["seq"]
    rows_left = labelled.count()
    sized = materialize(with_group(labelled, "component", "key", rows_left, F.count("*").alias("size")), "sized")
    # a call for each of very many small components would cost more than their rows, so whole components are replayed together
    batch = F.pmod(F.xxhash64("component"), F.lit(-(-rows_left // BATCH_ROWS) or 1))
    small = sized.where(F.col("size") <= REPLAY_ROWS).withColumn("_batch", batch)
    mixed = small.groupBy("_batch").applyInPandas(lambda _, pdf: settle(pdf), _SETTLED.format(kind=kind))
    mixed = mixed.unionByName(settle_in_waves(sized.where(F.col("size") > REPLAY_ROWS)))
    alone = labelled.where("component is null and old_u is null and old_i is null")
    sets = F.when(F.col("old_h").isNull(), F.array(*"uih")).otherwise(F.array("u"))
    alone = alone.select(F.explode(sets).alias("via"), "seq", "key", F.coalesce("old_h", "key").alias("keeper")).where("via is not null")
    settled = mixed.unionByName(alone).select("via", F.struct("seq", "key").alias("at"), "keeper")

    told = shared.select("key", "via", "seq", "old").withColumns({"at": F.lit(None).cast(settled.schema["at"].dataType), "keeper": F.lit(None).cast("string")})
    told = told.unionByName(settled.selectExpr("cast(null as string) as key", "via", f"cast(null as {kind}) as seq", "cast(null as string) as old", "at", "keeper"))
    told = told.withColumnsRenamed({"at": "_at", "keeper": "_keeper"})
    told = with_group(told, "via", "key", total, F.min("_at").alias("at"), F.min_by("_keeper", "_at").alias("keeper")).where("key is not null")
    whose = F.coalesce("old", F.when(F.col("at") < order, F.col("keeper")))
    hits = told.groupBy("key").agg(*(F.max(F.when(is_kind, whose)).alias(f"by_{c}") for c, is_kind in kinds.items()))
    out = rows.where("not is_existing").select("key").distinct().join(hits, "key", "left")
    outcome = F.when(F.coalesce("by_u", "by_i").isNotNull(), "skipped").when(F.col("by_h").isNotNull(), "merged").otherwise("inserted")
    return out.select("key", outcome.alias("outcome"), F.coalesce("by_u", "by_i", "by_h", "key").alias("keeper"))


def _told(incoming: DataFrame, now: F.Column, max_age_days: int, existing: DataFrame | None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Incoming rows with a ``_stale`` mark; fresh and existing rows with outcome and keeper; the number of fresh rows."""
    stale = F.coalesce(is_stale(F.col("posted_at"), now, max_age_days), F.lit(False))
    marked = incoming.withColumn("_stale", stale)
    columns = ["key", "seq", "source", "source_job_id", "url", "apply_url", "description", "dedupe_hash"]
    rows = marked.where("not _stale").select(*columns, F.array("url").alias("source_urls"), F.lit(False).alias("is_existing"))
    if existing is not None:
        rows = rows.unionByName(existing.select(*columns, "source_urls", F.lit(True).alias("is_existing")))
    found = materialize(outcomes(rows.withColumn("url", F.explode_outer("source_urls")), known), "found")
    told = rows.join(found, "key", "left").withColumns({"outcome": F.coalesce("outcome", F.lit("existing")), "keeper": F.coalesce("keeper", "key")})
    return marked, told, found.count()


def replay(incoming: DataFrame, now: F.Column, max_age_days: int, existing: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes (key, outcome, keeper), keepers (keeper, description, apply_url), and urls (keeper, url, seq, pos).

    The same merge as ``merge``, with a keeper's fields in a row of its own and each of its urls in another, so all three grow
    with the rows only, whatever the share of one keeper.  Sorted by ``seq`` and ``pos`` a keeper's urls stand as its
    ``source_urls``; those of existing rows are among them, with a null ``seq``.  ``known`` may give known keys
    (via, keeper) in place of existing rows; the fields are then those of the incoming rows alone.
    """
    marked, told, _ = _told(incoming, now, max_age_days, existing, known)
    told = materialize(told, "told")
    first = F.struct(F.col("key") != F.col("keeper"), "seq", "key")
    text, length = F.col("outcome").isin("existing", "inserted", "merged"), F.length(F.coalesce("description", F.lit("")))
    fields = [
        F.min_by(F.when(text, F.col("description")), F.when(text, F.struct(-length, first))).alias("description"),
        F.coalesce(F.min_by("apply_url", F.when(F.col("apply_url") != "", first)), F.max_by("apply_url", first)).alias("apply_url"),
    ]
    keepers = told.groupBy("keeper").agg(*fields)
    each = told.where(text).select("keeper", F.when(F.col("outcome") != "existing", F.struct("seq", "key")).alias("seq"), F.posexplode("source_urls").alias("pos", "url"))
    urls = each.groupBy("keeper", "url").agg(F.min(F.struct("seq", "pos")).alias("_at")).select("keeper", "url", "_at.*")
    old = marked.where("_stale").select("key", F.lit("stale").alias("outcome"), F.lit(None).cast("string").alias("keeper"))
    return told.where("outcome <> 'existing'").select("key", "outcome", "keeper").unionByName(old), keepers, urls


def merge(incoming: DataFrame, now: F.Column, max_age_days: int, existing: DataFrame | None = None) -> DataFrame:
    """The outcome of each incoming posting beside its keeper's merged fields, all of the keeper's urls among them.

    Incoming rows need key, seq, source, source_job_id, url, apply_url, description, dedupe_hash and
    posted_at; existing ones key, source_urls and the rest.  Stale rows take no part.  A keeper of many rows has its urls repeated
    on each; where that is too much, ``replay`` gives them once.
    """
    marked, told, total = _told(incoming, now, max_age_days, existing)
    first, base = F.struct(F.col("key") != F.col("keeper"), "seq", "key"), F.col("key") == F.col("keeper")
    texts, length = base | (F.col("outcome") == "merged"), F.length(F.coalesce("description", F.lit("")))
    own = F.max(F.when(base, F.col("source_urls")))
    added = F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "merged", F.struct("seq", "key", "url")))), lambda x: x["url"])
    fields = [
        F.concat(own, F.array_except(added, own)).alias("_urls"),
        F.min_by(F.when(texts, F.col("description")), F.when(texts, F.struct(-length, first))).alias("_description"),
        F.coalesce(F.min_by("apply_url", F.when(F.col("apply_url") != "", first)), F.max_by("apply_url", first)).alias("_apply_url"),
    ]
    merged = with_group(told, "keeper", "key", total, *fields).where("outcome <> 'existing'")
    merged = merged.select("key", "outcome", "keeper", F.col("_urls").alias("source_urls"), F.col("_description").alias("description"), F.col("_apply_url").alias("apply_url"))
    old = marked.where("_stale").select("key", F.lit("stale").alias("outcome"), F.lit(None).cast("string").alias("keeper"), F.array().cast("array<string>").alias("source_urls"), "description", "apply_url")
    return merged.unionByName(old)


def remerge(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """Rows of one hash become one: the first fetched (null last, then id) keeps all urls.

    A duplicate with an application stays under a suffixed hash; others go.
    """
    order = F.struct(F.col("fetched_at").isNull(), "fetched_at", "id")
    ranked = with_group(postings, "dedupe_hash", "id", postings.count(), F.min_by("id", order).alias("_first"))
    urls = postings.select("dedupe_hash", F.explode("source_urls").alias("_url")).distinct()
    urls = urls.groupBy("dedupe_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("_url"))), lambda x: x["_url"]).alias("_urls"))
    used = applications.select(F.col("job_id").alias("id")).distinct()
    firsts = ranked.where("id = _first").join(urls, "dedupe_hash", "left").withColumn("source_urls", F.coalesce("_urls", F.array().cast("array<string>")))
    others = ranked.where("id <> _first").join(used, "id", "left_semi").withColumn("dedupe_hash", F.concat("dedupe_hash", F.lit("-"), F.col("id").cast("string")))
    return firsts.select(*postings.columns).unionByName(others.select(*postings.columns))


def unknown_urls(incoming: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Incoming rows whose url none of the one-column tables holds."""
    keys = known[0].toDF("url")
    for k in known[1:]:
        keys = keys.union(k.toDF("url"))
    return incoming.join(keys.distinct(), "url", "left_anti")
