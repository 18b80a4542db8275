"""Queries whose work once grew faster than their tables."""

import datetime
import json
import random
import time
import uuid

from pyspark.sql import functions as F

import __spark_entry__
from postloom import scratch
from postloom.functions import text
from postloom.operators import assemble, compare, resolve
from postloom.sources import json_levels, payloads


def _folder(tmp_path, **tables) -> str:
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_fields_are_normalised_before_the_join(spark, tmp_path):
    parts = spark.range(4000).select(F.col("id").alias("p_partkey"), F.lit("Sr. Engr remote " + "bolt " * 40).alias("p_name"))
    firms = spark.range(1000).select(F.col("id").alias("s_suppkey"), F.lit("Acme Co Ltd " + "& Sons " * 40).alias("s_name"), F.lit(1).alias("s_nationkey"))
    folder = _folder(tmp_path, part=parts, supplier=firms, nation=spark.createDataFrame([(1, "Oslo, Norway")], "n_nationkey int, n_name string"))
    rows = __spark_entry__.queries()["dedupe_hash_parts"](spark, folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "sha2" in above and "regexp" not in above  # only the hash is left for each pair
    assert rows.count() == 40_000


def test_spellings_take_linear_time(spark):
    rows = spark.range(60_000).select(F.lit("b").alias("by"), "id", F.concat(F.lit(" Type "), F.col("id").cast("string")).alias("said"))
    listed = rows.groupBy("by").agg(F.array_sort(F.collect_list("said")).alias("all"))
    began = time.perf_counter()
    assert len(listed.select(text.ordered_distinct(F.col("all")).alias("o")).first().o) == 10
    assert time.perf_counter() - began < 30


def test_first_spellings_equal_the_list(spark):
    r = random.Random(5)
    rows = [(r.choice(("x", "y", None)), k, r.choice((" A", "a", "b ", "B", "", None, *(f"t{j}" for j in range(15))))) for k in range(400)]
    df = spark.createDataFrame(rows, "by string, id long, said string").repartition(5)
    listed = df.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "said"))), lambda x: x["said"]).alias("all"))
    want = {x.by: x.o for x in listed.select("by", text.ordered_distinct(F.col("all")).alias("o")).collect()}
    assert {x.by: x["items"] for x in assemble.first_spellings(df, "by", "id", "said").collect()} == want


def test_asof_prices_pair_no_event_with_parts(spark, tmp_path):
    r = random.Random(6)
    parts = [(k, r.choice((880.0, 895.5, 896.0, 900.0, 912.0, 915.99, 916.0, r.uniform(870, 960), None, float("nan"))), r.choice((1, 2))) for k in range(300)]
    events = [(k, r.choice((0.0, 12.0, 16.0, -4.0, 20.0, r.uniform(-30, 60), None, float("nan"))), r.choice((50, 51, 100))) for k in range(300)]
    folder = _folder(tmp_path, part=spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int"), events=spark.createDataFrame(events, "event_id long, value double, user_id long"))
    rows = __spark_entry__.queries()["rel_asof_price"](spark, folder)
    want = {e: max((p for p, price, size in parts if price is not None and size == u % 50 + 1 and 880 + v < price <= 900 + v), default=None) for e, v, u in events if v is not None}
    assert {x.event_id: x.part for x in rows.collect()} == {e: p for e, p in want.items() if p is not None}
    assert "p_retailprice" not in "".join(line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_payloads_list_items_in_order(spark, tmp_path):
    k = F.col("id")
    parts = spark.range(0, 100, 1, 1).orderBy(k % 2 == 0, -k).select(k.alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"))
    folder = _folder(tmp_path, part=parts.coalesce(1))
    assert sorted(int(x.url.rsplit("/")[-1]) for x in __spark_entry__.queries()["source_remotive"](spark, folder).collect()) == list(range(0, 100, 2))


def test_part_of_a_second_over_is_stalled(spark):
    at = [datetime.datetime(2024, 1, 1, 0, 0, 0, micro) for micro in (0, 1, 500_000)] + [datetime.datetime(2023, 12, 31, 23, 59, 59, 999_999)]
    df = spark.createDataFrame([(x,) for x in at], "at timestamp_ntz").select("at", compare.progress(F.lit("running"), F.col("at"), F.lit("2024-01-01 00:00:10").cast("timestamp_ntz"), 10).alias("p"))
    assert [(x.p.active, x.p.stalled) for x in df.orderBy("at").collect()] == [(False, True), (True, False), (True, False), (True, False)]


def test_small_components_are_replayed_together(spark, tmp_path, monkeypatch):
    plain, calls = resolve.settle, str(tmp_path)

    def counted(rows):
        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        return plain(rows)

    monkeypatch.setattr(resolve, "settle", counted)
    rows = [x for k in range(100) for x in ((f"a{k}", 3 * k, f"u{k}", f"h{k}"), (f"b{k}", 3 * k + 1, f"u{k}", f"own{k}"), (f"c{k}", 3 * k + 2, f"v{k}", f"h{k}"))]
    df = spark.createDataFrame(rows, "key string, seq long, url string, dedupe_hash string").selectExpr("*", "'s' as source", "'' as source_job_id", "false as is_existing")
    got = {x.key: (x.outcome, x.keeper) for x in resolve.outcomes(df).collect()}
    assert got == {f"{c}{k}": (o, f"a{k}") for c, o in (("a", "inserted"), ("b", "skipped"), ("c", "merged")) for k in range(100)}
    assert 0 < len(list(tmp_path.iterdir())) < 10  # calls, of 100 components


def test_app_state_is_walked_row_by_row(spark):
    deep = {"title": "last", "id": 0, "company": "Acme"}
    for k in range(1, 40):
        deep = {"title": f"t{k}", "id": k % 30, "company": "Acme", "more": [deep]}
    page = f'<script id="__NEXT_DATA__">{json.dumps(deep)}</script><a href="/job-detail/77">Linked role</a>'
    odd = '<script type="application/ld+json">{"@type": "Job\\u0050osting", "title": "Stated", "url": "/job-detail/6"}</script>'
    broken = '<script id="__NEXT_DATA__">{"a": [</script><a href="/job-detail/8">Linked role</a>'
    rows = [("https://www.dice.com/1", page), ("https://www.dice.com/1", page), ("https://www.dice.com/2", page), ("https://www.dice.com/3", broken), ("https://www.dice.com/3", broken), ("https://www.dice.com/4", odd + page), ("https://www.dice.com/5", odd), ("https://www.dice.com/6", None)]
    pages = spark.createDataFrame(rows, "url string, payload string")
    since = scratch.mark()
    found = payloads.FAMILIES["dice"](pages)
    walked = json_levels.postings_in(pages.select("payload"), "x.example", "s")
    assert scratch.mark() == since  # no level is written
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1 and walked.count() == 0
    own = [(f"t{k}", f"https://www.dice.com/job-detail/{k % 30}") for k in range(10, 40) if k != 30]  # outer postings come first, an id of 0 is none
    want = 3 * own + [("Linked role", "https://www.dice.com/job-detail/8"), ("Stated", "https://www.dice.com/job-detail/6")]
    assert sorted((x.title, x.url) for x in found.collect()) == sorted(want)


def test_parts_are_dealt_out_before_their_pages_are_walked(spark, tmp_path):
    parts = spark.range(0, 300, 1, 1).selectExpr("id as p_partkey", "'bolt' as p_name", "'b' as p_brand", "'t' as p_type", "cast(id % 50 as int) as p_size")
    folder = _folder(tmp_path, part=parts)
    for name in ("app_state_pages", "json_walk_levels"):
        df = __spark_entry__.queries()[name](spark, folder)
        assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString(), name
