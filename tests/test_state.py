"""Keyed state: what a version writes, writes again, merges and deletes; and the stream's tables against its snapshots."""

import json

from pyspark.sql import functions as F

from postloom.streaming import cycle
from postloom.streaming.state import KeyedTable

SCHEMA = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(table, **options):
    return {r.k: r.v for r in table.read(**options).collect()}


def test_changes_replays_merges_and_deletes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", SCHEMA, buckets=4, most_logs=2, keep=2)
    assert content(table) == {}
    want = {f"k{i}": 0 for i in range(40)}
    table.apply(rows(spark, *want.items()), 0)
    for v in range(1, 7):
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
        table.apply(rows(spark, ("k3", v), (f"new{v}", v)), v)
        touched = {int(p.parent.name[7:]) for p in (tmp_path / "t").rglob("*.parquet") if p not in before}
        assert touched <= set(table.buckets_of(rows(spark, ("k3", 0), (f"new{v}", 0))))  # no other bucket is written
        want |= {"k3": v, f"new{v}": v}
        assert content(table, before=v)["k3"] == v - 1 and f"new{v}" not in content(table, before=v)
        assert content(table) == want
        table.apply(rows(spark, ("k3", v), (f"new{v}", v)), v)  # again
        assert content(table) == want
    assert all(len(folders) <= 3 for folders in table.manifest(6).values()) and any(f.startswith("base-") for x in table.manifest(6).values() for f in x)
    assert table.versions() == [5, 6]
    used = {f"{f}/bucket={b}" for v in (5, 6) for b, folders in table.manifest(v).items() for f in folders}
    assert {f"{p.parent.parent.name}/{p.parent.name}" for p in (tmp_path / "t").rglob("*.parquet")} == used
    some = table.buckets_of(rows(spark, ("k3", 0)))
    part = content(table, buckets=some)
    assert part["k3"] == 6 and len(part) < len(want)


def test_stream_with_keyed_tables(spark, tmp_path):
    def land(name, *jobs):
        jobs = {"jobs": [{"id": i, "title": t, "company": "Acme", "location": "Rome", "link": u, "snippet": s} for i, t, u, s in jobs]}
        (tmp_path / f"in/{name}.json").write_text(json.dumps({"payload": json.dumps(jobs), "slug": "", "location": "", "url": "", "seq": 1}))
        cycle.run_incremental(spark, str(tmp_path / "in"), "jooble", str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "state"), F.lit("2024-06-01").cast("timestamp"), buckets=8)

    def known():
        keys, postings = cycle.known_tables(spark, str(tmp_path / "state"), buckets=8)
        urls = {r.keeper: r.urls for r in keys.read().where("via like 'u:%'").groupBy("keeper").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "via"))), lambda x: x["via"]).alias("urls")).collect()}
        return {r.title: (r.source_job_id, r.description, urls[r.key]) for r in postings.read().collect()}

    (tmp_path / "in").mkdir()
    land("a", ("z", "Dev", "u1", "short"), ("a", "Dev", "u2", "a longer text"), ("b", "Cook", "u3", ""))
    assert known() == {"Dev": ("z", "a longer text", ["u:u1", "u:u2"]), "Cook": ("b", "", ["u:u3"])}
    land("b", ("y", "Dev", "u4", "the longest text of all"), ("b", "Chef", "u5", ""), ("q", "Nurse", "u6", ""), ("n", "Other", "u1", ""))
    want = {"Dev": ("z", "the longest text of all", ["u:u1", "u:u2", "u:u4"]), "Cook": ("b", "", ["u:u3"]), "Nurse": ("q", "", ["u:u6"])}
    assert known() == want
    out = {(r.batch, r.outcome): r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch", "outcome").count().collect()}
    assert out == {(0, "inserted"): 2, (0, "merged"): 1, (1, "merged"): 1, (1, "skipped"): 2, (1, "inserted"): 1}

    batch = spark.read.schema("payload string, slug string, location string, url string, seq long").json(str(tmp_path / "in/b.json"))
    tables = cycle.known_tables(spark, str(tmp_path / "state"), buckets=8)
    cycle.merge_batch(cycle.conform(batch, "jooble", 1), 1, *tables, str(tmp_path / "out/batch=1"), F.lit("2024-06-01").cast("timestamp"))
    assert known() == want and tables[0].versions() == [0, 1]
