"""Running aggregates over large groups, paced calls and span unions against plain loops."""

import random

from pyspark.sql import functions as F

from postloom import prefix
from postloom.operators import history, pacing, search


def test_running_aggregates_cross_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(("hot", "hot", "hot", "a", None)), k, r.randint(-9, 9)) for k in range(600)]
    df = prefix.in_ranges(spark.createDataFrame(rows, "g string, k long, v long").repartition(5), ["g"], ["k"])
    assert df.where("g = 'hot'").select("_range").distinct().count() > 1  # one group lies in several ranges
    got = {x.k: (x.s, x.m, x.n) for x in prefix.before(df, ["g"], ["k"], s=("sum", F.col("v")), m=("max", F.col("v")), n=("sum", F.lit(1))).collect()}
    for g, k, _ in rows:
        own = [v for h, j, v in rows if h == g and j < k]
        assert got[k] == (sum(own), max(own, default=None), len(own))


def test_paced_calls_equal_a_plain_line(spark):
    r = random.Random(2)
    rows = [("one" if k % 5 else "two", f"{k:03d}", r.randrange(400) * 500_000, r.choice((None, 0, 0, 0, 1, 2, 3))) for k in range(300)] + [("one", "null", None, 0), (None, "x", 1, 0)]
    df = spark.createDataFrame(rows, "provider string, id string, ready long, refusals int").repartition(4)
    scheduled = pacing.schedule(df)
    got = {x.id: (x.position, x.start, x.free, x.answered) for x in scheduled.collect()}
    assert len(got) == 300
    times = {"one": [], "two": []}
    for provider in times:
        free = 0
        for n, (_, i, ready, refusals) in enumerate(sorted((x for x in rows if x[0] == provider and x[2] is not None), key=lambda x: (x[2], x[1]))):
            start = max(ready, free)
            waits = [0, 3_000_000, 65_000_000][: min(refusals or 0, 2) + 1]
            times[provider] += [start + sum(waits[: k + 1]) for k in range(len(waits))]
            free = start + 1_500_000 + sum(waits)
            assert got[i] == (n, start, free, (refusals or 0) <= 2)
    sent = pacing.sends(scheduled)
    assert {p: sorted(t) for p, t in times.items()} == {p: sorted(x["at"] for x in sent.where(F.col("provider") == p).collect()) for p in times}
    most = {p: max(sum(t <= u < t + 60_000_000 for u in times[p]) for t in times[p]) for p in times}
    assert {x.provider: (x.sends, x.most) for x in pacing.busiest(sent).collect()} == {p: (len(times[p]), most[p]) for p in times} and max(most.values()) <= 40


def test_hot_spans_equal_the_window(spark):
    r = random.Random(3)
    rows = [(r.choice(("hot", "hot", "b", None)), s := r.choice((None, r.randrange(3000))), s if s is None else s + r.randint(-1, 9)) for _ in range(500)] + [("late", 5, None)]
    df = spark.createDataFrame(rows, "g string, start long, end long").repartition(4)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, history.merge_hot_spans(df, "g").collect()), key=key) == sorted(map(tuple, history.merge_spans(df, "g").collect()), key=key)
    assert history.merge_hot_spans(df.limit(0), "g").count() == 0


def test_pages_read_only_their_ranges(spark):
    r = random.Random(4)
    rows = [(f"{k:04d}", r.choice((None, 1.0, 2.0, float(r.randrange(50)))), "matched", None, None) for k in range(1000)]
    df = spark.createDataFrame(rows, "id string, llm_score double, status string, posted_at timestamp, fetched_at timestamp").repartition(5)
    for sort in ("score_desc", "score_asc", "unknown"):
        q = search.Query(sort=sort)
        pages = search.Pages(df, q, ranges=16, size=30)
        assert len(pages.counts) > 8
        for k in (0, 1, 17, 33, 34, 500):
            q_k = search.Query(sort=sort, page=k)
            page = pages.page(k)
            assert [x.id for x in page.collect()] == [x.id for x in search.page(df, q_k, 30).collect()]
            assert len({f.split("_range=")[1].split("/")[0] for f in page.inputFiles()}) <= 3
    assert search.Pages(df.limit(0), search.Query()).page(0).count() == 0
