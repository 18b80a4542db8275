"""Preferences as columns against the single-profile rules, and caps that tasks apply before rows are shuffled."""

import itertools
import random

from pyspark.sql import functions as F

from postloom.functions import preferences, regions
from postloom.operators import boards


def test_columns_equal_single_profiles(spark):
    r = random.Random(3)
    places = ["india", " USA", "Remote (EU)", "Oslo ", "anywhere", "", "  ", "London", "uk", "Any"]
    rows = []
    for k, (some, remote) in enumerate(itertools.product(range(40), (None, True, False))):
        own = r.sample(["uk", "europe", "usa", "nowhere", "uk"], r.randint(0, 4)) if some % 2 else None
        rows.append((k, own, r.sample([" Bath", "", "Oslo", None, "Oslo"], r.randint(0, 4)) if some % 3 else None, remote, r.sample(places, r.randint(0, 6)) if some % 5 else None))
    df = spark.createDataFrame(rows, "k int, regions array<string>, custom array<string>, remote_ok boolean, legacy array<string>")
    p = F.col("p")
    df = df.select("*", preferences.normalized(F.col("regions"), F.col("custom"), F.col("remote_ok"), F.col("legacy")).alias("p"))
    for x in df.select("*", preferences.search_places(p).alias("places"), preferences.countries(p).alias("countries"), preferences.geos(p).alias("geos"), preferences.describe(p).alias("said")).collect():
        structured = {"regions": x.regions, "custom": x.custom} | ({} if x.remote_ok is None else {"remote_ok": x.remote_ok})
        want = regions.preferences(structured, x.legacy)
        assert (tuple(x.p.regions), tuple(x.p.custom), x.p.remote_ok) == (want.regions, want.custom, want.remote_ok)
        assert (x.places, x.countries, x.geos, x.said) == (regions.search_places(want), regions.countries(want), regions.geos(want), regions.describe(want))


def test_caps_are_applied_before_the_shuffle(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 10 == 0, "w").otherwise("g").alias("ats"), F.col("id").cast("string").alias("slug"), F.lit(True).alias("active"), F.col("id").alias("last_job_count"), F.col("id").alias("total_job_count"), F.lit(None).cast("timestamp").alias("last_seen_at"))
    top = boards.ranked(rows, {"w": 3}, 50)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and {x.ats: (x.n, x.least) for x in top.groupBy("ats").agg(F.count("*").alias("n"), F.min("last_job_count").alias("least")).collect()} == {"w": (3, 870), "g": (50, 845)}
