import pytest
from pyspark.sql import functions as F

from postloom.functions import dates, extract, regions, text


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*(c.alias(k) for k, c in columns.items())).collect()


def test_hash_collapses_spellings(spark):
    rows = [("Stripe, Inc.", "Sr. Engineer (Remote)", "San Francisco, CA"), ("Stripe", "Senior Engineer", "San Francisco"), ("Co", "Dev", None), ("Co Inc", "Developer", "")]
    a, b, c, d = (r.h for r in values(spark, rows, "c string, t string, l string", h=text.dedupe_hash("c", "t", "l")))
    assert a == b and c == d and a != c and len(a) == 32


@pytest.mark.parametrize(("title", "level"), [("Lead Designer", "senior"), ("Junior Dev", "entry"), ("entry-level role", "entry"), ("0-2 years", "entry"), ("Engineer", "mid"), (None, "mid"), ("Leader", "mid")])
def test_level(spark, title, level):
    assert values(spark, [(title,)], "t string", x=text.experience_level("t", F.lit("")))[0].x == level


def test_skills_are_quoted_and_bounded(spark):
    skills = ["java", "c++", "machine learning", "c#", "node.js", "java"]
    rows = [("javascript only",), ("Java and C++, node.js",), ("machine learning in C#",), (None,)]
    assert [r.n for r in values(spark, rows, "d string", n=text.skill_matches("d", skills))] == [0, 4, 2, 0]


def test_region_is_three_valued(spark):
    rows = [("Austin, TX",), ("Berlin, Germany",), ("Springfield",), ("",), (None,), ("Remote",)]
    p = regions.Preferences(("usa",), (), True)
    assert [r.a for r in values(spark, rows, "l string", a=regions.location_allowed(F.col("l"), F.lit(False), p))] == [True, False, None, None, None, True]


def test_preferences_from_legacy_text():
    assert regions.preferences(None, ["United States", "Remote", "Anywhere", "Lisbon area"]) == regions.Preferences(("usa",), ("Lisbon area",), True)
    assert regions.search_places(regions.Preferences()) == ["Remote", "United States"]
    assert regions.describe(regions.Preferences()) == "No restriction"


def test_months(spark):
    rows = [("Sep 2024",), ("Sep, 2024",), ("2024-09",), ("2024/9",), ("09/2024",), ("2022",), ("13/2024",), ("1500",), (None,), ("Present",), ("September 2024",)]
    got = values(spark, rows, "s string", m=dates.month(F.col("s"), F.lit("2026-01-02").cast("date")).cast("string"))
    assert [r.m for r in got] == ["2024-09-01"] * 5 + ["2022-07-01", None, None, None, "2026-01-02", "2024-09-01"]


def test_posted_at(spark):
    rows = [("1700000000",), ("2024-01-02T03:04:05Z",), ("2024-01-02",), ("Tue, 02 Jan 2024 03:04:05 +0000",), (None,), ("x",)]
    got = [r.p for r in values(spark, rows, "s string", p=dates.posted_at(F.col("s")).cast("string"))]
    assert got == ["2023-11-14 22:13:20", "2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None, None]


def test_relative_dates(spark):
    rows = [("Posted Today",), ("Posted Yesterday",), ("Posted 3 Days Ago",), ("Posted 30+ Days Ago",), (None,)]
    got = [r.d for r in values(spark, rows, "s string", d=dates.relative_date(F.col("s"), F.lit("2024-03-31").cast("date")).cast("string"))]
    assert got == ["2024-03-31", "2024-03-30", "2024-03-28", "2024-02-29", None]


def test_hosts(spark):
    rows = [("https://careers.acme.co.uk/x",), ("https://careers.com/",), ("https://boards.greenhouse.io/acme",), ("https://docs.google.com/a",), ("nonsense",), (None,)]
    h = extract.company_host(F.col("u"))
    got = values(spark, rows, "u string", h=h, s=extract.domain_slug(h))
    assert [(r.h, r.s) for r in got] == [("careers.acme.co.uk", "acme"), ("careers.com", None), (None, None), (None, None), (None, None), (None, None)]


def test_board_slugs(spark):
    page = "see https://boards.greenhouse.io/Acme and https://jobs.lever.co/api x https://nvidia.wd5.myworkdayjobs.com/en-US/Site_A/job https://boards.greenhouse.io/embed/job_board?for=beta"
    df = spark.createDataFrame([(1, page), (2, None)], "id int, t string")
    assert {tuple(r) for r in extract.board_slugs(df, "t", "id").collect()} == {(1, "greenhouse", "acme"), (1, "greenhouse", "beta"), (1, "workday", "nvidia:wd5:Site_A")}


def test_redirects(spark):
    base = "https://a.example/x"
    rows = [('<meta http-equiv="refresh" content="0;url=/y">',), ('<script>window.location.href = "https://b.example/z"</script>',), ("plain",), (None,)]
    got = [r.t for r in values(spark, rows, "h string", t=extract.redirect_target(F.col("h"), F.lit(base)))]
    assert got == ["https://a.example/y", "https://b.example/z", None, None]


def test_thread_header(spark):
    rows = [("Acme | Senior Engineer | Remote (US) | $150k",), ("Blaine, WA | Acme | Founding Engineer",), ("Just a line",), (None,)]
    got = [tuple(r.h) for r in values(spark, rows, "s string", h=extract.thread_header(F.col("s")))]
    assert got == [("Acme", "Senior Engineer"), ("Acme", "Founding Engineer"), ("Just a line", "Just a line"), ("", "")]


def test_candidate_slugs(spark):
    got = values(spark, [("Acme Labs Inc",), ("acme",), (None,)], "n string", s=extract.candidate_slugs(F.col("n")))
    assert [r.s for r in got] == [["acme", "acmelabsinc", "acme-labs-inc"], [], []]


def test_ordered_distinct_and_numbers(spark):
    row = spark.range(1).select(text.ordered_distinct(F.array(*map(F.lit, [" A", "b", "a ", "", "C"])), 2).alias("o"), text.numbers_in(F.lit("1,200 and 3.5 and 1200")).alias("n")).first()
    assert row.o == ["A", "b"] and row.n == ["1200", "3.5"]
