from datetime import date

from pyspark.sql import functions as F

from postloom.operators import discovery, profile


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


def test_expand_queries(spark):
    schema = "id string, roles array<string>, skills array<string>, cached_basis string, cached_queries array<string>, reply string"
    basis = one(spark, profile.basis_hash(lits("Dev"), lits("b", "a")))
    assert basis == one(spark, profile.basis_hash(lits("Dev"), lits("a", "b")))
    rows = [
        ("new", ["Dev"], ["a"], None, None, '```json\n["dev", " Java Developer ", "Coder"]\n```'),
        ("cached", ["Dev"], ["a", "b"], basis, ["Old"], '["x"]'),
        ("bad", ["Dev", "dev"], None, "other", ["Old"], "sorry"),
        ("none", None, ["a"], None, None, '["x"]'),
    ]
    got = {r.id: (r.queries, r.fresh) for r in profile.expand_queries(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"new": (["Dev", "Java Developer", "Coder"], True), "cached": (["Old"], False), "bad": (["Dev", "dev"], False), "none": ([], False)}


def test_insights(spark):
    terms = lits("spark", "Airflow", "c++", "")
    assert one(spark, profile.literal_keywords(F.lit("We use C++, AIRFLOW"), terms)) == ["Airflow", "c++"]
    reply = '{"keywords": [" SQL ", ""], "requirements": ["a", "b"], "company_signals": []}'
    got = one(spark, profile.insights(F.lit(reply), F.lit("spark"), terms))
    assert (got.keywords, got.requirements, got.company_signals) == (["SQL"], ["a", "b"], [])
    assert one(spark, profile.insights(F.lit("no json"), F.lit("spark"), terms)).keywords == ["spark"]
    assert one(spark, profile.insights(F.lit(reply), F.lit(None).cast("string"), terms)).keywords == []


def test_skills(spark):
    own = F.create_map(F.lit("tools"), lits("Git", "Make"), F.lit("languages"), lits("Go"))
    got = one(spark, profile.restore_skills(own, F.create_map(F.lit("tools"), lits("Git")), lits("make", "go", "rust")))
    assert got == {"tools": ["Git", "Make"], "languages": ["Go"]}
    assert one(spark, profile.restore_skills(F.lit(None).cast("map<string, array<string>>"), F.create_map(F.lit("tools"), lits("Git")), F.lit(None).cast("array<string>"))) == {"tools": ["Git"]}
    shown = one(spark, profile.labelled_skills(F.create_map(F.lit("soft_skills"), lits("x"), F.lit("ai_ml"), lits("y"), F.lit("tools"), lits(), F.lit("languages"), lits("z"))))
    assert [(s.label, list(s["items"])) for s in shown] == [("Languages", ["z"]), ("AI/ML", ["y"]), ("Soft Skills", ["x"])]


def test_summary_and_prompt(spark):
    assert one(spark, profile.accepted_summary(F.lit(f' "{"w" * 40}" '), F.lit("base"))) == "w" * 40
    assert one(spark, profile.accepted_summary(F.lit("short"), F.lit("base"))) == "base"
    assert one(spark, profile.accepted_summary(F.lit("w" * 801), F.lit("base"))) == "base"
    said = one(spark, profile.prompt(F.lit("Dev"), F.lit(None).cast("string"), F.lit("Ulm"), F.lit("d" * 5000), lits("A"), lits("b", "c")))
    assert said.startswith("Posting: Dev\nCompany: \nPlace: Ulm\n") and said.endswith("\n" + "d" * 4000)


def test_labels_and_previews(spark):
    calls = spark.createDataFrame([("j", 3, "b"), ("j", 1, "a"), ("j", 2, "b"), ("k", 1, "c")], "id string, seq int, label string")
    assert {r.id: r.labels for r in profile.labels_used(calls).collect()} == {"j": ["a", "b"], "k": ["c"]}
    schema = "id string, experience array<struct<role:string,title:string,company:string,start_date:string,end_date:string,years:double>>"
    rows = [("p", [("", "Dev", "Acme", "Jan 2020", "", None), (None, None, None, "2019", None, 2.5)]), ("q", None)]
    got = profile.role_previews(spark.createDataFrame(rows, schema), F.lit(date(2022, 1, 1))).orderBy("pos").collect()
    assert [(r.label, r.dates, r.years) for r in got] == [("Dev @ Acme", "Jan 2020", 2.0), ("? @ ?", "2019", 2.5)]


def test_cycle_counters(spark):
    rows = [(x,) for x in ("matched", "matched", "filtered_out", "rate_limited", "error", None)]
    got = profile.cycle_counters(spark.createDataFrame(rows, "result string")).first()
    assert tuple(got) == (5, 2, 2, 1, 1)


def test_discovery_keeps_order_and_caps(spark):
    postings = spark.createDataFrame(
        [("x", "https://boards.greenhouse.io/zeta", None, "see https://jobs.lever.co/acme"), ("lever", "https://jobs.lever.co/own", None, ""), (None, "https://boards.greenhouse.io/alpha", None, None)],
        "source string, url string, apply_url string, description string",
    )
    existing = spark.createDataFrame([("greenhouse", "Mine", 0)], "ats string, slug string, pos int")
    got = {(r.ats, r.slug): r["rank"] for r in discovery.discover(postings, existing).collect()}
    assert got == {("greenhouse", "Mine"): 1, ("greenhouse", "alpha"): 2, ("greenhouse", "zeta"): 3, ("lever", "acme"): 1}
    many = spark.range(40).select(F.lit("workday").alias("ats"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("slug"))
    assert sorted(r.slug for r in discovery.merge_found(existing, many).where("ats = 'workday'").collect()) == [f"s{k:02d}" for k in range(15)]
    lists = spark.createDataFrame([("| [Apply](https://jobs.ashbyhq.com/orbit) |",)], "value string")
    assert ("ashby", "orbit") in {(r.ats, r.slug) for r in discovery.harvest(lists, existing).collect()}


def test_validation(spark):
    configured = spark.createDataFrame([("a", "Acme Inc"), ("a", "gone"), ("a", "good"), ("a", "known"), ("a", "dead"), ("a", "untried"), ("a", "good")], "ats string, slug string")
    cache = spark.createDataFrame([("a", "known", "knew"), ("a", "dead", None)], "ats string, slug string, resolved string")
    probed = spark.createDataFrame([("a", "Acme Inc", False), ("a", "acme", True), ("a", "gone", False), ("a", "good", True)], "ats string, slug string, valid boolean")
    got = {r.slug: (r.resolved, r.status) for r in discovery.validate(configured, cache, probed).collect()}
    assert got == {"Acme Inc": ("acme", "fixed"), "gone": (None, "invalid"), "good": ("good", "ok"), "known": ("knew", "fixed"), "dead": (None, "invalid"), "untried": ("untried", "ok")}


def test_backfill_report(spark):
    scanned = spark.createDataFrame([("h", True, True, True), ("h", True, False, False), (None, False, None, None)], "host string, attempted boolean, resolved boolean, given boolean")
    found = spark.createDataFrame([("lever", "a", True), ("lever", "b", False), ("ashby", "a", None)], "ats string, slug string, sniffed boolean")
    got = discovery.backfill_report(scanned, found).first().asDict()
    assert got == {"jobs_scanned": 3, "hosts_seen": 1, "links_attempted": 2, "links_resolved": 1, "jobs_given_apply_url": 1, "boards_found": 3, "boards_sniffed": 1, "per_ats": {"ashby": 1, "lever": 2}}
    empty = discovery.backfill_report(scanned.limit(0), found.limit(0)).first()
    assert (empty.jobs_scanned, empty.boards_found, empty.per_ats) == (0, 0, {})
    posts = spark.createDataFrame([("lever", "a"), ("lever", "a"), (None, "b")], "ats string, slug string")
    assert [tuple(r) for r in discovery.yields(posts).collect()] == [("lever", "a", 2)]
