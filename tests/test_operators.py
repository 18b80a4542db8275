import json
import random

from pyspark.sql import functions as F

from postloom.functions.regions import Preferences
from postloom.operators import applications, assemble, boards, cascade, compare, history, links, resolve, score, search
from postloom.sources import json_walk, payloads



def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")

POSTING = "key string, seq long, source string, source_job_id string, url string, apply_url string, description string, dedupe_hash string, posted_at timestamp"


def restated(rows):
    """The sequential merge, plainly."""
    kept, out = [], {}
    for k, _, source, jid, url, _, text, h, _ in sorted(rows, key=lambda r: r[1]):
        hit = next((("u", p) for p in kept if url and url in p["urls"]), None) or next((("i", p) for p in kept if jid and (source, jid) == p["id"]), None) or next((("h", p) for p in kept if p["h"] == h), None)
        if hit is None:
            kept.append({"key": k, "urls": [url], "id": (source, jid), "h": h, "text": text})
            out[k] = ("inserted", k)
        elif hit[0] == "h":
            if url not in hit[1]["urls"]:
                hit[1]["urls"].append(url)
            hit[1]["text"] = max(hit[1]["text"], text, key=len)
            out[k] = ("merged", hit[1]["key"])
        else:
            out[k] = ("skipped", hit[1]["key"])
    return out


def test_merge_equals_the_sequential_rule(spark):
    r = random.Random(4)
    rows = [(f"k{i:03d}", i, r.choice("ab"), r.choice(["", "1", "2", "3", f"x{i}"]), f"u{r.randint(0, 60)}", None, "d" * r.randint(0, 9), f"h{r.randint(0, 50)}", None) for i in range(120)]
    got = resolve.merge(spark.createDataFrame(rows, POSTING).repartition(3), now(), 30)
    assert {x.key: (x.outcome, x.keeper) for x in got.collect()} == restated(rows)


def replayed(rows, existing=()):
    """The sequential merge with all fields, existing rows first: {key: (outcome, keeper, source_urls, description, apply_url)}."""
    kept, by, out = {}, {}, []
    for k, _, source, jid, url, apply, text, h, urls in [*sorted(existing, key=lambda r: r[1]), *sorted(rows, key=lambda r: r[1])]:
        old = urls is not None
        probes = [("u", u) for u in (urls if old else [url]) if u] + ([("i", source, jid)] if jid else []) + [("h", h)]
        found = None if old else next(((p[0], by[p]) for p in probes if p in by), None)
        if found is None:
            kept[k] = [list(urls) if old else [url], text, apply]
            for p in probes:
                by.setdefault(p, k)
            out.append((k, "existing" if old else "inserted", k))
            continue
        own = kept[found[1]]
        own[2] = own[2] or apply
        if found[0] == "h":
            if url not in own[0]:
                own[0].append(url)
                by.setdefault(("u", url), found[1])
            own[1] = max(own[1], text, key=lambda x: len(x or ""))
        out.append((k, "merged" if found[0] == "h" else "skipped", found[1]))
    return {k: (o, keeper, *kept[keeper]) for k, o, keeper in out if o != "existing"}


def test_merge_of_hot_and_mixed_keys_with_existing_rows(spark):
    r = random.Random(7)

    def made(n, name, at):
        return [(f"{name}{i:03d}", at + i, r.choice("ab"), r.choice(["", "", "1", "2", f"x{i}"]), r.choice([f"u{r.randint(0, 70)}", f"v{i}", "", "hot"]), r.choice([None, "", f"apply{i}"]), "d" * r.randint(0, 9) + str(i % 3), r.choice(["hot", f"h{r.randint(0, 60)}"]), None) for i in range(n)]

    rows = made(400, "k", 100)
    old = [(*x[:4], None, *x[5:8], [x[4], f"u{r.randint(0, 90)}"]) for x in made(25, "e", 0)]
    existing = spark.createDataFrame([x[:8] + (None, x[8]) for x in old], POSTING + ", source_urls array<string>")
    for have, want in ((None, replayed(rows)), (existing, replayed(rows, old))):
        got = resolve.merge(spark.createDataFrame(rows, POSTING).repartition(5), now(), 30, have).collect()
        assert len(got) == 400 and {x.key: (x.outcome, x.keeper, x.source_urls, x.description, x.apply_url) for x in got} == want


def test_replay_gives_fields_and_urls_once(spark):
    rows = [(f"k{i:03d}", i, "s", "", f"u{i // 2}", "apply" if i == 7 else None, "d" * (i % 11), "hot", None) for i in range(400)]
    old = spark.createDataFrame([("e", -1, "t", "9", None, None, "dd", "hot", None, ["x1", "x0"])], POSTING + ", source_urls array<string>")
    for existing, own in ((None, []), (old, ["x1", "x0"])):
        found, keepers, urls = resolve.replay(spark.createDataFrame(rows, POSTING).repartition(3), now(), 30, existing)
        keeper = "e" if own else "k000"
        assert {x.outcome: x.n for x in found.groupBy("outcome").agg(F.count("*").alias("n")).collect()} == ({"merged": 200, "skipped": 200} if own else {"inserted": 1, "merged": 199, "skipped": 200})
        assert [tuple(x) for x in keepers.collect()] == [(keeper, "d" * 10, "apply")]
        assert [x.url for x in urls.orderBy("seq", "pos").collect()] == own + [f"u{i}" for i in range(200)]


def tangled(seed, n, spread):
    """Postings whose keys tie them into one component, in a random order of arrival."""
    r = random.Random(seed)
    pick = lambda c: f"{c}{r.randrange(n // spread)}"
    return [(f"k{i:06d}", i, r.choice("ab"), r.choice(["", pick("j"), pick("j")]), r.choice(["", pick("u"), pick("u"), pick("u")]), None, "d" * r.randint(0, 9), r.choice([pick("h"), f"own{i}"]), None) for i in range(n)]


def test_waves_and_bounded_replays_settle_a_large_component(spark, monkeypatch):
    rows = tangled(3, 150, 2)
    chain = [(f"c{i:03d}", 1000 + i, "s", f"c{i // 2}", f"c{(i + 1) // 2}", None, "", f"c{i}", None) for i in range(40)]
    monkeypatch.setattr(resolve, "REPLAY_ROWS", 60)
    got = resolve.merge(spark.createDataFrame(rows + chain, POSTING).repartition(3), now(), 30)
    assert {x.key: (x.outcome, x.keeper) for x in got.collect()} == {k: v[:2] for k, v in replayed([(*x[:8], None) for x in rows + chain]).items()}


def test_waves_see_existing_rows(spark, monkeypatch):
    monkeypatch.setattr(resolve, "REPLAY_ROWS", 60)
    rows = tangled(5, 150, 3)
    old = [(*x[:4], None, *x[5:8], [x[4], f"u{k}"]) for k, x in enumerate((f"e{y[0]}", y[1] - 1000, *y[2:]) for y in tangled(6, 30, 1))]
    existing = spark.createDataFrame([x[:8] + (None, x[8]) for x in old], POSTING + ", source_urls array<string>")
    got = resolve.merge(spark.createDataFrame(rows, POSTING).repartition(3), now(), 30, existing).collect()
    assert {x.key: (x.outcome, x.keeper) for x in got} == {k: v[:2] for k, v in replayed([(*x[:8], None) for x in rows], old).items()}


def test_merge_replays_only_first_rows_of_key_combinations(spark, monkeypatch):
    whole = resolve.settle

    def few(rows):
        assert len(rows) <= 3
        return whole(rows)

    monkeypatch.setattr(resolve, "settle", few)
    rows = [(f"k{i:03d}", i, "s", "", f"u{i}", None, "", "hot", None) for i in range(600)] + [("m", 700, "s", "", "hot", None, "", "hot", None)] + [(f"l{i:03d}", 900 + i, "s", "", "hot", None, "", f"g{i}", None) for i in range(600)]
    got = resolve.merge(spark.createDataFrame(rows, POSTING), now(), 30).groupBy("outcome", "keeper").count().collect()
    assert {tuple(x) for x in got} == {("inserted", "k000", 1), ("merged", "k000", 600), ("skipped", "k000", 600)}


def test_components_follow_a_chain_of_200_postings(spark):
    rows = [(f"k{i:03d}", i, "s", f"j{i // 2}", f"u{(i + 1) // 2}", None, "", f"h{i}", None) for i in range(200)]
    got = resolve.components(spark.createDataFrame(rows, POSTING).repartition(3)).collect()
    assert len(got) == 200 and {x.component for x in got} == {"k000"}


def test_merge_keeps_longer_text_all_urls_and_stale(spark):
    from datetime import datetime

    rows = [("a", 0, "s", "1", "u1", None, "short", "h", None), ("b", 1, "t", "9", "u2", "apply", "a longer text", "h", None), ("c", 2, "s", "1", "u3", None, "", "z", None), ("d", 3, "s", "7", "u9", None, "", "y", datetime(2024, 4, 1))]
    got = {x.key: x for x in resolve.merge(spark.createDataFrame(rows, POSTING), now(), 30).collect()}
    assert [got[k].outcome for k in "abcd"] == ["inserted", "merged", "skipped", "stale"]
    assert got["a"].source_urls == ["u1", "u2"] and got["a"].description == "a longer text" and got["a"].apply_url == "apply"


def test_remerge_keeps_first_and_used(spark):
    rows = [("1", "h", 5, ["a"]), ("2", "h", 3, ["b"]), ("3", "h", None, ["c"]), ("4", "g", 1, ["d"])]
    df = spark.createDataFrame(rows, "id string, dedupe_hash string, fetched_at int, source_urls array<string>")
    got = {r.id: (r.dedupe_hash, r.source_urls) for r in resolve.remerge(df, spark.createDataFrame([("3",)], "job_id string")).collect()}
    assert got == {"2": ("h", ["a", "b", "c"]), "3": ("h-3", ["c"]), "4": ("g", ["d"])}


def test_cascade_order(spark):
    p = cascade.Profile(("software engineer",), ("python", "spark"), ("Evil",), Preferences(("usa",), (), True))
    rows = [("Nurse", "x", "", False, ""), ("Senior Engineer", "x", "", False, ""), ("Engineer", "x", "Berlin, Germany", False, ""), ("Engineer", "EVIL", "Austin, TX", False, ""), ("Engineer", "x", "", False, None), ("Engineer", "x", "", False, "python only"), ("Engineer", "x", "", False, "python, spark")]
    got = cascade.evaluate(spark.createDataFrame(rows, "title string, company string, location string, is_remote boolean, description string"), p).select("outcome.*").collect()
    assert [r.reason for r in got] == ["title_mismatch", "seniority", "location", "excluded_company", "no_description", "few_skills", None]
    assert got[-1].passed and got[-1].score == 1.0


def test_cascade_words_of_any_script_and_resembling_titles(spark):
    p = cascade.Profile(("software engineer", "le chef"))
    titles = ["sofware enginer", "Ingénieur chef", "achefé", "échef", "chefe\u0301", "Sr. chef", "ésr chef", "srë chef", "chef «lead»", "漢lead chef", "boulanger", None]
    rows = [(t, "Co", "", False, "") for t in titles]
    got = cascade.evaluate(spark.createDataFrame(rows, "title string, company string, location string, is_remote boolean, description string"), p).select("title", "outcome.reason").collect()
    no, senior = "title_mismatch", "seniority"
    assert [x.reason for x in got] == [None, None, no, no, no, senior, None, None, senior, None, no, no] and [x.title for x in got] == titles


def test_gate(spark):
    df = spark.createDataFrame([(82, True), (82, False), (10, False), (70, None)], "s int, f boolean").select(cascade.gate(F.col("s"), F.col("f"), 70).alias("g")).select("g.*")
    assert [(r.llm_score, r.status) for r in df.collect()] == [(82, "matched"), (67, "filtered_out"), (0, "filtered_out"), (70, "matched")]


def test_boards_retire_and_rank(spark):
    schema = "ats string, slug string, origin string, active boolean, consecutive_empty int, last_job_count long, total_job_count long, last_seen_at timestamp, last_fetched_at timestamp"
    rows = [("g", "a", "discovered", True, 7, 1, 1, None, None), ("g", "b", "seed", True, 7, 1, 1, None, None), ("g", "c", "discovered", True, 3, 0, 0, None, None)]
    polled = spark.createDataFrame([("g", "a", 0, False), ("g", "b", 0, False), ("g", "c", 4, False)], "ats string, slug string, jobs long, had_errors boolean")
    out = boards.record_results(spark.createDataFrame(rows, schema), polled, now())
    assert {r.slug: (r.active, r.consecutive_empty, r.total_job_count) for r in out.collect()} == {"a": (False, 8, 1), "b": (True, 8, 1), "c": (True, 0, 4)}
    assert [r.slug for r in boards.ranked(out, {"g": 1}).orderBy("rank").collect()] == ["c"]


def test_history(spark):
    spans = spark.createDataFrame([(1, "2020-01-01", "2020-06-01"), (1, "2020-06-01", "2021-01-01"), (1, "2022-01-01", "2023-01-01"), (1, None, "2023-01-01")], "p int, start string, end string").select("p", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    assert history.total_years(spans, "p").first().years == 2.0
    runs = spark.createDataFrame([(i, i // 2) for i in range(10)], "run_id int, started_at int")
    kept, sources = history.prune(runs, runs.select("run_id"), 3)
    assert kept.count() == 2 and sources.count() == 2
    rows = [(True, 0, 1), (True, 0, 0), (True, 5, 0), (True, 5, 1), (False, 5, 1)]
    df = spark.createDataFrame(rows, "e boolean, c int, x int").select(history.source_status(F.col("e"), F.col("c"), F.col("x")).alias("s"))
    assert [r.s for r in df.collect()] == ["failed", "empty", "ok", "partial", "disabled"]


def test_compare(spark):
    df = spark.createDataFrame([(1, "a", 80, "ok"), (1, "b", 60, "ok"), (2, "a", None, "unreadable"), (2, "b", 90, "ok")], "id int, model string, score int, status string")
    assert {r.model: (r.scored, r.average, r.unreadable) for r in compare.summarize(df).collect()} == {"a": (1, 80.0, 1), "b": (2, 75.0, 0)}
    assert [tuple(r) for r in compare.flips(df, "a", "b", 70).collect()] == [(1, 80, 60, "lost")]


def test_search_sorts_nulls_and_ignores_bad_parameters(spark):
    rows = [("1", "A", "x", 50, "new"), ("2", "B_c", "y", None, "new"), ("3", "Bxc", "z", 90, "gone")]
    df = spark.createDataFrame(rows, "id string, title string, company string, llm_score int, status string").withColumns({"location": F.lit(None).cast("string"), "is_remote": F.lit(False), "posted_at": F.lit(None).cast("timestamp"), "fetched_at": F.lit(None).cast("timestamp")})
    ids = lambda **q: [r.id for r in search.page(df, search.Query(**q)).collect()]
    assert ids() == ["1", "2"] and ids(sort="score_asc") == ["2", "1"] and ids(min_score="x") == ["1", "2"] and ids(min_score="40") == ["1"] and ids(text="b_") == ["2"]


def test_replies(spark):
    said = ['Sure ```json\n{"score": "82.9", "seniority_fit": false}``` ok', "no json", '{"score": 150}', '{"reasoning": "x"}', None]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(score.parse_reply(score.reply_object(F.col("s"))).alias("r")).select("r.*").collect()
    assert [(r.score, r.status, r.seniority_fit) for r in got] == [(82, "ok", False), (None, "unreadable", True), (100, "ok", True), (None, "unreadable", True), (None, "unreadable", True)]


def test_balanced_json_parses_the_replies_of_long_conversations(spark, tmp_path):
    from postloom.plans.catalogue import QUERIES

    spark.createDataFrame([(1, k) for k in (1, 10, 11, 25)], "conv_id long, turn int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["balanced_json"](spark, str(tmp_path)).collect()
    assert sorted((x.turn, x.score, x.status) for x in got) == [(1, 10, "ok"), (10, 100, "ok"), (11, 100, "ok"), (25, 100, "ok")]


def test_grounding(spark):
    row = spark.range(1).select(assemble.ground(F.array(F.lit("cut 30%"), F.lit("led 9 people"), F.lit("new 5")), F.array(F.lit("saved 30%"), F.lit("led a team"))).alias("b")).first()
    assert row.b == ["cut 30%", "led a team"]


def landed(spark, payload, **context):
    row = {"payload": json.dumps(payload) if not isinstance(payload, str) else payload, "slug": "acme", "location": "Paris", "url": "https://a.example/", "seq": 1} | context
    return spark.createDataFrame([row])


def test_sources(spark):
    r = payloads.greenhouse(landed(spark, {"jobs": [{"id": 1, "title": "Senior Dev", "location": {"name": "Remote"}, "absolute_url": "u", "content": "<p>x</p>", "updated_at": "2024-01-01T00:00:00Z"}]})).first()
    assert (r.source, r.source_job_id, r.company, r.is_remote, r.experience_level) == ("greenhouse", "1", "acme", True, "senior")
    rows = payloads.ashby(landed(spark, {"jobs": [{"id": "1", "title": "A", "isListed": False}, {"id": "2", "title": "B", "jobUrl": "u", "isRemote": True}]})).collect()
    assert [(x.source_job_id, x.is_remote) for x in rows] == [("2", True)]
    day = {"jobPostings": [{"title": "T", "externalPath": "/p", "postedOn": "Posted Yesterday"}, {"title": "T2", "externalPath": "/p"}]}
    r = payloads.workday(landed(spark, day, slug="t:wd5:Site"), None, F.lit("2024-03-02").cast("date")).collect()
    assert [(x.title, x.posted_at_raw, x.url) for x in r] == [("T", "2024-03-01", "https://t.wd5.myworkdayjobs.com/Site/p")]
    feed = "<rss><channel><item><title>Acme: Data Engineer</title><link>l1</link><description>&lt;b&gt;x&lt;/b&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>"
    r = payloads.weworkremotely(landed(spark, feed)).first()
    assert (r.company, r.title, r.is_remote) == ("Acme", "Data Engineer", True)
    page = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Acme"},"jobLocation":[{"address":{"addressLocality":"Rome","addressRegion":"IT"}}]}]}</script><script type="application/ld+json">{broken</script>'
    r = payloads.json_ld(landed(spark, page)).collect()
    assert [(x.title, x.company, x.location) for x in r] == [("Dev", "Acme", "Rome, IT")]
    cards = '<li><a href="https://www.linkedin.com/jobs/view/dev-12345678?x"></a><h3 class="base-search-card__title">Dev</h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4></li><li>none</li>'
    r = payloads.linkedin(landed(spark, cards)).collect()
    assert [(x.source_job_id, x.title, x.company) for x in r] == [("12345678", "Dev", "Acme")]
    thread = {"children": [{"id": "9", "created_at": "2024-01-01T00:00:00Z", "text": "Acme | Engineer | Remote<p>More"}, {"id": "8", "text": None}]}
    assert [(x.company, x.title, x.location) for x in payloads.hnhiring(landed(spark, thread)).collect()] == [("Acme", "Engineer", "Remote")]
    for name in ("adzuna", "jsearch", "lever", "smartrecruiters", "workable", "recruitee", "jooble", "careerjet", "findwork", "remotive", "arbeitnow", "remoteok", "themuse", "himalayas", "jobicy"):
        assert payloads.FAMILIES[name](landed(spark, "{broken")).columns == list(payloads.RAW_COLUMNS)
        assert payloads.FAMILIES[name](landed(spark, "{broken")).count() == 0, name


def test_stream_equals_batch(spark, tmp_path):
    from postloom.streaming import cycle

    (tmp_path / "in").mkdir()
    jobs = {"jobs": [{"id": k, "title": f"Role {k % 2}", "company": "Acme", "location": "Rome", "link": f"u{k}", "snippet": "x" * k} for k in range(4)]}
    (tmp_path / "in/a.json").write_text(json.dumps({"payload": json.dumps(jobs), "slug": "", "location": "", "url": "", "seq": 1}))
    for _ in range(2):
        cycle.run_available(spark, str(tmp_path / "in"), "jooble", str(tmp_path / "out"), str(tmp_path / "cp"), now(), 30)
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("outcome").count()
    assert {r.outcome: r["count"] for r in out.collect()} == {"inserted": 2, "merged": 2}


def test_stream_finds_postings_of_earlier_batches(spark, tmp_path):
    from postloom.streaming import cycle

    def land(name, *jobs):
        jobs = {"jobs": [{"id": i, "title": t, "company": "Acme", "location": "Rome", "link": u, "snippet": s} for i, t, u, s in jobs]}
        (tmp_path / f"in/{name}.json").write_text(json.dumps({"payload": json.dumps(jobs), "slug": "", "location": "", "url": "", "seq": 1}))
        cycle.run_available(spark, str(tmp_path / "in"), "jooble", str(tmp_path / "out"), str(tmp_path / "cp"), now(), 30)

    (tmp_path / "in").mkdir()
    land("a", ("z", "Dev", "u1", "short"), ("a", "Dev", "u2", "a longer text"), ("b", "Cook", "u3", ""))
    land("b", ("y", "Dev", "u4", "the longest text of all"), ("b", "Chef", "u5", ""), ("q", "Nurse", "u6", ""), ("n", "Other", "u1", ""))
    out = {(r.batch, r.outcome): r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch", "outcome").count().collect()}
    assert out == {(0, "inserted"): 2, (0, "merged"): 1, (1, "merged"): 1, (1, "skipped"): 2, (1, "inserted"): 1}
    known = {r.title: r for r in spark.read.parquet(str(tmp_path / "out-known/batch=1")).collect()}
    assert set(known) == {"Dev", "Cook", "Nurse"} and known["Dev"].source_urls == ["u1", "u2", "u4"] and known["Dev"].description == "the longest text of all"
    assert known["Dev"].source_job_id == "z"  # it came first, though its id sorts last
    batch = spark.read.schema("payload string, slug string, location string, url string, seq long").json(str(tmp_path / "in/b.json"))
    again = cycle.conform(batch, "jooble", 1)  # a replayed batch has the same keys
    assert {r.key for r in again.collect()} == {r.key for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()}


def test_title_matches_by_word_or_ratio(spark):
    df = spark.createDataFrame([("Software Engineer",), ("Sofware Enginer",), ("Nurse",), (None,), ("Nurse",)], "title string")
    got = cascade.title_matches(df, ("software engineer",)).collect()
    assert sorted((r.title or "", r.title_ok) for r in got) == [("", False), ("Nurse", False), ("Nurse", False), ("Software Engineer", True), ("Sofware Enginer", True)]


def test_links(spark):
    rows = [("https://jooble.org/away/1", 1, None), ("https://jooble.org/away/1", 2, "kept"), ("https://a.example/x", 3, None), ("https://x.y/redirect?u=1", 4, None)]
    df = spark.createDataFrame(rows, "url string, seq int, apply_url string")
    work = links.to_resolve(df, spark.createDataFrame([("https://x.y/redirect?u=1",)], "u string"), 5)
    assert [(r.url, r.chosen) for r in work.collect()] == [("https://jooble.org/away/1", True)]
    back = links.apply_resolved(df, spark.createDataFrame([("https://jooble.org/away/1", "t")], "url string, target string"))
    assert {r.seq: r.apply_url for r in back.collect()} == {1: "t", 2: "kept", 3: None, 4: None}
    many = spark.range(20).withColumnRenamed("id", "seq")
    assert links.within_budget(many, 7, "seq").where("chosen").count() == 7 and links.within_budget(many.limit(0), 7, "seq").count() == 0
    page = spark.createDataFrame([("Just a moment...", "x"), ("Jobs", "all fine"), (None, None)], "t string, b string")
    assert [r.c for r in page.select(links.is_challenge(F.col("t"), F.col("b")).alias("c")).collect()] == [True, False, False]


def test_hosts_to_sniff(spark):
    rows = [("https://acme.io/a", "Acme", 2), ("https://acme.io/b", "Other", 1), ("https://beta.io/", "Beta", 3), ("https://jobs.lever.co/x", "L", 4)]
    cache = spark.createDataFrame([("beta.io", True, None)], "host string, found boolean, at timestamp")
    got = links.hosts_to_sniff(spark.createDataFrame(rows, "url string, company string, seq int"), cache, now()).collect()
    assert [(r.host, r.company) for r in got] == [("acme.io", "Other")]


def test_applications(spark):
    jobs = spark.createDataFrame([("1", "matched"), ("2", "matched"), ("3", "new")], "id string, status string")
    made = spark.createDataFrame([("a", "1", 5), ("b", "1", 4)], "id string, job_id string, created_at int")
    assert {r.id: r.application_id for r in applications.with_application(jobs, made).collect()} == {"1": "b", "2": None, "3": None}
    assert [r.job_id for r in applications.missing_applications(jobs, made, now()).collect()] == ["2"]
    papers = spark.createDataFrame([("a", "resume", 1), ("a", "resume", 2)], "application_id string, type string, version int")
    assert {r.id: r.resume_version for r in applications.with_current_documents(made, papers).collect()} == {"a": 2, "b": None}


def test_history_facts(spark):
    outcomes = spark.createDataFrame([("inserted",), ("merged",), ("stale",)], "outcome string")
    sources = spark.createDataFrame([("x", 0, 1, True)], "source string, count int, n_errors int, enabled boolean")
    row = history.run_facts(outcomes, sources, spark.createDataFrame([(True,), (False,)], "active boolean")).first()
    assert (row.fetched, row.inserted, row.stale, row.status, row.boards_polled) == (3, 1, 1, "partial", 1)
    names = spark.createDataFrame([("x",), ("y",)], "source string")
    assert {r.source: r.enabled for r in history.with_skipped(sources, names, ["x"]).collect()} == {"x": True, "y": False}
    errors = spark.createDataFrame([("x", 3, "b"), ("x", 1, "a"), ("x", 2, "a"), ("x", 4, "c")], "source string, seq int, message string")
    assert history.capped_errors(errors, 2).first().errors == ["a", "b"]
    polls = spark.createDataFrame([("g", "a", 1, 0), ("g", "a", 2, 3), ("g", "a", 3, 0), ("g", "b", 1, 0), ("g", "c", 1, 2)], "ats string, slug string, at int, jobs int")
    assert {r.slug: r.consecutive_empty for r in history.empty_runs(polls).collect()} == {"a": 1, "b": 1, "c": 0}


def test_report_and_walk(spark):
    jobs = spark.createDataFrame([(1, "Dev", "Acme")], "id int, title string, company string")
    scores = spark.createDataFrame([(1, "a", 80, "ok"), (1, "b", 60, "ok")], "id int, model string, score int, status string")
    said = compare.report(jobs, scores, ["a", "b"], 70)
    assert "Dev @ Acme" in said and "80 to 60 (lost)" in said
    blob = json.dumps({"a": [{"title": "Dev", "url": "https://x.example/1", "startup": {"name": "Acme"}, "inner": {"title": "no", "url": "https://x.example/2"}}, {"name": "n", "url": "https://other/"}]})
    got = json_walk.walk(spark.createDataFrame([(blob,), ("{broken",), (None,)], "payload string"), "x.example", "s").collect()
    assert [(r.title, r.company) for r in got] == [("Dev", "Acme")]


def test_scorers_fail_over_within_a_budget(spark):
    def refuses(prompt):
        raise TimeoutError(prompt)

    jobs = spark.createDataFrame([(str(k), "ok" if k % 2 else "hard") for k in range(6)], "id string, prompt string")
    got = {r.id: (r.reply, r.scorer) for r in score.run_scorers(jobs, [refuses, lambda p: "free" if p == "ok" else None], [lambda p: "paid"], 3).collect()}
    assert got == {"0": ("paid", "paid0"), "1": ("free", "free1"), "2": ("paid", "paid0"), "3": ("free", "free1"), "4": (None, None), "5": ("free", "free1")}
    assert all(r.reply for r in score.run_scorers(jobs, [refuses], [lambda p: p]).collect())


def test_linkedin_details_and_cards_without_an_id(spark):
    card = '<li><a href="https://www.linkedin.com/jobs/view/{}?x">a</a><h3 class="base-search-card__title x">T <b>{}</b></h3></li>'
    pages = spark.createDataFrame([(2, card.format("a-10000001", 1) + card.format("b", 2)), (1, card.format("a-10000001", 0) + card.format("b", 3) + card.format("c-10000002", 4))], "seq long, payload string")
    details = spark.createDataFrame([("10000001", "<main><div class='description__text'>One<br>two</div></main>"), ("10000002", "<div class='description__text'>late</div></main>")], "id string, payload string")
    got = sorted((r.source_job_id or "", r.title, r.description) for r in payloads.linkedin(pages, details, 1).collect())
    assert got == [("", "T 2", ""), ("", "T 3", ""), ("10000001", "T 0", "One\ntwo"), ("10000002", "T 4", "")]


def test_backfill_from_stored_postings(spark, tmp_path):
    from postloom import backfill

    rows = [("jooble", "https://jooble.org/away/1", "https://jobs.lever.co/acme/1", ""), ("lever", "https://jobs.lever.co/own/2", None, ""), ("x", "https://a.example/1", None, "see https://jobs.lever.co/known")]
    spark.createDataFrame(rows, "source string, url string, apply_url string, description string").write.parquet(str(tmp_path / "postings"))
    spark.createDataFrame([("lever", "known", 0)], "ats string, slug string, pos int").write.parquet(str(tmp_path / "boards"))
    paths = [str(tmp_path / x) for x in ("postings", "boards", "out")]
    report = backfill.main([*paths, "--dry-run"], spark)
    assert report["boards_found"] == 1 and report["jobs_scanned"] == 3 and not (tmp_path / "out").exists()
    backfill.main(paths, spark)
    assert {(r.ats, r.slug) for r in spark.read.parquet(paths[2]).collect()} == {("lever", "known"), ("lever", "acme")}


def test_pages_without_structured_data_give_their_links(spark):
    ld = '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev","url":"/jobs/9"}</script><a href="/jobs/1">Not this</a>'
    bare = '<a class=x href="/jobs/1-dev"><b>Data</b>\n Dev</a><a href="/jobs/2">Data Dev</a><a href="/about">About us</a><a href="/jobs/3">ab</a><A HREF=\'/job-detail/4\'>Cook</A>'
    pages = spark.createDataFrame([("https://p.example/1", ld), ("https://p.example/2", bare), ("https://p.example/3", None)], "url string, payload string")
    got = sorted((r.title, r.url) for r in payloads.FAMILIES["wellfound"](pages).collect())
    assert got == [("Data Dev", "https://wellfound.com/jobs/1-dev"), ("Dev", "https://p.example/jobs/9")]
    assert [(r.title, r.url) for r in payloads.FAMILIES["dice"](pages.where("url like '%2'")).collect()] == [("Cook", "https://www.dice.com/job-detail/4")]
