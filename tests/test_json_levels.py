"""JSON walked by levels against the recursive walk, and app state of result pages."""

import json
import random

from postloom.sources import json_levels, json_walk, payloads


def blob(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.2:
        return r.choice(["text", "", 5, 0, None, True, "https://x.example/1"])
    if kind < 0.45:
        return [blob(r, depth - 1) for _ in range(r.randint(0, 4))]
    node = {f"k{k}": blob(r, depth - 1) for k in range(r.randint(0, 3))}
    if kind > 0.6:
        node |= {r.choice(("title", "name")): r.choice(("Dev", "", "Cook remote")), r.choice(("url", "jobUrl", "applyUrl")): r.choice(("https://x.example/j", "https://y.example/j", ""))}
        node |= r.choice(({}, {"id": 7, "company": "Acme", "location": "Rome"}, {"startup": {"name": "Inc"}, "remote": True}, {"company": {"name": "no text"}, "locationStr": "Remote, EU", "description": "d"}))
    return node


def test_levels_find_what_the_recursive_walk_finds(spark):
    r = random.Random(5)
    rows = [(k, json.dumps(blob(r, r.randint(0, 8)))) for k in range(300)] + [(900, "{broken"), (901, None), (902, "[" * 11 + '{"title":"a","url":"x.example"}' + "]" * 11), (903, "[" * 10 + '{"title":"a","url":"x.example"}' + "]" * 10)]
    df = spark.createDataFrame(rows, "k int, payload string").repartition(3)
    columns = ["source_job_id", "title", "company", "location", "is_remote", "url", "description", "experience_level"]
    want = sorted(map(tuple, json_walk.walk(df, "x.example", "s").select(*columns).collect()))
    got = json_levels.postings_in(df, "x.example", "s", ("k",))
    assert len(want) > 80 and sorted(map(tuple, got.select(*columns).collect())) == want
    assert {x.k for x in got.where("k >= 900").collect()} == {903}
    assert json_levels.postings_in(df.limit(0), "x.example", "s").count() == 0


def test_app_state_comes_between_json_ld_and_links(spark):
    state = {"a": [{"title": " Dev ", "id": 1, "company": {"name": "Acme"}, "location": "Remote", "summary": "<p>fine</p>", "more": {"jobTitle": "Cook", "jobId": "2", "companyName": "Inc"}}, {"title": "again", "guid": 1, "company": "Acme"}, {"title": "no company", "id": 3}]}
    script = lambda s: f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(s)}</script>'
    link = '<a href="/job-detail/9">Linked role</a>'
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Stated", "url": "/job-detail/5"}</script>'
    pages = spark.createDataFrame([("https://www.dice.com/1", script(state) + link), ("https://www.dice.com/2", script({"a": []}) + link), ("https://www.dice.com/3", ld + script(state) + link), ("https://www.dice.com/4", None)], "url string, payload string")
    got = sorted((r.title, r.company, r.location, r.is_remote, r.url, r.description) for r in payloads.FAMILIES["dice"](pages).collect())
    at = "https://www.dice.com/job-detail/"
    assert got == [("Cook", "Inc", "", False, f"{at}2", ""), ("Dev", "Acme", "Remote", True, f"{at}1", "fine"), ("Linked role", "", "", False, f"{at}9", ""), ("Stated", "", "", False, f"{at}5", "")]
