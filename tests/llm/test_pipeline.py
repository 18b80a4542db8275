"""The pipeline's stages on a planted corpus."""

import random

import corpus_pipeline


def planted(spark, folder):
    r = random.Random(9)
    syllables = ["ka", "lo", "mi", "ten", "ur", "sha", "er", "on", "st"]
    sentence = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        text = sentence(r.randint(20, 90))
        if i % 5 == 0:
            text += " zorghka and zorghmi are zorghten"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    item = sentence(30)
    base = rows[1][1]
    rows += [(1000, base, "en", "s", len(base)), (1001, base + " extra", "en", "s", 0), (1002, sentence(20) + " " + item + " " + sentence(20), "en", "s", 0), (1003, sentence(30) + " write to a.b@c.org now", "en", "s", 0)]
    rows += [(1004, None, None, None, None), (1005, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert k == 4 or docs.columns == columns
    everything, toxic = {r[0] for r in rows}, {i for i in range(600) if i % 5 == 0}
    assert len((everything - kept[0]) ^ toxic) <= 4
    assert kept[0] - kept[1] == {1000, 1001} and kept[1] - kept[2] == {1002} and kept[3] == kept[2] == kept[4]
    told = spark.read.parquet(f"{folder}/3").where("doc_id = 1003").first()
    assert "[EMAIL]" in told.text and "@" not in told.text and told.n_chars == len(told.text)


def test_run(spark, tmp_path):
    planted(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[0] == "doc_id" and out.count() > 400


def test_run_as_by_brute_force(spark, tmp_path):
    """Every stage redone in plain Python from the whole documents; only the fitted classifier's decisions are taken over."""
    from test_training_operators import base_spans, components_of, library, shingled

    from postloom.llm import toxicity

    folder = str(tmp_path)
    planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}
    components = components_of(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if components[i][1] == i}
    items = [shingled(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(100 * len(shingled(t) & x) >= 80 * len(x) for x in items)}
    lib, want = library(), {}
    for i, t in kept.items():
        for a, kind, b in reversed(base_spans(t or "")):
            t = t[:a] + f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[kind - 1]}]" + t[b:]
        want[i] = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {x.doc_id: x.doc_tokens for x in pieces} == {i: len(x) for i, x in want.items()}
    assert sum(x.length for x in pieces) == sum(map(len, want.values()))  # each id in one piece
