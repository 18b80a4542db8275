"""Each operator against a brute-force version, with nulls, blanks, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import decontamination, embedding_dedup, html_blocks, html_extraction, ngram_jaccard, packing, pii, shingles, token_counts, tokenizer_fst, toxicity, url_filter, warc

CLASH = ("n_shingles", "component_id", "node", "score", "_text", "k1", "page_id2", "start", "sequence_id", "h1", "kind", "label2", "said")
DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingled(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=1, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "A", "a", "naïve"]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows, base = [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.4 or not base:
            base.append([r.choice(vocabulary) for _ in range(r.randint(1, 120))])
            w = base[-1]
        elif kind < 0.6:
            w = r.choice(base)
        elif kind < 0.9:
            w = list(r.choice(base))
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = passage + [r.choice(vocabulary) for _ in range(r.randint(5, 40))]
        rows.append((i, r.choice((" ", "\n", " \t")).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "x " * 40000), (n + 6, "x y " * 20000)]


def test_shingles_match_words():
    import pyarrow as pa

    texts = [t for _, t in corpus(3)] + ["a\u00a0b c", "ends ", " starts", "İ A"]
    sets = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(x) for x in sets] == [len(shingled(t)) for t in texts]
    assert len(np.unique(np.concatenate(sets))) == len(set().union(*map(shingled, texts)))
    whole = shingles.word_hashes(*shingles.text_buffer(pa.array(texts)))[0]
    was, shingles.SEGMENT = shingles.SEGMENT, 97
    try:
        assert (shingles.word_hashes(*shingles.text_buffer(pa.array(texts)))[0] == whole).all()
    finally:
        shingles.SEGMENT = was


def components_of(rows):
    sets = [(i, shingled(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            shared = len(a & b)
            if a and b and 100 * shared >= 80 * (len(a) + len(b) - shared):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    got = ngram_jaccard.jaccard_components(docs(spark, rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(rows)


def test_jaccard_edges(spark):
    text = "a b c d e f g"
    rows = [(None, text), (5, text), (3, text), (5, text), (5, "other words in this second row"), (9, "other words in this second row")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 3, None), (3, 3, 3), (5, 2, 3), (5, 3, 3), (5, 3, 3), (9, 2, 3)], key=str)
    assert ngram_jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_sketches_never_reject_a_link():
    r = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.8], r.integers(0, 2**63, r.integers(1, 60), dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert ngram_jaccard.sketch_distance(ngram_jaccard.parity_sketch(a), ngram_jaccard.parity_sketch(b)) <= apart
        assert ngram_jaccard.divide_skip_overlap(a, b) == len(np.intersect1d(a, b))


def test_decontamination(spark):
    rows = corpus(5)
    r = random.Random(8)
    texts = [t for _, t in rows if t and len(t.split()) > 12]
    items = []
    for k in range(40):
        w = r.choice(texts).split()
        at = r.randrange(max(1, len(w) - 10))
        part = w[at : at + r.randint(5, 40)]
        if k % 3 == 0:
            part = part + ["new", "words", "here"]
        items.append((k, " ".join(part)))
    items += [(100, None), (101, ""), (102, "one two"), (None, "one two"), (103, "not in any document at all")]
    found = decontamination.leaks(docs(spark, rows), docs(spark, items, "item_id long, text string")).collect()
    want = {(i, k) for i, t in rows for k, s in items if shingled(s) and 100 * len(shingled(t) & shingled(s)) >= 80 * len(shingled(s))}
    assert {(x.doc_id, x.item_id) for x in found} == want and len(found) == len(want)
    assert decontamination.leaks(docs(spark, rows), docs(spark, [], "item_id long, text string")).count() == 0
    assert decontamination.leaks(docs(spark, []), docs(spark, items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("words", [5, 6, 7, 8, 9, 12, 15])
def test_decontamination_finds_short_items(words):
    r = np.random.default_rng(words)
    lists = [r.integers(0, 2**63, 200, dtype=np.uint64) for _ in range(1500)]
    places = r.integers(0, 200 - words, 1500)
    items = [x[k : k + words - 4].copy() for x, k in zip(lists, places, strict=True)]
    found = decontamination.Index(items).candidates(lists)
    assert all((k, k) in found for k in range(1500))


def test_decontamination_short_items_as_by_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(k, " ".join(r.choices(words, k=200))) for k in range(300)]
    items = []
    for k, (_, text) in enumerate(rows):
        said, n = text.split(), 5 + k % 4
        at = r.randrange(200 - n)
        items.append((k, " ".join(said[at : at + n])))
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [cut(t) for _, t in rows]
    want = {(d, i) for i, t in items for d, s in enumerate(sets) if 100 * len(cut(t) & s) >= 80 * len(cut(t))}
    got = decontamination.leaks(docs(spark, rows), docs(spark, items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(want) >= 300


def test_decontamination_in_blocks(spark, monkeypatch):
    rows = corpus(6, 40)
    items = [(k, " ".join(t.split()[:9])) for k, (_, t) in enumerate(rows) if t]
    whole = decontamination.leaks(docs(spark, rows), docs(spark, items, "item_id long, text string")).collect()
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    parts = decontamination.leaks(docs(spark, rows), docs(spark, items, "item_id long, text string")).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and whole


def test_toxicity_learns_and_handles_edges(spark):
    r = random.Random(3)
    syllables = ["ka", "lo", "mi", "ten", "ur", "sha", "er", "on", "st"]
    rows, labels = [], []
    for i in range(900):
        w = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 80))]
        bad = i % 6 == 0
        for _ in range(r.randint(1, 3) if bad else 0):
            w.insert(r.randrange(len(w)), "zorgh" + r.choice(syllables))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "text"), (2002, "zorgh " * 30000), (3, rows[3][1])]
    df, told = docs(spark, rows), spark.createDataFrame([*labels, (None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    model = toxicity.train(df, told)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all(x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert sum((x.doc_id % 6 == 0) == bool(x.predicted) for x in held) >= 0.97 * len(held)
    assert {x.predicted for x in got if x.doc_id == 2002} == {1}
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - x.predicted for x in got)


def test_toxicity_without_labels(spark):
    model = toxicity.train(docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x.predicted for x in toxicity.score(docs(spark, [(1, "a"), (2, None)]), model).collect()] == [0, 0]
    assert toxicity.score(docs(spark, []), model).count() == 0


def luhn(d):
    return sum((int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 3, m.end()))
    out += [(m.start(), 4, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def said(spans):
    return ",".join(f"{pii.KINDS[k - 1]}:{a}:{b}" for a, k, b in spans)


def test_pii(spark):
    r = random.Random(2)
    alphabet = [*"aZ.@-+() 0123459..@@\n", "4041894974608795", "é", "1.2.3.4", "255.256.1.1", "+1 (988) 555-2485", "a@b.c", pii._DOT, pii._SEPARATOR, "😀", "me (at) x.org"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))) for i in range(1500)]
    rows += [(5000 + i, f"call me +1 (555) 555-{i:04d} or ({i % 900 + 100}) 555-{i:04d} now") for i in range(300)]
    rows += [(9000, None), (9001, ""), (9002, "1 " * 2000), (9003, "a@b" + ".c" * 2000), (9004, "a" * 3000), (None, "a@b.c"), (5, rows[5][1])]
    df = docs(spark, rows)
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, base_spans(t or ""))
    for x in got:
        own = by[x.doc_id]
        assert x.base_sha256 == hashlib.sha256(said(own).encode()).hexdigest(), x.doc_id
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == j for _, k, _ in own) for j in (1, 2, 3, 4)]
        spans = [s.split(":") for s in x.spans.split(",") if s]
        assert set(filter(None, said(own).split(","))) <= set(x.spans.split(",")) and spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert clean.where("doc_id = 9000").first().text is None and clean.where("doc_id is null").first().text == "[EMAIL]"
    assert not clean.where(F.col("text").contains("555-0007")).where(F.col("text").contains("+1")).count()
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_plan_is_native(spark):
    plan = pii.find(docs(spark, [(1, "a@b.c")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_filter(spark):
    urls = ["http://a.NET/x", "https://example.net/en/1", "https://www.example.net/en", "http://x.example.com/de/2?q", "http://b.org/fr/#f", "http://b.org/fr", "http://spam-farm.org/x", "http://SPAM-farm.org", "ftp://a.net", "no scheme", "", None, "http://[::1]/a\nb", "a://b://c/d", "http://notexample.com/de/"]
    df = spark.createDataFrame([*enumerate(urls), (None, "http://a.net/"), (3, urls[3])], "page_id long, url string").withColumns({"host": F.lit("x"), "rule": F.lit("x"), "is_listed": F.lit(True)})
    block_list = spark.createDataFrame([("Spam-Farm.org",), ("spam-farm.org",), (None,), ("b",), ("farm.org",)], "domain string").withColumn("host", F.lit("b.org"))
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, block_list).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2] == ("www.example.net", "/en", "net/", "block")
    assert got[3] == ("x.example.com", "/de/2", "example.com/de/", "block") and got[4] == ("b.org", "/fr/", "org/fr/", "allow") and got[5][2:] == (None, "allow")
    assert got[6][2:] == (None, "block") and got[7] == ("spam-farm.org", "", None, "block") and got[8] == ("a.net", "", None, "allow")
    assert got[9] == got[10] == got[11] == ("", "", None, "allow") and got[12][:2] == ("[::1]", "/a\nb") and got[14][2] is None
    assert url_filter.judge(df, block_list).count() == len(urls) + 2 and url_filter.judge(df.limit(0), block_list).count() == 0
    assert {r.verdict for r in url_filter.judge(df.where("page_id in (6, 7)"), block_list.limit(0)).collect()} == {"allow"}
    below = spark.createDataFrame([(1, "http://a.B.spam-farm.org/"), (2, "http://xspam-farm.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(below, block_list).collect()} == {1: "block", 2: "allow"}


@pytest.mark.parametrize("shard_bits", [1 << 27, 3000])
def test_cascade_is_exact(spark, shard_bits):
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 1500).cast("string"), F.lit(".x/")).alias("url"))
    listed = F.pmod(F.xxhash64("host", F.lit(5)), F.lit(7)) == 0
    hosts = df.select(F.regexp_extract("url", "://(.*)/", 1).alias("host")).where(listed).select(F.col("host").alias("domain"))
    got = url_filter.judge(df, hosts, shard_bits=shard_bits)
    assert got.count() == 4000 and got.where((F.col("verdict") == "block") != listed).count() == 0


def brute_links(rows):
    n, parent, groups = {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, label in rows:
        n[i], parent[i] = 0, i
        v = None if v is None else np.array([np.nan if c is None else c for c in v], float)
        if v is not None and len(v) and np.isfinite(v).all() and v.any() and label is not None:
            groups.setdefault((label, len(v)), []).append((i, v / np.linalg.norm(v)))
    for own in groups.values():
        m = np.stack([v for _, v in own])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.93, 1))):
            for k in (a, b):
                n[own[k][0]] += 1
            u, v = find(own[a][0]), find(own[b][0])
            parent[max(u, v)] = min(u, v)
    return n, {i: find(i) for i in parent}


def test_embeddings(spark):
    r = np.random.default_rng(3)
    rows, k = [], 0
    for spread in (0.05, 0.15, 0.2, 0.25, 0.3):
        centre = r.normal(size=64)
        for _ in range(40):
            rows.append((k, (centre + r.normal(size=64) * spread).tolist(), k % 2))
            k += 1
    rows += [(1000 + i, r.normal(size=64).tolist(), 1) for i in range(100)]
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [1.0] * 63 + [None], 1), (2004, rows[0][1], None), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1), (2008, [float("inf")] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"unit": F.lit(1), "ball": F.lit(2)})
    rows = [(x.vec_id, x.embedding, x.label) for x in df.collect()]
    n, component = brute_links(rows)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and all(x.n_links <= n[x.vec_id] and x.kept == (x.vec_id == x.component_id) for x in got)
    assert sum(x.n_links for x in got) >= 0.97 * sum(n.values())
    assert sum(x.component_id == component[x.vec_id] for x in got) >= 0.97 * len(got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = embedding_dedup.near_duplicates(df.where("vec_id = 0").union(df.where("vec_id = 0")).union(df.where("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long")))).collect()
    assert sorted(map(str, twice)) == sorted(["Row(vec_id=0, n_links=0, component_id=0, kept=True)"] * 2 + ["Row(vec_id=None, n_links=0, component_id=None, kept=False)"])


@pytest.mark.parametrize("blocks", [2, 3, 4, 5])
def test_embeddings_meet_whatever_the_number_of_blocks(blocks):
    r = np.random.default_rng(8)
    x, y = r.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    hasher = embedding_dedup.Hasher(64, blocks)
    (own_x, probed_x), (own_y, probed_y) = (hasher.cells(z, np.zeros(400, np.int64)) for z in (x, y))
    met = (own_x == own_y) | (probed_x == own_y[:, :, None]).any(axis=2) | (probed_y == own_x[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.97


@pytest.mark.parametrize("blocks", [3, 4, 5])
def test_embeddings_recall_with_more_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(embedding_dedup, "blocks_for", lambda n: blocks)
    r = np.random.default_rng(9)
    x, y = r.normal(size=(2, 100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + (1 - 0.931**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([x, y]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(g.n_links for g in got) >= 0.95 * 200


def test_e8_points_are_nearest():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8)) * 2
    near = embedding_dedup.nearest_e8(x)
    roots = embedding_dedup.roots()
    assert np.allclose((roots**2).sum(axis=1), 2) and len(np.unique(roots, axis=0)) == 240
    best = ((x - near) ** 2).sum(axis=1)
    assert (((x[:, None] - near[:, None] - roots) ** 2).sum(axis=2) >= best[:, None] - 1e-9).all()


TEXTS = [None, "", " ", "'r", "'", "it's 'sword' we'll <|endoftext|> x", "a\n\n b\t\t", "😀 ½²", "x" * 50000, " " * 20000 + "y", "don't'll've 12 34"]


def token_texts():
    r = random.Random(1)
    alphabet = [*"  \n\t'''stmdrvlleaBx1²!?<|", "é", "ß", "\u00a0", "\u2003", "漢", "😀", "'re", "'ve", "'ll", "<|endoftext|>", "½", "\u0301", "'s", "\u200b", "\x1c"]
    return TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.tokenizer_path())


def test_token_counts(spark):
    texts = token_texts()
    want = [len(x.ids) for x in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = docs(spark, [*enumerate(texts), (None, "a b"), (5, texts[5])])
    got = token_counts.count_tokens(df).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        if x.doc_id is not None:
            assert (x.n_tokens, x.n_bytes, x.over_limit) == (want[x.doc_id], len((texts[x.doc_id] or "").encode()), want[x.doc_id] > 1024)
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


def test_splitter_composes_over_any_chunks(monkeypatch):
    r = np.random.default_rng(0)
    symbols = r.integers(0, 12, 5000).astype(np.uint8)
    want = tokenizer_fst.marks_of(symbols)
    for chunk, settle in ((1, 1), (7, 2), (64, 64), (6000, 3)):
        monkeypatch.setattr(tokenizer_fst, "CHUNK", chunk)
        monkeypatch.setattr(tokenizer_fst, "SETTLE", settle)
        assert (tokenizer_fst.marks_of(symbols) == want).all()


def test_purged_pieces_are_compiled_again(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenizer_fst, "KEPT", 50)
    machine, lib = tokenizer_fst.Compiled(token_counts.tokenizer_path()), library()
    for k in range(6):
        texts = [f"word{k}{j} again {j * 7}" for j in range(60)]
        assert [x.tolist() for x in machine.encode(*shingles.text_buffer(pa.array(texts)))] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_whole(spark):
    texts = token_texts()[:400] + ["word " * 9000]
    lib = library()
    want = [lib.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    rows = packing.pack(docs(spark, [*enumerate(texts)]).repartition(3)).toPandas()
    for i, own in rows.sort_values(["doc_id", "start"]).groupby("doc_id"):
        at = 0
        for x in own.itertuples():
            assert x.start == at and x.doc_tokens == len(want[i]) and x.ids_crc32 == zlib.crc32(np.array(want[i][at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(want[i])
    assert rows.doc_id.nunique() == len(texts)
    for _, own in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        at = 0
        for x in own.itertuples():
            assert x.offset == at
            at += x.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(docs(spark, [])).count() == 0
    again = packing.pack(docs(spark, [(None, "a"), (1, "b"), (1, "b")])).collect()
    assert sorted(str(x.doc_id) for x in again if x.start == 0) == ["1", "1", "None"]


def test_sum_of_squares_choice():
    packer, r = packing.SumOfSquares(64), random.Random(0)
    for k in range(400):
        size, n = r.randint(1, 63), packer.count.copy()
        scores = {0: 2 * n[size] + 1}
        for h in range(1, 65 - size):
            if n[h]:
                scores[h] = (n[h] - 1) ** 2 - n[h] ** 2 + ((n[h + size] + 1) ** 2 - n[h + size] ** 2 if h + size < 64 else 0)
        packer.place((k, 0, size))
        before, after = (n**2).sum(), (packer.count**2).sum()
        assert after - before == min(scores.values())


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (7, "http://b/\r\nX: y", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70000), (None, "u", "same"), (None, None, None), (7, "again", "same"), (8, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit("x"), "refers_to": F.lit("x"), "bundle": F.lit("x")})
    index = warc.write_bundles(df.repartition(3))
    got = sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_records(index).collect())
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        last = max((j for j, _, t in rows if (t or "") == (h or "") and j is not None), default=None)
        revisit = i is not None and i != last
        want.append((str(i), len(payload), warc.base32_sha1(payload), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(got, key=str) == sorted(want, key=str)
    one = warc.read_records(index.where("page_id = 5"), payloads=True).first()
    assert one.payload.decode() == "é" * 70000
    assert warc.round_trip(df.limit(0)).count() == 0


def test_bundle_is_seekable(tmp_path):
    import pyarrow.fs
    import zstandard

    fs = pyarrow.fs.LocalFileSystem()
    writer = warc.BundleWriter(fs, str(tmp_path / "x.warc.zst"))
    data = [warc.record(k, "u", bytes(f"page {k} " * 500, "ascii"), None) for k in range(150)]
    places = [writer.add(d) for d in data]
    writer.close()
    reader = warc.BundleReader(fs, str(tmp_path / "x.warc.zst"))
    assert len(reader.frames) > 2
    for d, (frame, at, length) in zip(data, places, strict=True):
        assert reader.frame(frame)[at : at + length] == d
    stream = zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "x.warc.zst", "rb"), read_across_frames=True)
    assert stream.read() == b"".join(data)


def test_html_accuracy_on_other_designs():
    chain, right, total = html_extraction.trained(), 0, 0
    for rows, labels in html_extraction.labelled_pages(150, 77):
        if rows:
            right += sum(a == b for a, b in zip(html_extraction.decode(chain, rows), labels, strict=True))
            total += len(labels)
    assert right >= 0.98 * total


def test_viterbi_is_exhaustive():
    import itertools

    r = np.random.default_rng(2)
    chain = html_extraction.Chain(r.normal(size=len(html_extraction.NAMES)), r.normal(size=(2, 2)))
    for n in range(1, 7):
        rows = [list(r.integers(0, len(html_extraction.NAMES), 3)) for _ in range(n)]
        value = lambda y: sum(chain.weights[f] for k, row in enumerate(rows) if y[k] for f in row) + sum(chain.moves[int(a)][int(b)] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((False, True), repeat=n), key=value)
        assert html_extraction.decode(chain, rows) == list(best)


def test_html_blocks_edges():
    page = '<head><title>T</title></head><body>a &amp; b<br>c\n  d<p>one <b>two<p>three</b></p><script>if (a<b) "</p>"</script><style>p{}</style><!-- x --><ul><li>i<li>j</ul>&lt;p&gt; tail <unclosed'
    assert [b.text for b in html_blocks.blocks(page)] == ["a & b", "c d", "one two", "three", "i", "j", "<p> tail <unclosed"]
    for broken in ("", "<", "</", "<p", "<!--", "<script>", "</p></div>", "<a href='", "\x00<p>\x00"):
        html_blocks.blocks(broken)


def test_html_extraction(spark):
    article = "<article><h1>Title &amp; more</h1><p>First   paragraph,\n of text.</p><p>Second one is here.</p></article>"
    page = f'<html><head><title>no</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy this now.</div>{article}<div class="comments"><p>I liked it, thanks.</p></div><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<article><p>" + "word " * 60000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    got = html_extraction.extract(df).collect()
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    want = "Title & more\nFirst paragraph, of text.\nSecond one is here."
    assert [x.text for x in got if x.page_id in (1, None)] == [want] * 3 and [x.text for x in got if x.page_id in (2, 3)] == ["", ""]
    assert next(x.n_chars for x in got if x.page_id == 5) == 60000 * 5 - 1
    assert html_extraction.extract(df.limit(0)).count() == 0
