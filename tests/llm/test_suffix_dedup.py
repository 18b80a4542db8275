"""Induced sorting against sorting suffixes, and the removal of repeated strings against counting all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from postloom.llm import induced_sorting as sorting
from postloom.llm import suffix_dedup

LEAST = suffix_dedup.LEAST


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return min(n, sorting.CAP)


@pytest.mark.parametrize("sizes", [(2048, 1 << 16, 512), (3, 4, 2), (16, 5, 7)])
def test_suffixes_and_common_prefixes(sizes, monkeypatch):
    for name, size in zip(("RANGE", "BATCH", "_PEEK"), sizes, strict=True):
        monkeypatch.setattr(sorting, name, size)
    r = random.Random(1)
    texts = [([1] * 700, 2), ([2, 1] * 300, 3), ([1, 2, 3] * 200, 4), ([5], 9), ([], 2)]
    for _ in range(300):
        alphabet = r.choice((2, 3, 4, 10, 300))
        texts.append(([r.randint(1, alphabet - 1) for _ in range(r.randint(1, 60))] * r.choice((1, 1, 3)), alphabet))
    for text, alphabet in texts:
        text = [*text, 0]
        got = list(sorting.suffixes_downwards(np.array(text, np.int32), alphabet, lambda: sorting.Store(1 << 30)))
        want = sorted(range(len(text) - 1), key=lambda i: text[i:], reverse=True)
        assert [i for g in got for i in g[0].tolist()] == want
        assert [c for g in got for c in g[1].tolist()] == ([0] + [common(text[a:], text[b:]) for a, b in zip(want, want[1:])] if want else [])


def test_queues_in_files_give_the_same_and_are_deleted(tmp_path, monkeypatch):
    r, written = random.Random(2), []
    monkeypatch.setattr(sorting.Store, "close", lambda self, close=sorting.Store.close: (written.append(self.written), close(self)))
    base = [bytes(r.choices(b"abcd ", k=400)) for _ in range(5)]
    segments = [(b := r.choice(base))[(a := r.randrange(150)) : a + 230] for _ in range(300)] + [b"a" * 700, b"", b"short"]
    plain = Counter(s[i : i + LEAST] for s in segments for i in range(len(s) - LEAST + 1))
    got = sorting.repeated_starts(segments, LEAST, 1000, pyarrow.fs.LocalFileSystem(), str(tmp_path))
    assert [g.tolist() for g in got] == [[plain[s[i : i + LEAST]] > 1 for i in range(len(s) - LEAST + 1)] for s in segments]
    assert sum(written) > 1_000_000 and not list(tmp_path.iterdir())


def plain(texts):
    blobs = [(t or "").encode() for t in texts]
    counts = Counter(b[k : k + LEAST] for b in blobs for k in range(len(b) - LEAST + 1))
    for b in blobs:
        keep = [True] * len(b)
        for k in range(len(b) - LEAST + 1):
            if counts[b[k : k + LEAST]] > 1:
                keep[k : k + LEAST] = [False] * LEAST
        left = bytes(x for x, k in zip(b, keep, strict=True) if k)
        spans = sum(not k and (not i or keep[i - 1]) for i, k in enumerate(keep))
        yield len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["é", "日本語", "naïve", "A"]
    say = lambda n: " ".join(r.choices(words, k=n))
    passage, line = say(60), say(20)
    texts = []
    for _ in range(150):
        kind = r.random()
        if kind < 0.3 or len(texts) < 3:
            texts.append(say(r.randint(1, 250)))
        elif kind < 0.5:
            texts.append(r.choice(texts))
        elif kind < 0.7:
            w = r.choice(texts).split(" ")
            w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
        elif kind < 0.9:
            a = r.randrange(200)
            texts.append(say(r.randint(0, 30)) + passage[a : a + r.randint(150, 400)] + say(r.randint(0, 30)))
        else:
            texts.append((line + "\n") * r.randint(1, 5))
    return texts + [None, "", "x" * 199, "y" * 200, "y" * 199, "z" * 201, "ab" * 3000, say(40)[:LEAST], "é" * 150]


def result(spark, texts, parts=3):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    df = df.withColumns({c: F.lit("clash") for c in ("row", "at", "n", "h", "s", "part", "copies", "kinds", "first", "ahead", "hs")})
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedupe(df).collect()}
    assert len(got) == len(texts)
    return [got[k] for k in range(len(texts))]


@pytest.mark.parametrize("hot", [256, 3, 0])
def test_equals_counting_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    texts = corpus(7)
    assert result(spark, texts) == list(plain(texts))


@pytest.mark.parametrize("region", [1 << 20, 1000])
def test_each_start_is_in_one_segment_and_equal_strings_share_anchors(monkeypatch, region):
    monkeypatch.setattr(suffix_dedup, "REGION", region)
    suffix_dedup._powers.cache_clear()
    blobs = [(t or "").encode() for t in corpus(8)]
    raw, bounds = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0] + [len(b) for b in blobs])
    anchors, seen = {}, set()
    for row, at, n, ahead, h, s in zip(*(c.tolist() for c in suffix_dedup.segments(raw, bounds)), strict=True):
        for k in range(n):
            string = blobs[row][at + k : at + k + LEAST]
            assert len(string) == LEAST and (row, at + k) not in seen
            assert anchors.setdefault(string, (h, ahead - k)) == (h, ahead - k)
            seen.add((row, at + k))
    assert len(seen) == sum(max(0, len(b) - LEAST + 1) for b in blobs)
    suffix_dedup._powers.cache_clear()


def test_repeats_within_one_long_text_and_across_parts(spark):
    r = random.Random(9)
    block = bytes(r.choices(b"abcdefgh", k=3000)).decode()
    noise = [bytes(r.choices(b"ijklmnop", k=n)).decode() for n in (50_000, 700, 5000)]
    texts = [noise[0] + block + noise[1] + block[100:2500], noise[2] + block[500:699] + "!", noise[2][:1000], block[700:900]]
    assert result(spark, texts, 4) == list(plain(texts))


def test_a_passage_in_very_many_texts(spark):
    r = random.Random(11)
    passage = bytes(r.choices(b"abcdefgh", k=500)).decode()
    texts = ["".join(r.choices("ijklmnop", k=40)) + passage + "".join(r.choices("qrstuvw", k=40)) for _ in range(700)]
    assert result(spark, texts) == list(plain(texts))


def test_ids_rows_and_kept_bytes(spark):
    t = "abc " * 20 + "".join(random.Random(3).choices("xyz", k=300))
    df = spark.createDataFrame([(None, t + "tail"), ("a", t), ("a", t), ("b", "short")], "doc_id string, text string")
    rows = suffix_dedup.dedupe(df, keep_text=True).collect()
    assert sorted((r["doc_id"] or "", bytes(r["kept"])) for r in rows) == [("", b"tail"), ("a", b""), ("a", b""), ("b", b"short")]
    assert suffix_dedup.dedupe(df.limit(0)).count() == 0
