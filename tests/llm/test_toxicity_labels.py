"""The toxicity operator on the given labels, and its features against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest

from postloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain_features(text):
    """Buckets of all n-grams by a loop, with the levels that they reach."""
    mask, codes = 0xFFFFFFFF, []
    for c in text.lower():
        c = ord(c)
        codes.append((32 if c == 32 or 9 <= c <= 13 else c) * 2654435761 & mask)
    seen = Counter()
    for n in toxicity.ORDERS:
        for k in range(len(codes) - n + 1):
            h = codes[k]
            for x in codes[k + 1 : k + n]:
                h = (h * 0x01000193 + x) & mask
            seen[((h ^ h >> 15) * (0x2C1B3C6D + 2 * n) & mask) >> 32 - toxicity.BUCKET_BITS] += 1
    return {level << toxicity.BUCKET_BITS | b for b, c in seen.items() for level, least in enumerate(toxicity.LEVELS) if c >= least}


def test_features_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "SPAN", 64)  # so that texts come in many parts
    r = random.Random(2)
    texts = ["", "a", "ab", "aaa", "aaaa aaaa", "Ärger\tüber İ", *("".join(r.choice("ab é\n") for _ in range(r.choice((3, 58, 59, 60, 63, 64, 65, 118, 119, 500)))) for _ in range(40))]
    rows, found = toxicity._features(texts)
    got = [set() for _ in texts]
    for row, f in zip(rows.tolist(), found.tolist(), strict=True):
        assert f not in got[row]
        got[row].add(f)
    want = [plain_features(t) for t in texts]
    assert got == want
    kept = np.array(sorted(r.sample(sorted(set().union(*want)), 50)))
    rows, places = toxicity._features(texts, kept)
    assert sorted(zip(rows.tolist(), kept[places].tolist(), strict=True)) == sorted((k, f) for k, w in enumerate(want) for f in w & set(kept.tolist()))
    assert len(toxicity._features(texts, kept[:0])[0]) == 0


def test_very_long_text_is_scored_whole():
    """Three MB of clean words with the telling ones at the end score as those words say."""
    telling = sorted(plain_features("zzzqx"))
    model = toxicity.Model(np.array(telling), np.full(len(telling), 3.0), -4.0)
    import pyarrow as pa

    low, high = toxicity._scorer(model)(pa.array(["word " * 600_000, "word " * 600_000 + "zzzqx"]))
    assert low < 0.1 < 0.9 < high


@pytest.fixture(scope="module")
def held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    known = labels.select("doc_id", "toxic").join(docs.select("doc_id", "lang"), "doc_id")
    return model, toxicity.score(docs, model).join(known, "doc_id").where("held_out and toxic is not null").toPandas()


def test_recall_and_precision_on_given_labels(held_out_rows):
    _, rows = held_out_rows
    toxic, said = rows.toxic == 1, rows.predicted == 1
    assert (toxic & said).sum() >= 0.9 * toxic.sum()
    assert (toxic & said).sum() >= 0.9 * said.sum()


def test_scores_equal_a_plain_scorer(spark, held_out_rows):
    model, rows = held_out_rows
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    some = set(rows.doc_id[:40].tolist())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").collect() if r.doc_id in some}
    scores = dict(zip(rows.doc_id, rows.score, strict=True))
    for i, text in texts.items():
        total = model.bias + sum(weight.get(f, 0.0) for f in plain_features(text or ""))
        assert abs(scores[i] - 1 / (1 + np.exp(-total))) < 1e-9
