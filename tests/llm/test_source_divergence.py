"""Source divergence against plain arithmetic."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postloom.llm import source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs, top):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order) if part == "pair" or k < top}
    return out


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("term", "place", "n", "docs", "value", "size", "rank")})
    found = source_divergence.divergences(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(set(found)) == len(found)
    return {tuple(x) for x in found}


def test_equals_plain_arithmetic(spark):
    r = random.Random(5)
    vocabulary = ["the", "The", "THE", "naïve", "É", "é", "d'un", "x1y", "日本", "😀", "of_the", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(r.choice(("en", "fr", None, "")), f"s{min(r.randrange(9), 5)}" if r.random() < 0.9 else None, " ".join(r.choices(vocabulary, k=r.randint(0, 40)))) for _ in range(400)]
    rows += [("de", "a", "one"), ("de", "b", None), ("de", "c", "123 !"), ("es", "only", "uno uno"), ("en", "s0", None), ("en", "s9", "")] + rows[:5] * 3
    rows += [("en", "long", "the of " * 60_000)]
    for min_docs, top in ((30, 50), (3, 4), (1, 2)):
        assert result(spark, rows, min_docs=min_docs, top=top) == plain(rows, min_docs, top)


def test_no_terms_and_no_rows(spark):
    assert result(spark, [("en", "a", ""), ("en", "b", None)]) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert result(spark, []) == set()


def test_sums_stay_exact_for_very_frequent_terms(spark):
    big = spark.range(1).select(source_divergence._share(F.lit(10**13), F.lit(3 * 10**13), F.lit(7).cast("long")).alias("p")).first()["p"]
    assert big == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)
