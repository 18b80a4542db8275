"""Texts that weak hashes confuse, very long texts, and scattered containment."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postloom.llm import decontamination, ngram_jaccard, packing, shingles, token_counts, tokenizer_fst


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.tokenizer_path())


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


PAIRS = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (16, 32, 64, 512, 1024, 2048, 4096) for a, b in ("et", "on", "ab")]


def test_words_that_collide_modulo_a_power_of_two():
    for a, b in PAIRS:
        x, y = shingles.shingle_sets(pa.array([f"{a} one two three four", f"{b} one two three four"]))
        assert not np.intersect1d(x, y).size
    r = random.Random(2)
    words = list({"".join(r.choice("abé\u0000") for _ in range(r.choice((1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200)))) for _ in range(5000)})
    hashes, _ = shingles.word_hashes(*shingles.text_buffer(pa.array(words)))
    again, _ = shingles.word_hashes(*shingles.text_buffer(pa.array([" ".join(words)])))
    assert len(np.unique(hashes)) == len(words) and (hashes == again).all()


def test_colliding_texts_do_not_link_or_leak(spark):
    a, b = PAIRS[-1]
    rows = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, f"{a} one two three four")]
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(9, rows[0][1])], "item_id long, text string")
    found = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {x.doc_id for x in found} == {1, 3}


def test_tokens_of_colliding_and_long_pieces(spark):
    lib, texts = library(), [t for pair in PAIRS for t in pair] + ["x" * 70_000, "漢" * 3000, " " * 5000 + "a"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    machine = tokenizer_fst.Compiled(token_counts.tokenizer_path())
    for group in (texts, texts[::-1], *([t] for t in texts)):  # in one batch and over batches
        order = [texts.index(t) for t in group]
        assert [x.tolist() for x in machine.encode(*shingles.text_buffer(pa.array(group)))] == [want[k] for k in order]
        assert machine.counts(*shingles.text_buffer(pa.array(group))).tolist() == [len(want[k]) for k in order]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(df).collect()} == {k: len(x) for k, x in enumerate(want)}
    for x in packing.pack(df).collect():
        ids = np.array([*want[x.doc_id], packing.END_ID], "<u4")
        assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())


def test_a_long_text_is_cut_where_pretokens_begin(monkeypatch):
    r, lib = random.Random(4), library()
    text = "".join(r.choice(("it's", " we'll", "  ", "\n", " don't", "12", "  x", "'", "<|endoftext|>", "漢", " ve")) for _ in range(20_000))
    texts = ["a b", text, "", text[5000:]]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for span in (40, 333, 5000):
        monkeypatch.setattr(tokenizer_fst, "SPAN", span)
        machine = tokenizer_fst.Compiled(token_counts.tokenizer_path())
        assert [x.tolist() for x in machine.encode(*shingles.text_buffer(pa.array(texts)))] == want
        assert machine.counts(*shingles.text_buffer(pa.array(texts))).tolist() == [len(x) for x in want]


def test_transitions_emit_the_counts_of_prefixes():
    machine, lib = tokenizer_fst.Compiled(token_counts.tokenizer_path()), library()
    pieces = machine.pieces
    word = b" internationalisationalities"
    raw = np.frombuffer(word, np.uint8)
    last = pieces.walk(raw, np.array([0]), np.array([len(raw)]))[0]
    states = [0, *(int(pieces.walk(raw, np.array([0]), np.array([k]))[0]) for k in (8, 16, 24, len(raw)))]
    assert states[-1] == last
    emitted = np.diff(pieces.size[states])
    assert emitted.sum() == len(lib.encode(word.decode(), add_special_tokens=False).ids)


@pytest.mark.parametrize("length", [30, 400, 2000])
def test_scattered_containment_is_found(spark, length):
    """An item's passages of seven words (three shingles) lie far apart in a long document."""
    r = random.Random(length)
    rows, items = [], []
    for k in range(12):
        item = [f"i{k}x{r.randrange(10**6)}" for _ in range(20 + k)]
        items.append((k, " ".join(item)))
        shingled = [item[j : j + 5] for j in range(len(item) - 4)]
        held = r.sample(shingled, -(-80 * len(shingled) // 100) - (k % 4 == 3))
        filler = lambda: [f"f{r.randrange(10**6)}" for _ in range(length // 10)]
        rows.append((k, " ".join(w for s in held for w in [*filler(), *s])))
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = {d: cut(t) for d, t in rows}
    want = {(d, i) for i, t in items for d, s in sets.items() if 100 * len(cut(t) & s) >= 80 * len(cut(t))}
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and want == {(k, k) for k in range(12) if k % 4 != 3}


def test_packing_keeps_every_window_open(spark):
    """Remainders of which no two fit one window leave them all open until the partition ends; nothing is padded."""
    packer = packing.SumOfSquares(64)
    assert not any(packer.place((k, 0, 33)) for k in range(10_000)) and packer.count[33] == 10_000
    sizes = [sum(x[2] for x in window) for window in packer.drain()]
    assert sum(sizes) == 330_000 and all(x == 64 or x & (x - 1) == 0 for x in sizes)


@pytest.mark.parametrize(("step", "list_rows"), [(2, 3), (7, 1000), (50, 2)])
def test_t_occurrence_with_more_short_lists(spark, step, list_rows):
    """Whatever L is, and however lists are split, the links are those of brute force; many pairs lie near the threshold."""
    r = random.Random(step)
    vocabulary, rows = [f"v{k}" for k in range(900)], []
    passage = r.choices(vocabulary, k=40)
    for k in range(150):
        if rows and r.random() < 0.75:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            w = w[r.randint(0, len(w) // 12) :]
        else:
            w = passage * r.randint(0, 1) + r.choices(vocabulary, k=r.randint(3, 400))
        rows.append((k, " ".join(w)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} or {tuple(t.split())} for k, t in rows}
    label = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), step=step, list_rows=list_rows).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {k: (len(s), label[k]) for k, s in sets.items()}
    assert 20 < len(set(label.values())) < 140


def test_t_occurrence_is_exact():
    r = np.random.default_rng(5)
    for _ in range(3000):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 200), dtype=np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.choice((0.85, 0.9, 1))], r.integers(0, 2**63, r.integers(1, 20), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        cut = lambda s: (s[: ngram_jaccard.short_lists(len(s))], s[ngram_jaccard.short_lists(len(s)) :])
        assert ngram_jaccard.t_occurrence(cut(x), cut(y)) == (100 * shared >= 80 * (len(x) + len(y) - shared))


def test_warc_reads_back_in_several_tasks_and_splits_hot_digests(spark, monkeypatch):
    from postloom.llm import warc

    rows = [(k, f"http://x/{k}", "" if k % 3 == 0 else f"<p>{k % 40}" * 200) for k in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {tuple(x) for x in warc.round_trip(df).collect()}
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "READ_BYTES", 50_000)
    index = warc.write_bundles(df.repartition(3))
    read = warc.read_records(index)
    assert {tuple(x) for x in read.collect()} == want and len(want) == 1500
    assert read.rdd.getNumPartitions() > 3
    largest: dict = {}
    for k, _, html in rows:
        largest[html] = k
    assert all((x[3], x[4]) == (("response", None) if largest[rows[x[0]][2]] == x[0] else ("revisit", largest[rows[x[0]][2]])) for x in want)


def test_embeddings_that_repeat_an_id_and_filters_in_groups(spark, monkeypatch):
    from postloom.llm import embedding_dedup

    r = np.random.default_rng(4)
    x, y, z = r.normal(size=(3, 64))
    near = lambda v, k: (v + r.normal(size=64) * 0.02 * (k > 0)).tolist()
    rows = [(7, near(x, 0), 1), (7, near(y, 0), 1), (7, near(x, 0), 1), (3, near(x, 1), 1), (9, near(y, 1), 1), (2**62, near(y, 1), 1), (5, near(z, 0), 1), (1, near(x, 0), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted([(7, 1, 3), (7, 2, 3), (7, 1, 3), (3, 1, 3), (9, 2, 3), (2**62, 2, 3), (5, 0, 5), (1, 0, 1)])
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in embedding_dedup.near_duplicates(df).collect()) == want
    monkeypatch.setattr(embedding_dedup, "FILTER_BITS", 300)
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in embedding_dedup.near_duplicates(df).collect()) == want
