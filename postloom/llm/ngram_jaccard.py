"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document with n distinct shingles links with another at Jaccard >= t only if they share at least
T = ceil(t * n) shingles.  DivideSkip sets L of its n inverted lists, the longest, aside, merges the other
short lists while counting, keeps who occurs there T - L times, and probes the long lists for the rest.  Here

* L = T - c with c = 1 + n // STEP.  Each further unit of c costs one more posting of a document in the merge and
  demands one more occurrence before a pair is looked at; at 2 % of n the merge grows by a tenth, and chance
  pairs, which share a phrase, fall away;
* lists are ordered by length: shingles that are frequent come last, then by hash.  Frequent ones are
  found over all documents (those seen twice or more in a block of texts, summed over blocks);
  the order only decides the work, never the result;
* the short lists are merged by Spark's sorted shuffle, which is the distributed counterpart of the
  heap: equal shingles meet, occurrences are summed for each pair, and lists with one distinct set leave at once.
  Of a pair the smaller set needs to post only n - ceil(2 t n / (1 + t)) + c of its lists, since the overlap
  must reach t / (1 + t) of both sizes, and both then share at least c short lists;
* the long lists are probed by binary search, in the candidate's sorted shingles: a pair stays if the
  occurrences in short lists and those found by the probes reach the required overlap (exact integers).

Equal sets are collapsed to one class first.  Candidates are taken in two rounds.  First each list
links its members to the list's first one, and each document verifies only the partner it shares most
short lists with; after that, only lists that still join different components give pairs, and all of
those that occur together c times are verified.  Before sets are fetched, pairs are compared by parity sketches: a bit for each
residue of the hashes, set if an odd number of shingles has it.  Bits that differ are a lower bound of the
shingles that only one set has, so a pair that the sketches reject cannot link.  So a large group of near copies costs a star, not all its pairs, and no
link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..components import connected_components
from ..scratch import materialize, small_batches
from .shingles import shingle_sets
from ..skew import with_group

THRESHOLD = (80, 100)
#: Shingles of a block of texts in which repeats are counted; bounds a worker's memory.
BLOCK_SHINGLES = 2_000_000
#: At most about so many frequent shingles are sent to the executors (16 bytes each).
ORDERED = 250_000
#: A list that more texts than this are counted for is split over tasks.
LIST_ROWS = 1000
#: So many pairs of ids at most are broadcast to the texts (16 bytes each).
BROADCAST_PAIRS = 1_000_000

#: A pair must occur in one short list more for each so many shingles of the smaller set.
STEP = 50


def required(n: int | np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> int | np.ndarray:
    """T: the least overlap of a set of n shingles with any set it links with."""
    num, den = threshold
    return -(-num * n // den)


def occurrences(n: int, step: int = STEP) -> int:
    """c = T - L: so many short lists a set of n shingles shares with any larger set that it links with."""
    return 1 + n // step


def short_lists(n: int, threshold: tuple[int, int] = THRESHOLD, step: int = STEP) -> int:
    """n - L: the number of short lists of a set of n shingles."""
    return n - required(n, threshold) + occurrences(n, step)


def set_key(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a sorted set, as signed integers."""
    import hashlib

    d = hashlib.blake2b(np.ascontiguousarray(x).tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def divide_skip_overlap(query: np.ndarray, candidate: np.ndarray) -> int:
    """Occurrences of a query's shingles in a candidate, by binary probes of the larger sorted set."""
    few, many = (query, candidate) if len(query) <= len(candidate) else (candidate, query)
    if not len(few):
        return 0
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return int(np.count_nonzero(many[at] == few))


def parity_sketch(x: np.ndarray) -> bytes:
    """A bit for each residue of the hashes modulo a power of two of at least their number and 64."""
    bits = max(64, 1 << int(len(x) - 1).bit_length()) if len(x) else 64
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the number of shingles that only one of two sets has."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _may_link(batches: Iterator[pa.RecordBatch], threshold) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, c, n, m, x, y) whose sketches x and y leave a link possible."""
    num, den = threshold
    for batch in batches:
        sizes = (batch.column("n").to_numpy() + batch.column("m").to_numpy()) * (den - num)
        apart = [sketch_distance(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["a", "b", "c"]).filter(pa.array(np.array(apart, np.int64) * (den + num) <= sizes))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (kind 0), and the shingles that a block of texts has twice or more (kind 1)."""
    held, seen, size = [], set(), 0

    def repeated() -> pa.RecordBatch:
        x, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        x, c = x[c > 1].view(np.int64), c[c > 1]
        return _described(np.ones(len(x), np.int8), pa.nulls(len(x), pa.int64()), c, x, np.zeros(len(x), np.int64), [None] * len(x))

    for batch in batches:
        ns, k1, k2, sketches = [], [], [], []
        for x in shingle_sets(batch.column(1)):
            a, b = set_key(x)
            ns.append(len(x)), k1.append(a), k2.append(b), sketches.append(parity_sketch(x))
            if len(x) and (a, b) not in seen:
                seen.add((a, b))
                held.append(x)
                size += len(x)
        yield _described(np.zeros(len(ns), np.int8), batch.column(0), ns, k1, k2, sketches)
        if size > BLOCK_SHINGLES:
            yield repeated()
            held, seen, size = [], set(), 0
    yield repeated()


def _described(kind, doc_id, n, k1, k2, sketch) -> pa.RecordBatch:
    columns = [pa.array(kind, pa.int8()), doc_id.cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, k1, k2)), pa.array(sketch, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "n", "k1", "k2", "sketch"])


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted by hash, and their rank: the more frequent, the later."""
    counts = materialize(described.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where("n > 3"), "frequent")
    steps = sorted((r["s"], r["c"]) for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("s")).agg(F.count("*").alias("c")).collect())
    least, total = None, 0
    for s, c in reversed(steps):
        if total + c > ORDERED:
            break
        least, total = s, total + c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("n") * 4) >= least).toPandas()  # at most ORDERED rows
    key, n = rows["k1"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def _in_order(x: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles, the shortest lists first, and what is known of the lists' lengths (0: short)."""
    keys, counts = frequent
    if not len(keys):
        return x, np.zeros(len(x), np.int64)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    rank = np.where(keys[at] == x, counts[at], 0)
    order = np.argsort(rank, kind="stable")
    return x[order], rank[order]


def _short_lists(batches: Iterator[pa.RecordBatch], frequent, threshold, step, list_rows) -> Iterator[pa.RecordBatch]:
    """Postings (shingle, set's first key, size and position, part) of each distinct set's short lists.

    A frequent list comes in parts, from 1 on; the others are part 0.
    """
    seen, size = set(), 0
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for x in shingle_sets(batch.column(0)):
            n = len(x)
            if not n:
                continue
            k = set_key(x)
            if k in seen:
                continue
            seen.add(k)
            size += n
            x, rank = (y[: short_lists(n, threshold, step)] for y in _in_order(x, frequent.value))
            out[0].append(x.view(np.int64))
            out[1].append(np.full(len(x), k[0], np.int64))
            out[2].append((n << 32) + np.arange(len(x), dtype=np.int64))
            out[3].append(np.where(rank > list_rows, 1 + k[0] % (rank // list_rows + 1), 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], ["sh", "k1", "np", "part"])
        if size > BLOCK_SHINGLES:
            seen, size = set(), 0


def _sets(batches: Iterator[pa.RecordBatch], frequent, threshold, step) -> Iterator[pa.RecordBatch]:
    """Each text's shingles of short and of long lists, both sorted."""
    for batch in batches:
        short, long = [], []
        for x in shingle_sets(batch.column(1)):
            ordered, cut = _in_order(x, frequent.value)[0], short_lists(len(x), threshold, step)
            short.append(np.sort(ordered[:cut]).tobytes()), long.append(np.sort(ordered[cut:]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(short, pa.binary()), pa.array(long, pa.binary())], ["node", "short", "long"])


def t_occurrence(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], threshold: tuple[int, int] = THRESHOLD, step: int = STEP) -> bool:
    """Whether two sets, each as its short and its long lists' shingles, link.

    The short lists are merged, the pair leaves if it occurs in too few of them, and the long lists are probed.
    """
    num, den = threshold
    n, m = len(x[0]) + len(x[1]), len(y[0]) + len(y[1])
    if not n or not m:
        return False
    least = -(-num * (n + m) // (num + den))
    found = divide_skip_overlap(x[0], y[0])
    if found < occurrences(min(n, m), step):
        return False
    found += divide_skip_overlap(x[0], y[1]) + divide_skip_overlap(x[1], y[0])
    return found + min(len(x[1]), len(y[1])) >= least and found + divide_skip_overlap(x[1], y[1]) >= least


def _verify(batches: Iterator[pa.RecordBatch], threshold, step) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = ([np.frombuffer(v.as_py(), np.uint64) for v in batch.column(name)] for name in ("xs", "xl", "ys", "yl"))
        keep = [t_occurrence((a, b), (c, d), threshold, step) for a, b, c, d in zip(*sides, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, step: int = STEP, list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest id reachable by links, the row's own included.  A null or empty
    text, or one of separators only, has no shingles, counts 0 and links with nothing.  A row whose
    id is null keeps its count, has a null component and links with nothing.  Rows that repeat an id
    each come out; they are one document and share a component.  Other columns are ignored.
    """
    spark, (num, den) = docs.sparkSession, threshold
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(rows.mapInArrow(_describe, "kind byte, doc_id long, n long, k1 long, k2 long, sketch binary"), "described")
    base = described.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    classes = base.where("doc_id is not null and n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"))
    classes = materialize(classes, "classes")  # joined below as a table, so a class with very many copies can be split
    sketches = described.where("kind = 0 and doc_id is not null and n > 0").select(F.col("doc_id").alias("node"), "sketch")

    frequent = spark.sparkContext.broadcast(_frequent(described))
    lists = rows.where("doc_id is not null").select("text").mapInArrow(lambda it: _short_lists(it, frequent, threshold, step, list_rows), "sh long, k1 long, np long, part long")
    by_list = W.partitionBy("sh", "part")  # parts of a frequent list stay whether or not another set is in the part
    shared = lists.select("*", F.min("k1").over(by_list).alias("low"), F.max("k1").over(by_list).alias("high")).where("low <> high or part > 0")
    shared = materialize(shared.select("sh", "k1", "np").distinct(), "lists")
    nodes = shared.select("k1").distinct().join(classes, "k1").select("k1", "node", "n")
    nodes = materialize(nodes, "nodes")
    members = materialize(shared.join(nodes, "k1").select("sh", "node", "n", F.col("np").bitwiseAND(0xFFFFFFFF).alias("pos")).distinct(), "members")

    known = materialize(nodes.select("node").distinct().join(sketches, "node"), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        if pairs.count() <= BROADCAST_PAIRS:
            wanted, pairs = F.broadcast(wanted), F.broadcast(pairs)  # else both meet the texts by a shuffle
        texts = rows.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
        sets = materialize(texts.mapInArrow(lambda it: _sets(it, frequent, threshold, step), "node long, short binary, long binary"), "sets")
        one = sets.join(pairs, F.col("node") == F.col("a")).select("a", "b", F.col("short").alias("xs"), F.col("long").alias("xl"))
        two = sets.join(pairs, F.col("node") == F.col("b")).select("a", "b", F.col("short").alias("ys"), F.col("long").alias("yl"))
        both = one.join(two, ["a", "b"]).select("a", "b", "xs", "xl", "ys", "yl")
        return both.mapInArrow(lambda it: _verify(it, threshold, step), "a long, b long")

    def possible(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, c, n, m) those that the sketches leave open."""
        one, two = known.toDF("a", "x"), known.toDF("b", "y")
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "c", "n", "m", "x", "y")
        return both.mapInArrow(lambda it: _may_link(it, threshold), "a long, b long, c long")

    def fits(n: str, m: str) -> F.Column:
        return F.least(n, m) * den >= F.greatest(n, m) * num

    def room(n: str, m: str, i: str, j: str) -> F.Column:
        """What two sets can share from these positions on; at their first shared shingle it must suffice."""
        return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * (num + den) >= (F.col(n) + F.col(m)) * num

    size = members.count()
    star = with_group(members, "sh", "node", size, F.min(F.struct("node", "n", "pos")).alias("lead")).where(fits("n", "lead.n") & (F.col("node") != F.col("lead.node")))
    star = star.groupBy("node", F.col("lead.node").alias("lead")).agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("lead.n").alias("m"), F.bool_or(room("n", "lead.n", "pos", "lead.pos")).alias("may"))
    star = possible(star.where("may").select(F.col("node").alias("a"), F.col("lead").alias("b"), "c", "n", "m"))
    best = star.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
    linked = materialize(verified(best), "linked")
    so_far = connected_components(linked)

    placed = members.join(so_far, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    placed = materialize(placed, "placed")
    lists = with_group(placed, "sh", "node", size, F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / list_rows).cast("int").alias("parts"), having="low <> high").drop("low", "high")
    # the smaller set of a pair comes from the left, which is dealt out; the right is copied for each part of a long list
    c = lambda n: F.lit(1) + F.floor(F.col(n) / step)
    posted = F.col("n") - F.ceil(F.col("n") * (2 * num) / (num + den)) + c("n")
    left = lists.where(F.col("pos") < posted).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    right = lists.select("sh", F.col("node").alias("node_b"), F.col("n").alias("m"), F.col("pos").alias("pos_b"), F.col("comp").alias("comp_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("node_b")))
    enough = (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos_b")) + c("n") - 1) * (num + den) >= (F.col("n") + F.col("m")) * num
    pairs = left.join(right, ["sh", "part"]).where(smaller & (F.col("comp") != F.col("comp_b")) & fits("n", "m") & enough)
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("m").alias("m")).where(F.col("c") >= c("n"))
    rest = verified(possible(pairs).select("a", "b").distinct())

    same_id = base.where("doc_id is not null and n_shingles > 0").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"), "k1", "k2")
    several = same_id.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b <> c")
    links = linked.unionByName(rest).unionByName(several.select(F.col("b").alias("a"), F.col("c").alias("b")))
    joined = connected_components(links)
    of_class = classes.join(joined, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    out = base.join(of_class, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
