"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's n-grams (three to five characters, lower-cased, white space as one kind of character) are hashed
to buckets.  Its features are the pairs of a bucket and a level that it reaches: the bucket occurs at least
once, twice, four or eight times, as a word that toxic texts repeat can be a chance word of clean ones.  Over labelled
rows each feature's documents are counted for both labels; its log-count ratio
r = log((p + a) / (P + 2a)) - log((q + a) / (N + 2a)) scales it.  The features that tell the labels apart best
are kept, and a logistic regression, in which both labels weigh the same, is fitted on the scaled features
until it stands still.  Every whole text is scored, in one pass with no shuffle.

Only the fit works on a sample: at most SAMPLE rows of each label, taken by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small_batches

ORDERS = (3, 4, 5)
BUCKET_BITS = 22
#: Occurrences of a bucket that are a feature each.
LEVELS = (1, 2, 4, 8)
#: The most labelled rows of each label that are fitted on.
SAMPLE = 4000
#: The most features that are kept, and the fewest rows that one must be in.
FEATURES = 6000
SUPPORT = 2
SMOOTHING = 1.0
#: Chosen on folds of the fitted rows of sf0.1, as LEVELS was.
PENALTY = 10.0
THRESHOLD = 0.7
SPAN = 1 << 18  # characters that are hashed at a time


class Model(NamedTuple):
    features: np.ndarray  # sorted: a level's place and a bucket
    weights: np.ndarray  # of the features, with the ratios in them
    bias: float


def _hashed(texts: list[str], wanted: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-grams' rows, n-grams' buckets) of the wanted buckets, for spans of rows; a long text comes in parts, each with the n-grams that begin in it."""
    at = 0
    while at < len(texts):
        part, size, first = [], 0, at
        while at < len(texts) and (not part or size + len(texts[at]) <= SPAN):
            part.append(texts[at].lower())
            size += len(part[-1])
            at += 1
        step = SPAN - max(ORDERS)
        cuts = [(k, t[a : a + SPAN]) for k, t in enumerate(part) for a in range(0, max(1, len(t)), step)]
        for group in [cuts] if len(cuts) == len(part) else [[c] for c in cuts]:
            chars = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "replace"), np.uint32)
            rows = np.repeat(np.array([k for k, _ in group], np.int32), [len(t) for _, t in group])
            code = np.where((chars == 32) | (chars - np.uint32(9) < 5), np.uint32(32), chars) * np.uint32(2654435761)
            h = code
            for n in range(2, max(ORDERS) + 1):
                if len(h) < 2:
                    break
                h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
                if n in ORDERS:
                    mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                    buckets = mixed >> np.uint32(32 - BUCKET_BITS)
                    hit = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted[buckets])
                    hit = hit[rows[hit] == rows[hit + n - 1]]
                    if len(cuts) > len(part):
                        hit = hit[hit < step]
                    yield first, rows[hit], buckets[hit]


def _levels(texts: list[str], features: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) pairs, each once, for spans of whole rows; of the given features only, as places among them, if given."""
    for first, parts in groupby(_hashed(texts, None if features is None else _table(features)), itemgetter(0)):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, rows, buckets in parts:
            keys, counts = _merged(keys, counts, (rows.astype(np.int64) + first) << BUCKET_BITS | buckets)
        for level, least in enumerate(LEVELS):
            key = keys[counts >= least]
            rows, found = key >> BUCKET_BITS, level << BUCKET_BITS | key & (1 << BUCKET_BITS) - 1
            if features is not None:
                place = np.searchsorted(features, found)
                there = features[np.minimum(place, len(features) - 1)] == found if len(features) else np.zeros(0, bool)
                rows, found = rows[there], place[there]
            yield rows, found


def _merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts, with further keys counted in."""
    more, count = np.unique(more, return_counts=True)
    if not len(keys):
        return more, count
    keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([counts, count])).astype(np.int64)


def _features(texts: list[str], features: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all spans."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_levels(texts, features)]
    return np.concatenate([rows for rows, _ in found]), np.concatenate([places for _, places in found])


def _texts(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top = len(LEVELS) << BUCKET_BITS
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for rows, found in _levels(_texts(batch.column(1))):
            keys, counts = _merged(keys, counts, labels[rows] * top + found)
    toxic = keys >= top
    yield pa.RecordBatch.from_arrays([pa.array(keys % top), pa.array(np.where(toxic, 0, counts)), pa.array(np.where(toxic, counts, 0))], ["feature", "q", "p"])


def _table(features: np.ndarray) -> np.ndarray:
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[features & (1 << BUCKET_BITS) - 1] = True
    return wanted


def _fit(rows: np.ndarray, features: np.ndarray, scale: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of the scaled features by Newton steps, whose equations conjugate gradients solve.

    Both labels weigh the same in all, so a score of 0.5 is even odds between them.
    """
    n, most, value = len(labels), len(scale), scale[features]
    weigh = np.where(labels == 1, (n - labels.sum()) / max(labels.sum(), 1), 1.0)
    penalty = np.append(np.full(most, PENALTY), 1e-6)

    def margin(theta: np.ndarray) -> np.ndarray:
        return np.bincount(rows, value * theta[features], n) + theta[-1]

    def gather(of_rows: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(features, value * of_rows[rows], most), of_rows.sum())

    def loss(theta: np.ndarray, m: np.ndarray) -> float:
        return float(weigh @ (np.logaddexp(0, m) - labels * m) + penalty @ theta**2 / 2)

    theta = np.zeros(most + 1)
    m = margin(theta)
    now = loss(theta, m)
    for _ in range(50):
        likely = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        slope = gather(weigh * (likely - labels)) + penalty * theta
        bend = weigh * likely * (1 - likely)
        step, rest = np.zeros(most + 1), -slope
        along, size = rest, rest @ rest
        goal = 1e-6 * size
        for _ in range(100):
            if size <= goal:
                break
            bent = gather(bend * (np.bincount(rows, value * along[features], n) + along[-1])) + penalty * along
            far = size / (along @ bent)
            step, rest = step + far * along, rest - far * bent
            along, size = rest + rest @ rest / size * along, rest @ rest
        part = 1.0
        while part > 1e-6 and loss(theta + part * step, margin(theta + part * step)) > now:
            part /= 2
        theta = theta + part * step
        m = margin(theta)
        before, now = now, loss(theta, m)
        if before - now <= 1e-9 * before:
            break
    return theta[:-1], float(theta[-1])


def held_out(id_col: F.Column | str) -> F.Column:
    """Rows kept from the fit: crc32 of the id as text has the remainder 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that are not held out.

    Rows with a null id or label are left out; an id with several labels counts as its largest, one with several
    texts as the least.  With
    no rows of one label the model has no features and scores everything at the labels' share.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out("doc_id"))
    totals = {r["label"]: r["c"] for r in known.groupBy("label").agg(F.count("*").alias("c")).collect()}
    if not totals.get(0) or not totals.get(1):
        share = 1e-3 if not totals.get(1) else 1 - 1e-3
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    share = F.when(F.col("label") == 1, min(1.0, sample / totals[1])).otherwise(min(1.0, sample / totals[0]))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most about 2 * sample ids
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")  # rows that repeat an id count once, so the bound holds
    rows = materialize(rows, "labelled").repartition(max(1, min(64, spark.sparkContext.defaultParallelism)))

    counts = rows.mapInArrow(_count, "feature long, q long, p long").groupBy("feature").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    size = {r["label"]: r["c"] for r in rows.groupBy("label").agg(F.count("*").alias("c")).collect()}
    n, m, a = size.get(0, 0), size.get(1, 0), SMOOTHING
    p, q = F.col("p"), F.col("q")
    off = p * n - q * m
    apart = off * off / ((p + q) * (n + m - p - q) + 1)
    best = counts.where(p + q >= SUPPORT).withColumn("apart", apart).orderBy(F.desc("apart"), "feature").limit(FEATURES).toPandas().sort_values("feature")
    kept = best["feature"].to_numpy()
    ratio = np.log((best["p"].to_numpy() + a) / (m + 2 * a)) - np.log((best["q"].to_numpy() + a) / (n + 2 * a))

    shared = spark.sparkContext.broadcast(kept)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = _features(_texts(batch.column(1)), shared.value)
            order = np.argsort(at, kind="stable")
            at, found = at[order], found[order].astype(np.int32)
            edges = np.searchsorted(at, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["label", "found"])

    fitted = rows.mapInArrow(sparse, "label int, found binary").toPandas()  # at most 2 * sample rows of kept features
    found = [np.frombuffer(x, np.int32) for x in fitted["found"]]
    at = np.repeat(np.arange(len(found)), [len(x) for x in found])
    weights, bias = _fit(at, np.concatenate([np.zeros(0, np.int32), *found]), ratio, fitted["label"].to_numpy(float))
    return Model(kept, weights * ratio, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null or empty text has no features and scores the model's bias.  Null and repeated ids are kept
    (a null id is not held out); other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1)))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns; one pass without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(place)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _scorer(model: Model) -> Callable[[pa.Array], np.ndarray]:
    features, weights, bias = model

    def score_column(column: pa.Array) -> np.ndarray:
        rows, found = _features(_texts(column), features)
        total = np.bincount(rows, weights[found], len(column)) if len(found) else np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(total + bias, -40, 40)))

    return score_column
