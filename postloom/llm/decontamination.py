"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles n into classes (u / 2, u].  A MinHash sketch of an
item is its k shingles of the least hash (bottom-k); documents are not sketched, since a long document's
sketch would say nothing about a short item, but every shingle of a document probes the sketches.  An
item that a document contains at t or more lacks at most n - ceil(t n) of its shingles there, so with
k = n - ceil(t n) + 1 at least one of the sketch is in the document, however long the document is and
however scattered the item lies in it: the search misses nothing.  The sketch's size goes by the item's
size, and so does the least document that can hold it: a class is probed only by documents that have as
many shingles as its smallest item needs.  Every candidate is verified by the exact containment of the item's
distinct 5-word shingles in the whole document.

Documents are only scanned: the items are sent to the tasks in blocks of a bounded size, with a pass
over the documents for each block, so there is no shuffle and no group of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small_batches
from .shingles import mix, shingle_sets

CONTAINMENT = (80, 100)
#: Items, and shingles of items, that are sent to the tasks at a time (8 bytes a shingle).
BLOCK_ITEMS, BLOCK_SHINGLES = 100_000, 4_000_000
_FILTER_BITS = 22


def sketch_size(n: int, threshold: tuple[int, int] = CONTAINMENT) -> int:
    """k: so many shingles of an item of n that each document with enough of them has one."""
    num, den = threshold
    return n - -(-num * n // den) + 1


class Index:
    """The sketches of a block of items, by size class."""

    def __init__(self, items: list[np.ndarray], threshold: tuple[int, int] = CONTAINMENT):
        self.items = items
        #: (least number of shingles that a document needs, the sketches' shingles in order, their items).
        self.classes: list[tuple[int, np.ndarray, np.ndarray]] = []
        #: A bit for the low bits of every sketched shingle.
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        by_class: dict[int, list[int]] = {}
        for k, x in enumerate(items):
            by_class.setdefault((len(x) - 1).bit_length(), []).append(k)
        for _, own in sorted(by_class.items()):
            sketches = [items[k][np.argsort(mix(items[k]), kind="stable")[: sketch_size(len(items[k]), threshold)]] for k in own]
            flat, owner = np.concatenate(sketches), np.repeat(own, [len(x) for x in sketches])
            order = np.argsort(flat, kind="stable")
            least = min(len(items[k]) for k in own)
            self.classes.append((-(-threshold[0] * least // threshold[1]), flat[order], owner[order]))
            self.table[self._low(flat)] = True

    @staticmethod
    def _low(x: np.ndarray) -> np.ndarray:
        return (x & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def candidates(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Sorted (document's place, item's place) pairs where the document has a shingle of the item's sketch."""
        if not self.classes or not sets:
            return []
        sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        hit = np.flatnonzero(self.table[self._low(flat)])
        doc, x = np.repeat(np.arange(len(sets)), sizes)[hit], flat[hit]
        found = [np.zeros((0, 2), np.int64)]
        for least, keys, owner in self.classes:
            big = np.flatnonzero(sizes[doc] >= least)
            low, high = np.searchsorted(keys, x[big]), np.searchsorted(keys, x[big], "right")
            times = high - low
            item = owner[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            found.append(np.unique(np.stack([np.repeat(doc[big], times), item], axis=1), axis=0))
        return sorted(map(tuple, np.concatenate(found).tolist()))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): a row for each document row and item row with 100 * n_shared >= 80 * n_item_shingles.

    Null, empty and blank texts hold nothing and are found nowhere.  An item of fewer than five words is
    one shingle, its whole sequence, which only a document of the same few words has.  Repeated rows
    give repeated results; null ids are kept; other columns are ignored.  Texts of any length are searched whole;
    of items, the longest one must fit a task.
    """
    spark, (num, den) = docs.sparkSession, threshold
    small_batches(spark)
    item_kind, doc_kind = items.schema[item_id_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_item_shingles long, n_shared long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["item_id", "n", "shingles"])

    stored = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    stored = stored.mapInArrow(cut, f"item_id {item_kind}, n long, shingles binary").where("n > 0")
    stored = materialize(stored.withColumn("place", F.monotonically_increasing_id()), "items")  # tells repeated rows apart
    size = stored.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
    blocks = max(1, -(-size["c"] // BLOCK_ITEMS), -(-(size["n"] or 0) // BLOCK_SHINGLES))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(block: DataFrame) -> DataFrame:
        held = block.select("item_id", "shingles").toArrow()  # of a bounded size
        shared = spark.sparkContext.broadcast((held.column("item_id").combine_chunks(), held.column("shingles").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, sets = shared.value
            index = Index([np.frombuffer(x, np.uint64) for x in sets], threshold)
            for batch in batches:
                own, out = list(shingle_sets(batch.column(1))), []
                for doc, item in index.candidates(own):
                    x = index.items[item]
                    there = np.searchsorted(own[doc], x)
                    there[there == len(own[doc])] = 0
                    n = int(np.count_nonzero(own[doc][there] == x))
                    if den * n >= num * len(x):
                        out.append((doc, item, len(x), n))
                doc, item, m, n = (pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 4))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), names.take(item), m, n], ["doc_id", "item_id", "n_item_shingles", "n_shared"])

        return rows.mapInArrow(run, schema)

    found = search(stored) if blocks == 1 else None
    for k in range(blocks if blocks > 1 else 0):
        one = search(stored.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == k))
        found = one if found is None else found.unionByName(one)
    return found
