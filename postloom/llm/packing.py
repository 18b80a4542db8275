"""Sum-of-squares online packing of token sequences.

A task packs the documents of its own partition in their order.  A document's full windows are cut
off; its remainder goes to the fill level that minimises the sum of squared counts of partially
filled windows.  That sum changes by 2 * (N[h + s] - N[h]) + 2 when a remainder of s tokens moves a
window from level h to h + s, where N is the level array; by 1 - 2 * N[h] when it fills the window, which
closes; and by 2 * N[s] + 1 when it opens a new one; so one vector operation over the levels places it.
When the partition ends, the windows left partial are refilled from each other, cutting pieces where
a window is full; the last one is cut so that the rest is a sum of powers of two, which need no
padding.  State is the level array and the pieces of partial windows, whose ids are held at two bytes
each where the vocabulary allows it; so memory is bounded by the partition, however many windows stay open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import small_batches
from .shingles import text_buffer
from .token_counts import TOKENIZER, tokenizer_path
from .tokenizer_fst import compiled

CAPACITY = 2048
END_ID = 1

Piece = tuple[int, int, int]  # (document's index, start, length)


class SumOfSquares:
    """The online packer: yields closed windows as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # N, the level array
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of fewer than capacity tokens; the window it fills, if any."""
        size, n = piece[2], self.count
        change = 2 * (n[size:] - n[: self.capacity - size + 1]) + 2
        change[-1] -= 1  # a window that closes leaves no level behind
        change[n[: len(change)] == 0] = np.iinfo(np.int64).max  # no window has that level
        change[0] = 2 * n[size] + 1  # a new window
        level = int(change.argmin())
        if level:
            window = self.windows[level].pop()
            n[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.windows[level + size].append(window)
        n[level + size] += 1
        self.open += 1
        return None

    def drain(self) -> Iterator[list[Piece]]:
        """Close all windows, the fullest first, refilling them from each other."""
        window, room = [], self.capacity
        for level in range(self.capacity, 0, -1):
            while self.windows[level]:
                self.open -= 1
                self.count[level] -= 1
                for doc, start, length in self.windows[level].pop():
                    while length:
                        take = min(length, room)
                        window.append((doc, start, take))
                        start, length, room = start + take, length - take, room - take
                        if not room:
                            yield window
                            window, room = [], self.capacity
        left = self.capacity - room
        while left:  # a window for each power of two in what is left
            room = 1 << left.bit_length() - 1
            left -= room
            part, rest = [], []
            for doc, start, length in window:
                take = min(length, room)
                room -= take
                if take:
                    part.append((doc, start, take))
                if length > take:
                    rest.append((doc, start + take, length - take))
            yield part
            window = rest


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A document is its text's ids and then END_ID, so a null or empty text is one id.  Every id lies in
    exactly one piece.  sequence_id is unique over all partitions: the partition's number in the high
    bits, the window's in the low 40.  Rows that repeat an id are separate documents; a null id is
    kept.  Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, packer = compiled(tokenizer_path(tokenizer)), SumOfSquares(capacity)
        narrow = np.uint16 if machine.largest < 1 << 16 else np.uint32
        sequence = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # a document's id, ids from its remainder on, where they begin, number of its ids, of those to come
        rows: list[tuple] = []

        def out(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length in window:
                name, ids, base, size, left = held[doc]
                rows.append((name, start, length, zlib.crc32(ids[start - base : start - base + length].astype("<u4").tobytes()), size, sequence, offset))
                offset += length
                if left == length:
                    del held[doc]
                else:
                    held[doc][4] = left - length
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(x, pa.int64()) for x in columns[1:])], names)

        number, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, ids in zip(batch.column(0).to_pylist(), machine.encode(*text_buffer(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(END_ID))
                held[number] = [name, ids, 0, len(ids), len(ids)]
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    out([(number, start, capacity)])
                if whole < len(ids):
                    held[number][1:3] = ids[whole:].astype(narrow), whole
                if whole < len(ids) and (window := packer.place((number, whole, len(ids) - whole))):
                    out(window)
                number += 1
            yield batch_of()
        for window in packer.drain():
            out(window)
        yield batch_of()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[1:]))
