"""Word hashes and 5-word shingle sets of whole texts, computed on Arrow buffers with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A word is read
in blocks of eight bytes, each mixed into the hash by a bijection of 64 bits, so words of up to eight
bytes have different hashes and longer ones meet by chance only; very long words are hashed by
BLAKE2b.  No Python object is made per word.  A shingle's hash mixes those of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SEGMENT = 1 << 20  # bytes that are hashed at a time
_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.uint64(0x9E3779B97F4A7C15)
#: Longer byte strings are hashed by BLAKE2b instead of block by block.
LONG_BYTES = 64
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of a block's bytes, those of its word

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, zeros beyond the end, as 64-bit values."""
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 8,), "<u8", padded.data, 0, (1,))


def hash_slices(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings of ``raw`` that begin at ``first`` and have ``size`` bytes."""
    blocks = eight_bytes(raw)
    out = mix(size.astype(np.uint64) * _WORD)
    short = size <= LONG_BYTES
    live = np.arange(len(first)) if short.all() else np.flatnonzero(short)
    at, left = first[live], size[live]
    while len(live):
        out[live] = mix(out[live] * _STEP + (blocks[at] & KEEP[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(~short).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[first[k] : first[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw, bounds - bounds[0]


def _pieces(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SEGMENT that end at a row's end or at a separator."""
    at, end = 0, len(raw)
    while at < end:
        stop = min(at + SEGMENT, end)
        if stop < end:
            row_end = bounds[np.searchsorted(bounds, stop, "right") - 1]
            if row_end > at:
                stop = int(row_end)
            else:
                gap = np.flatnonzero(_SEPARATOR[raw[at:stop]])
                while not len(gap) and stop < end:
                    further = min(stop + SEGMENT, end)
                    gap = np.flatnonzero(_SEPARATOR[raw[stop:further]]) + (stop - at)
                    stop = further
                stop = at + int(gap[-1]) + 1 if len(gap) else end
                row_end = bounds[np.searchsorted(bounds, at, "right")]
                stop = min(stop, int(row_end))
        yield at, stop
        at = stop


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and each row's first word's index (one more entry at the end)."""
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, stop in _pieces(raw, bounds):
        part = raw[at:stop]
        word = ~_SEPARATOR[part]
        edges = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop, "right")] - at
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[edges[edges < len(part)]] = False
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[edges[edges > 0] - 1] = False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        hashes.append(hash_slices(_LOWER[part], first, last + 1 - first))
        begins.append(first + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)


def shingle_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its shingles' hashes in order, with repeats.

    Fewer than five words make one shingle of the whole sequence; no words make none.
    """
    hashes, rows = word_hashes(*text_buffer(column))
    full = np.zeros(max(0, len(hashes) - SHINGLE_WORDS + 1), np.uint64)
    for k in range(SHINGLE_WORDS):
        full = full * _STEP + hashes[k : k + len(full)]
    full = mix(full)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            yield full[a : b - SHINGLE_WORDS + 1]
        elif b > a:
            x = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                x = x * _STEP + h
            yield mix(x + np.uint64(b - a))
        else:
            yield hashes[:0]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its distinct shingles' hashes, sorted."""
    for x in shingle_lists(column):
        x = np.sort(x)
        yield x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
