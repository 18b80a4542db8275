"""Suffixes in order, with common prefixes, by induced sorting with disk-backed queues.

Suffixes are of type L where they are greater than the next one and S otherwise; an S after an L begins a
piece.  Pieces are sorted and named, the string of names is sorted by recursion, and two inductions follow: popping the
sorted beginnings in order pushes all L suffixes in order, and popping those in reverse pushes all S suffixes.

A queue's tuple holds the first character, the suffix, and what it has in common with the tuple pushed before it
for that character.  That value is one more than the least common prefix popped since that push, and is
known when the tuple is pushed: common prefixes are capped, so for each of the few values the last pop at or
below it answers every such question, and no popped tuple has to be kept.  Tuples wait in ranges of characters;
the tuples of a range are first needed when it is reached, and whatever exceeds the memory bound waits in files.

Tuples are popped many at a time: a run of them may leave together if nothing that it pushes comes before its
end.  The string itself stays in memory, with a name for each piece; all that the queues and tapes hold is bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs

#: Common prefixes are counted up to here.
CAP = 255
TUPLE = np.dtype([("char", "<i4"), ("suffix", "<i4"), ("common", "u1")])
#: Tuples that are sorted at a time in a range, and popped at a time.
RANGE, BATCH = 2048, 1 << 16
_PEEK = 512


class Store:
    """Arrays of tuples by key, in files of a folder beyond ``memory`` bytes.

    The folder must be one that a task may write to wherever it runs, as the shared one; without it everything
    stays in memory.
    """

    def __init__(self, memory: int, fs: pyarrow.fs.FileSystem | None = None, folder: str = ""):
        self.memory, self.fs, self.folder = memory, fs, folder
        self.held: dict[int, list[np.ndarray]] = {}
        self.filed: dict[int, list[tuple[str, int, int]]] = {}
        self.size, self.files, self.written = 0, [], 0

    def append(self, key: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        self.held.setdefault(key, []).append(rows)
        self.size += rows.nbytes
        if self.size > self.memory and self.fs is not None:
            self._file()

    def _file(self) -> None:
        path, at = f"{self.folder}/{uuid.uuid4().hex}", 0
        with self.fs.open_output_stream(path, compression=None) as out:
            for key, parts in sorted(self.held.items()):
                for rows in parts:
                    out.write(rows.tobytes())
                    self.filed.setdefault(key, []).append((path, at, rows.nbytes))
                    at += rows.nbytes
        self.files.append(path)
        self.written += at
        self.held, self.size = {}, 0

    def _read(self, path: str, at: int, size: int) -> np.ndarray:
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read_at(size, at), TUPLE)

    def pop(self, key: int) -> Iterator[np.ndarray]:
        """The arrays of a key in the order they came, also those that come meanwhile."""
        while self.filed.get(key) or self.held.get(key):
            if self.filed.get(key):
                yield self._read(*self.filed[key].pop(0))
            else:
                rows = np.concatenate(self.held.pop(key))
                self.size -= rows.nbytes
                yield rows

    def close(self) -> None:
        for path in self.files:
            self.fs.delete_file(path)
        self.files = []


def _tuples(char: np.ndarray, suffix: np.ndarray, common: np.ndarray) -> np.ndarray:
    out = np.empty(len(suffix), TUPLE)
    out["char"], out["suffix"], out["common"] = char, suffix, common
    return out


def kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are of type L, and how often each one's first character stands there in a row."""
    n = len(text)
    last = np.full(n, n - 1)
    last[:-1] = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    last = np.minimum.accumulate(last[::-1])[::-1]
    is_l = np.zeros(n, bool)
    is_l[:-1] = text[last[:-1]] > text[np.minimum(last[:-1] + 1, n - 1)]
    return is_l, (last - np.arange(n) + 1).astype(np.int32)


class _Since:
    """The least common prefix popped since a pop, and since the last push of each character."""

    def __init__(self, alphabet: int):
        self.now, self.last = 0, np.full(CAP + 1, -1)  # for each value, the last pop at or below it
        self.pushed = np.full(alphabet, -1)  # for each character, the pop that last pushed it

    def push(self, common: np.ndarray, at: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """What each push has in common with the one before it for its character; ``common`` are a batch's pops, ``at`` the places of those that push."""
        least = self._least(common, at, chars) if len(at) else np.zeros(0, np.int64)
        last = np.full(CAP + 1, -1)
        last[common] = self.now + np.arange(len(common))
        self.last = np.maximum(self.last, np.maximum.accumulate(last))
        self.now += len(common)
        return np.minimum(least + 1, CAP).astype(np.uint8)

    def _least(self, common: np.ndarray, at: np.ndarray, chars: np.ndarray) -> np.ndarray:
        order = np.argsort(chars, kind="stable")
        at, sorted_chars = at[order], chars[order]
        first = np.r_[True, sorted_chars[1:] != sorted_chars[:-1]]
        least = np.empty(len(at), np.int64)
        before = self.pushed[sorted_chars[first]]
        least[first] = np.minimum(np.searchsorted(self.last, before, "right"), np.minimum.accumulate(common)[at[first]])
        least[first] = np.where(before < 0, -1, least[first])
        again = np.flatnonzero(~first)
        if len(again):
            table = [common]
            low, high = at[again - 1] + 1, at[again] + 1
            power = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in range(int(power.max())):
                table.append(np.minimum(table[-1][: -(1 << k)], table[-1][1 << k :]))
            for k, row in enumerate(table):
                mine = power == k
                least[again[mine]] = np.minimum(row[low[mine]], row[high[mine] - (1 << k)])
        self.pushed[sorted_chars] = self.now + at  # of equal characters the last one stays
        out = np.empty(len(at), np.int64)
        out[order] = least
        return out


def induce(chars: np.ndarray, pushes: np.ndarray, runs: np.ndarray, alphabet: int, seeds: Iterator[np.ndarray], store: Store) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(suffixes, common prefixes with the one before, which are seeds), in batches in order.

    ``seeds`` are sorted tuples; popping a suffix pushes the one before it where ``pushes`` allows.  Of one character the pushed come
    before the seeds.
    """
    counts = np.bincount(chars[pushes], minlength=alphabet)
    starts = np.cumsum(counts) - counts
    big = counts > RANGE
    new = np.r_[True, (starts[1:] // RANGE != starts[:-1] // RANGE) | big[1:] | big[:-1]]
    range_of = np.cumsum(new) - 1
    first_char = np.flatnonzero(new)
    last_char = np.r_[first_char[1:], alphabet] - 1
    since, staged = _Since(alphabet), []
    before = np.array([-1, -1, 0])  # the last pop: its character, suffix, and whether it was a seed

    def settle(rows: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop a batch; its pushes are staged."""
        char, suffix, common = rows["char"], rows["suffix"], rows["common"].copy()
        meets = np.flatnonzero(seed & ~np.r_[before[2] > 0, seed[:-1]])  # a seed after a pushed one
        if len(meets):
            other_char = np.where(meets > 0, char[meets - 1], before[0])
            other = np.where(meets > 0, suffix[meets - 1], before[1])
            alike = other_char == char[meets]
            common[meets] = np.where(alike, np.minimum(np.minimum(runs[other], runs[suffix[meets]]), CAP), 0)
        if len(rows) and char[0] != before[0]:
            common[0] = 0
        common[1:][char[1:] != char[:-1]] = 0
        before[:] = char[-1], suffix[-1], seed[-1]
        at = np.flatnonzero((suffix > 0) & pushes[suffix - 1])
        pushed = suffix[at] - 1
        staged.append(_tuples(chars[pushed], pushed, since.push(common, at, chars[pushed])))
        return suffix, common, seed

    def stage() -> np.ndarray:
        rows = np.concatenate(staged) if staged else np.zeros(0, TUPLE)
        staged.clear()
        return rows

    def store_all(rows: np.ndarray) -> None:
        own = range_of[rows["char"]]
        order = np.argsort(own, kind="stable")
        rows, own = rows[order], own[order]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(rows) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            store.append(int(own[a]), rows[a:b])

    left = np.zeros(0, TUPLE)

    def seeds_to(char: int) -> Iterator[np.ndarray]:
        """Seeds up to a character."""
        nonlocal left
        while True:
            k = int(np.searchsorted(left["char"], char, "right"))
            if k:
                yield left[:k]
            left = left[k:]
            if len(left):
                return
            left = next(seeds, None)
            if left is None:
                left = np.zeros(0, TUPLE)
                return

    for g, (low, high) in enumerate(zip(first_char, last_char, strict=True)):
        if low == high:  # one character: what is pushed for it comes last
            for rows in store.pop(g):
                for k in range(0, len(rows), BATCH):
                    yield settle(rows[k : k + BATCH], np.zeros(len(rows[k : k + BATCH]), bool))
                    store_all(stage())
            for rows in seeds_to(high):
                for k in range(0, len(rows), BATCH):
                    yield settle(rows[k : k + BATCH], np.ones(len(rows[k : k + BATCH]), bool))
            store_all(stage())
            continue
        waiting, given = list(store.pop(g)), list(seeds_to(high))
        rows = np.concatenate([*waiting, *given]) if waiting or given else np.zeros(0, TUPLE)
        key = 2 * rows["char"].astype(np.int64)
        key[len(key) - sum(map(len, given)) :] += 1
        order = np.argsort(key, kind="stable")
        rows, key, later = rows[order], key[order], []
        while len(rows):
            peek = rows["suffix"][:_PEEK]
            least = np.where((peek > 0) & pushes[peek - 1], 2 * chars[peek - 1].astype(np.int64), 2 * alphabet)
            fits = np.minimum.accumulate(least) >= key[:_PEEK]
            n = len(fits) if fits.all() else max(1, int(fits.argmin()))
            yield settle(rows[:n], (key[:n] & 1).astype(bool))
            fresh = stage()
            here = fresh["char"] <= high
            later.append(fresh[~here])
            rows, key = rows[n:], key[n:]
            if here.any():
                rows, key = np.concatenate([rows, fresh[here]]), np.concatenate([key, 2 * fresh["char"][here].astype(np.int64)])
                order = np.argsort(key, kind="stable")
                rows, key = rows[order], key[order]
        if later:
            store_all(np.concatenate(later))


def _names(text: np.ndarray, is_l: np.ndarray, at: np.ndarray, alphabet: int) -> np.ndarray:
    """The rank of each piece among the distinct pieces; a piece ends with the beginning of the next one."""
    symbols = 2 * text.astype(np.int64) + ~is_l
    sizes = np.r_[np.diff(at), 0] + 1
    bits = int(2 * alphabet).bit_length()
    width = max(1, 63 // bits)
    rank, active, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(active):
        word = np.zeros(len(active), np.int64)
        for k in range(done, done + width):
            inside = k < sizes[active]
            word = (word << bits) + np.where(inside, symbols[np.minimum(at[active] + k, len(text) - 1)] + 1, 0)
        order = np.lexsort((word, rank[active]))
        active, word = active[order], word[order]
        old = rank[active]
        group = np.r_[True, old[1:] != old[:-1]]
        fresh = group | np.r_[True, word[1:] != word[:-1]]
        begin = np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        own = np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))
        rank[active] = old + own - begin
        alone = fresh & np.r_[fresh[1:], True]
        done += width
        active = active[~alone & (sizes[active] > done)]
    return np.unique(rank, return_inverse=True)[1]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common prefixes, capped, of suffixes that are known to share ``known`` characters."""
    known = np.minimum(known, CAP)
    live = np.flatnonzero(known < CAP)
    while len(live):
        live = live[text[a[live] + known[live]] == text[b[live] + known[live]]]
        known[live] += 1
        live = live[known[live] < CAP]
    return known


def suffixes_downwards(text: np.ndarray, alphabet: int, new_store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, common prefixes with the one before, up to CAP), in batches from the greatest suffix down.

    ``text`` ends in a 0 that stands nowhere else; that suffix itself is left out.  ``new_store`` makes a Store.
    """
    n = len(text)
    if n < 2:
        return
    is_l, runs = kinds(text)
    at = np.flatnonzero(~is_l & np.r_[False, is_l[:-1]])
    names = _names(text, is_l, at, alphabet)
    distinct = int(names.max()) + 1
    if distinct == len(at):
        order, shared = np.argsort(names), np.zeros(len(at), np.int64)
    else:
        parts = list(suffixes_downwards(names.astype(np.int32), distinct, new_store))
        order = np.r_[len(at) - 1, np.concatenate([p[0] for p in parts])[::-1]]
        down = np.concatenate([p[1] for p in parts])[::-1].astype(np.int64)
        shared = np.r_[0, 0, down[:-1]]
    begin = at[order]
    common = np.zeros(len(at), np.int64)
    common[1:] = _common(text, begin[:-1], begin[1:], at[np.minimum(order[1:] + shared[1:], len(at) - 1)] - begin[1:])
    del names

    tape, queue = new_store(), new_store()
    seeds = (_tuples(text[begin[k : k + BATCH]], begin[k : k + BATCH], common[k : k + BATCH]) for k in range(0, len(begin), BATCH))
    chunk = 0
    for suffix, near, seed in induce(text, is_l, runs, alphabet, seeds, queue):
        tape.append(chunk, _tuples(alphabet - 1 - text[suffix[~seed]], suffix[~seed], near[~seed]))
        chunk += 1
    queue.close()

    def backwards() -> Iterator[np.ndarray]:
        """The L suffixes from the greatest down; each has with the one before it what that one had with it."""
        after = 0
        for k in reversed(range(chunk)):
            for rows in tape.pop(k):
                rows = rows[::-1].copy()
                near = rows["common"].copy()
                rows["common"], after = np.r_[after, near[:-1]], near[-1]
                yield rows

    is_s = ~is_l
    is_s[n - 1] = False
    queue = new_store()
    for suffix, near, _ in induce((alphabet - 1 - text).astype(np.int32), is_s, runs, alphabet, backwards(), queue):
        yield suffix, near
    queue.close()
    tape.close()


def repeated_starts(segments: list[bytes], least: int, memory: int = 1 << 28, fs: pyarrow.fs.FileSystem | None = None, folder: str = "", middles: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """For each segment, which of its strings of ``least`` characters start anywhere else in the segments.

    Characters are bytes; ``middles`` may insert one more in each segment, a number before its byte of some place.
    Every segment ends in a character of its own, so nothing common reaches beyond it.  ``memory`` bounds each of the
    queues, tapes included.
    """
    if not 0 < least <= CAP:
        raise ValueError(f"strings of 1 to {CAP} characters can be found")
    sizes = np.array([len(s) for s in segments], np.int64) + (middles is not None)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
    ends = begin + sizes
    inside = np.ones(len(text), bool)
    inside[ends], inside[-1] = False, False
    text[ends], numbers = 1 + np.arange(len(segments)), 1 + len(segments)
    if middles is not None:
        inside[begin + middles[0]] = False
        distinct, number = np.unique(middles[1], return_inverse=True)
        text[begin + middles[0]], numbers = numbers + number, numbers + len(distinct)
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int32) + numbers
    found, last = np.zeros(len(text), bool), -1
    for suffix, common in suffixes_downwards(text, numbers + 256, lambda: Store(memory, fs, folder)):
        again = np.flatnonzero(common >= least)
        found[suffix[again]] = True
        found[np.where(again > 0, suffix[again - 1], last)] = True
        last = suffix[-1]
    return [found[b : b + max(0, n - least + 1)] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
