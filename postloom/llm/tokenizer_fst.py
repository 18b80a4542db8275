"""Finite-state compilation of a byte-level BPE tokenizer whose output equals the library's.

Two deterministic transducers are composed.

* The *splitter* reads characters' symbols and marks where pretokens begin.  It has twelve states;
  a mark may lie one character back, which is all the look-ahead that the pattern needs.  A text is
  cut into chunks; each chunk's map from entry state to exit state is computed for all chunks and all
  entry states at once, the maps are composed by a parallel prefix scan, and then every chunk is run
  from its true entry state.
* The *piece transducer* reads a pretoken's bytes, in blocks of up to eight.  It is a deterministic, acyclic
  transducer: its states are prefixes, and the transition from p by a block b emits count(pb) - count(p)
  tokens, where count is the number of tokens that the model's merges leave.  So the emissions on a path
  add up to the count of its last state, which is where they are read.  The vocabulary is compiled when a
  worker starts; states that it does not have are compiled when a text first reaches them.  Transitions
  are found by their exact (state, block); no pretoken is looked up by a hash alone.

Pretokens of more than PATH bytes get no states; their merges are run where they stand, longest by a heap.
Added special tokens inside a text are cut out first, as the library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np

from .shingles import KEEP, eight_bytes

#: The splitter's input symbols.
STMD, R, V, ELL, E, LETTER, NUMBER, OTHER, QUOTE, SPACE, BLANK, RESET = range(12)
#: Its states: nothing read; in letters, numbers, others; one or several white-space characters, the
#: last a space or another; an opening quote, and one with r, v, l; a contraction is complete.
START, LET, NUM, OTH, SP1, SPN, WS1, WSN, APO, APO_R, APO_V, APO_L, DONE = range(13)
CHUNK = 128
#: After so many symbols most chunks' maps are constant and are followed as one state.
SETTLE = 8
#: Bytes that are run at a time.
SPAN = 1 << 21
#: The longest pretoken that the piece transducer has states for, and the states that it keeps compiled.
PATH = 32
KEPT = 800_000
#: Longer pretokens are merged by a heap, one by one.
HEAP = 512


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and symbol; mark 1: a pretoken begins here, 2: one character back."""
    to, marks = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    letters = (STMD, R, V, ELL, E, LETTER)
    fresh = {**dict.fromkeys(letters, LET), NUMBER: NUM, OTHER: OTH, QUOTE: APO, SPACE: SP1, BLANK: WS1}
    runs = {LET: letters, NUM: (NUMBER,), OTH: (OTHER, QUOTE)}
    for state in (START, DONE, *runs):
        for x, then in fresh.items():
            to[state, x], marks[state, x] = then, 1
        for x in runs.get(state, ()):
            to[state, x], marks[state, x] = state, 0
    for state, mark in ((SP1, 0), (SPN, 2), (WS1, 1), (WSN, 3)):
        for x, then in fresh.items():
            if x in (SPACE, BLANK):
                to[state, x] = SPN if x == SPACE else WSN
            else:
                to[state, x], marks[state, x] = OTH if x == QUOTE and state in (SP1, SPN) else then, mark
    to[APO], marks[APO] = to[OTH], marks[OTH]
    to[APO, STMD], marks[APO, STMD] = DONE, 0
    for x, state, ends in ((R, APO_R, E), (V, APO_V, E), (ELL, APO_L, ELL)):
        to[APO, x], marks[APO, x] = state, 0
        to[state], marks[state] = to[LET], marks[LET] | 2
        to[state, ends], marks[state, ends] = DONE, 0
        marks[state, RESET] = 2
    to[:, RESET] = START
    return to, marks


def compose(maps: np.ndarray) -> np.ndarray:
    """The state before each chunk, from START, by a parallel prefix scan over chunks' state maps."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = np.take_along_axis(done[step:], done[:-step].astype(np.int64), axis=1)
        step *= 2
    return np.concatenate([[START], done[:-1, START]]).astype(np.uint8)


def marks_of(symbols: np.ndarray) -> np.ndarray:
    """The splitter's marks for each symbol, as booleans: a pretoken begins here."""
    to, marks = splitter()
    flat_to, flat_marks, n = to.ravel(), marks.ravel(), len(symbols)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    at = np.broadcast_to(np.arange(13, dtype=np.uint8), (chunks, 13)).copy()
    for row in grid[:SETTLE]:
        at = flat_to[at * np.uint8(12) + row[:, None]]
    open_ = np.flatnonzero((at != at[:, :1]).any(axis=1))  # chunks whose map still tells entry states apart
    one, rest = at[:, 0].copy(), at[open_]
    for row in grid[SETTLE:]:
        one = flat_to[one * np.uint8(12) + row]
        if len(open_):
            rest = flat_to[rest * np.uint8(12) + row[open_, None]]
    at[:] = one[:, None]
    at[open_] = rest
    state = compose(at)
    out = np.empty(grid.shape, np.uint8)
    for k, row in enumerate(grid):
        here = state * np.uint8(12) + row
        out[k], state = flat_marks[here], flat_to[here]
    out = out.T.ravel()[:n]
    begins = (out & 1).astype(bool)
    begins[:-1] |= (out[1:] & 2).astype(bool)
    return begins


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    import unicodedata

    table = np.full(0x110000, OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    kinds = np.frombuffer(kinds.encode(), np.uint8)
    table[kinds == ord("L")], table[kinds == ord("N")] = LETTER, NUMBER
    for a, b in ((0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = BLANK
    for chars, symbol in (("stmd", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E), ("'", QUOTE), (" ", SPACE)):
        for c in chars:
            table[ord(c)] = symbol
    return table


_LOW6 = np.int64(0x3F)


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, byte positions) of the characters of UTF-8 bytes."""
    table = symbol_table()
    where = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[where]
    symbols = table[:256][lead]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        b = [padded[where[wide] + k].astype(np.int64) for k in range(4)]
        two = (b[0] & 0x1F) << 6 | b[1] & _LOW6
        three = (b[0] & 0x0F) << 12 | (b[1] & _LOW6) << 6 | b[2] & _LOW6
        four = (b[0] & 0x07) << 18 | (b[1] & _LOW6) << 12 | (b[2] & _LOW6) << 6 | b[3] & _LOW6
        symbols[wide] = table[np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))]
    return symbols, where


def pretokens(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte positions where pretokens begin; rows are independent texts."""
    symbols, where = code_points(raw)
    first = np.searchsorted(where, bounds)
    rows = np.repeat(np.arange(1, len(bounds)), np.diff(first))
    place = np.arange(len(where)) + rows
    fed = np.full(len(where) + len(bounds), RESET, np.uint8)
    fed[place] = symbols
    return where[marks_of(fed)[place]]


class Merges:
    """The ranked merges of a byte-level BPE model, applied to many pieces at once."""

    SLOT_BITS = 19

    def __init__(self, model: dict):
        vocab = model["vocab"]
        #: Bytes that print stand for themselves in the vocabulary, the others for 256 and up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.first = np.array([vocab[name[b]] for b in range(256)], np.uint32)
        back = {c: b for b, c in name.items()}
        #: The vocabulary's tokens as bytes.
        self.words = [bytes(back[c] for c in x) for x in vocab if all(c in back for c in x)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.keys = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.none = len(pairs)
        slots = self._slots(self.keys)
        self.key_at = np.full(1 << self.SLOT_BITS, (1 << 64) - 1, np.uint64)
        self.rank_at = np.full(1 << self.SLOT_BITS, self.none, np.int32)
        self.key_at[slots[::-1]], self.rank_at[slots[::-1]] = self.keys[::-1], np.arange(self.none, dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.key_at[slots] != self.keys)  # pairs whose slot another has
        self.crowded = np.zeros(1 << self.SLOT_BITS, bool)
        self.crowded[slots[rest]] = True
        order = np.argsort(self.keys[rest])
        self.rest_keys, self.rest_ranks = self.keys[rest][order], rest[order].astype(np.int32)
        self.by_pair: dict[int, int] = {}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``none``."""
        keys = a.astype(np.uint64) << np.uint64(17) | b
        slots = self._slots(keys)
        same = self.key_at[slots] == keys
        out = np.where(same, self.rank_at[slots], np.int32(self.none))
        if len(self.rest_keys):
            more = np.flatnonzero(~same & self.crowded[slots])
            at = np.searchsorted(self.rest_keys, keys[more])
            at[at == len(self.rest_keys)] = 0
            hit = self.rest_keys[at] == keys[more]
            out[more[hit]] = self.rest_ranks[at[hit]]
        return out

    def apply(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of the pieces whose bytes follow each other in ``raw``.

        Each round makes every piece's next merge: the leftmost pair of the lowest rank.
        """
        ids, owner = self.first[raw], np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), self.none, np.int32)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.ranks(ids[inside], ids[inside + 1])
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.append(begins, len(ids)))
            least = np.minimum.reduceat(rank, begins)
            live = np.repeat(least < self.none, length)
            done_ids.append(ids[~live])
            done_owner.append(owner[~live])
            candidates = np.flatnonzero(live & (rank == np.repeat(least, length)))
            left = candidates[np.r_[True, owner[candidates][1:] != owner[candidates][:-1]]] if len(candidates) else candidates
            ids[left] = self.made[rank[left]]
            live[left + 1] = False
            ids, owner = ids[live], owner[live]
        owner = np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([np.zeros(0, np.uint32), *done_ids])[order], np.bincount(owner, minlength=len(sizes))


    def apply_long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one long piece: a heap gives the pair of the lowest rank, the leftmost first."""
        if not self.by_pair:
            self.by_pair = {k: r for r, k in reversed(list(enumerate(self.keys.tolist())))}
        ids, n = self.first[raw].tolist(), len(raw)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank_of, made, gone = self.by_pair.get, self.made.tolist(), -1
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(ids[:-1], ids[1:], strict=True)) if (r := rank_of(a << 17 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue  # one of the two has been merged since
            ids[k], ids[right], after[k] = made[rank], gone, after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := rank_of(ids[k] << 17 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
            if before[k] >= 0 and (r := rank_of(ids[before[k]] << 17 | ids[k])) is not None:
                heapq.heappush(heap, (r, before[k], ids[before[k]], ids[k]))
        return np.array([x for x in ids if x != gone], np.uint32)


class Pieces:
    """The piece transducer: exact transitions in an open-addressing table, counts and ids by state."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.bits = 17
        self._clear()
        self.n = 1  # state 0 is the empty prefix
        self.size, self.start, self.ids = np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        words = [x for x in merges.words if len(x) <= PATH]
        ends = np.cumsum([len(x) for x in words])
        self.walk(np.frombuffer(b"".join(words), np.uint8), ends - [len(x) for x in words], ends)
        self.compiled = self.n, self.bits, self.block_at.copy(), self.from_at.copy(), self.to_at.copy(), self.size, self.start, self.ids

    def _clear(self) -> None:
        #: By slot: the block, 16 times the state that it leaves plus the block's size (-1: free), the state that it reaches.
        self.block_at, self.from_at, self.to_at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)

    def forget(self) -> None:
        """Back to the vocabulary's states."""
        self.n, self.bits, block, from_, to, self.size, self.start, self.ids = self.compiled
        self.block_at, self.from_at, self.to_at = block.copy(), from_.copy(), to.copy()

    def _slots(self, block: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        x = (block ^ (block >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + leaves.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, block: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The state that each transition leads to, or -1."""
        slots = self._slots(block, leaves)
        out, open_ = np.full(len(slots), -1, np.int32), np.arange(len(slots))
        while len(open_):
            at = slots[open_]
            there = self.from_at[at]
            hit = (there == leaves[open_]) & (self.block_at[at] == block[open_])
            out[open_[hit]] = self.to_at[at[hit]]
            open_ = open_[~hit & (there >= 0)]
            slots[open_] = slots[open_] + 1 & (1 << self.bits) - 1
        return out

    def _insert(self, block: np.ndarray, leaves: np.ndarray, to: np.ndarray) -> None:
        if 2 * (self.n + len(to)) > 1 << self.bits:
            full = np.flatnonzero(self.from_at >= 0)
            block, leaves, to = (np.concatenate([old[full], new]) for old, new in ((self.block_at, block), (self.from_at, leaves), (self.to_at, to)))
            self.bits = max(self.bits + 1, int(2 * len(to)).bit_length() + 1)
            self._clear()
        slots, pending = self._slots(block, leaves), np.arange(len(to))
        while len(pending):
            free = pending[self.from_at[slots[pending]] < 0]
            self.to_at[slots[free]] = to[free]  # of several with one slot, the last has it
            free = free[self.to_at[slots[free]] == to[free]]
            self.from_at[slots[free]], self.block_at[slots[free]] = leaves[free], block[free]
            rest = np.ones(len(to), bool)
            rest[free] = False
            pending = pending[rest[pending]]
            slots[pending] = slots[pending] + 1 & (1 << self.bits) - 1

    def walk(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last state of each pretoken's path; states that are missing are compiled."""
        blocks = eight_bytes(raw)
        state, live, at, left = np.zeros(len(begins), np.int64), np.arange(len(begins)), begins, ends - begins
        fresh_begin, fresh_size = [], []
        while len(live):
            taken = np.minimum(left, 8)
            block, leaves = blocks[at] & KEEP[taken], state[live] << 4 | taken
            to = self._find(block, leaves)
            missing = np.flatnonzero(to < 0)
            if len(missing):
                order = missing[np.lexsort((leaves[missing], block[missing]))]
                new = np.r_[True, (block[order][1:] != block[order][:-1]) | (leaves[order][1:] != leaves[order][:-1])]
                first = order[new]
                states = np.arange(self.n, self.n + len(first), dtype=np.int32)
                self._insert(block[first], leaves[first], states)
                self.n += len(first)
                to[order] = states[np.cumsum(new) - 1]
                begin = begins[live[first]]
                fresh_begin.append(begin)
                fresh_size.append(at[first] + taken[first] - begin)
            state[live] = to
            more = np.flatnonzero(left > 8)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        if fresh_begin:
            begin, size = np.concatenate(fresh_begin), np.concatenate(fresh_size)
            taken = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ids, count = self.merges.apply(raw[taken], size)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.size, self.ids = np.concatenate([self.size, count.astype(np.int32)]), np.concatenate([self.ids, ids])
        return state


class Compiled:
    """The tokenizer of one JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or told["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        added = told["added_tokens"]
        self.merges = Merges(model)
        self.pieces = Pieces(self.merges)
        self.special = {x["content"].encode(): x["id"] for x in added}
        self.cut = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if added else None
        self.largest = max(*model["vocab"].values(), *self.special.values(), 0)
        self.spaced = any(b" " in x for x in self.special)

    def _emitted(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids, where they start, ids): the first two for each pretoken."""
        ends = np.append(begins[1:], len(raw))
        if self.pieces.n > KEPT:
            self.pieces.forget()
        length = ends - begins
        if not (length > PATH).any():
            state = self.pieces.walk(raw, begins, ends)
            return self.pieces.size[state], self.pieces.start[state], self.pieces.ids
        short, mid, long = np.flatnonzero(length <= PATH), np.flatnonzero((length > PATH) & (length <= HEAP)), np.flatnonzero(length > HEAP)
        size, start = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        state = self.pieces.walk(raw, begins[short], ends[short])
        size[short], start[short] = self.pieces.size[state], self.pieces.start[state]
        parts, at = [self.pieces.ids], len(self.pieces.ids)
        if len(mid):
            taken = np.repeat(begins[mid] - (np.cumsum(length[mid]) - length[mid]), length[mid]) + np.arange(length[mid].sum())
            ids, count = self.merges.apply(raw[taken], length[mid])
            size[mid], start[mid] = count, at + np.cumsum(count) - count
            parts.append(ids)
            at += len(ids)
        for k in long.tolist():
            ids = self.merges.apply_long(raw[begins[k] : ends[k]])
            size[k], start[k] = len(ids), at
            parts.append(ids)
            at += len(ids)
        return size, start, np.concatenate(parts)

    def _parts(self, raw: np.ndarray, bounds: np.ndarray):
        """(rows' range, bytes' range) of about SPAN bytes; a longer row comes in several parts.

        It is cut before a space that follows an ASCII letter or digit, where a pretoken begins in any case.
        """
        row = 0
        while row < len(bounds) - 1:
            to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SPAN, "right")) - 1)
            at, end = int(bounds[row]), int(bounds[to])
            while to == row + 1 and end - at > SPAN and not self.spaced:
                stop, found = at, -1
                while found < 0 and stop + SPAN < end:
                    window = raw[stop : stop + SPAN]
                    gaps = np.flatnonzero((window[1:] == 32) & _PLAIN[window[:-1]])
                    found, stop = (stop + 1 + int(gaps[-1]) if len(gaps) else -1), stop + SPAN - 1
                if found < 0:
                    break
                yield row, to, at, found
                at = found
            yield row, to, at, end
            row = to

    def _spans(self, raw: np.ndarray, bounds: np.ndarray):
        """The parts with special tokens cut out: (rows' range, bytes, bounds, owner, special id or -1)."""
        for row, to, at, end in self._parts(raw, bounds):
            part, cuts = raw[at:end], np.clip(bounds[row : to + 1], at, end) - at
            data = part.tobytes()
            owner, fixed = np.arange(to - row), np.full(to - row, -1)
            if self.cut is not None and self.cut.search(data):
                pieces = []
                for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    at = a
                    for m in self.cut.finditer(data, a, b):
                        pieces += [(at, k, -1), (m.start(), k, self.special[m[0]])]
                        at = m.end()
                    pieces.append((at, k, -1))
                cuts = np.array([x[0] for x in pieces] + [len(data)], np.int64)
                owner, fixed = np.array([x[1] for x in pieces]), np.array([x[2] for x in pieces])
            yield row, to, part, cuts, owner, fixed

    def counts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of tokens of each row: the sum of what its transitions emit."""
        out = np.zeros(len(bounds) - 1, np.int64)
        for row, _, part, cuts, owner, fixed in self._spans(raw, bounds):
            begins = pretokens(part, cuts)
            if len(begins):
                emitted = np.concatenate([[0], np.cumsum(self._emitted(part, begins)[0], dtype=np.int64)])
                first = np.searchsorted(begins, cuts)
                each = emitted[first[1:]] - emitted[first[:-1]]
                each[fixed >= 0] = 1
                np.add.at(out, row + owner, each)
        return out

    def encode(self, raw: np.ndarray, bounds: np.ndarray):
        """Yield each row's ids as an array of unsigned 32-bit integers, in order."""
        held: list[np.ndarray] = []  # ids of the parts of a long row
        at = 0
        for row, to, part, cuts, owner, fixed in self._spans(raw, bounds):
            begins = pretokens(part, cuts)
            size, start, known = self._emitted(part, begins) if len(begins) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
            emitted = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            ids = known[np.repeat(start - emitted[:-1], size) + np.arange(emitted[-1])]
            edges = emitted[np.searchsorted(begins, cuts)]
            parts: list[list[np.ndarray]] = [[] for _ in range(to - row)]
            for a, b, k, x in zip(edges[:-1].tolist(), edges[1:].tolist(), owner.tolist(), fixed.tolist(), strict=True):
                parts[k].append(ids[a:b] if x < 0 else np.array([x], np.uint32))
            at += len(part)
            if at < bounds[to] - bounds[0]:  # only where the part is one row's
                held += parts[0]
                continue
            parts[0], held = held + parts[0], []
            for x in parts:
                yield x[0] if len(x) == 1 else np.concatenate(x)


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


@lru_cache(4)
def compiled(path: str) -> Compiled:
    """One compiled tokenizer for each file and worker process."""
    return Compiled(path)
