"""Removing repeated strings of at least 200 bytes with suffix arrays.

A string that repeats has the same characters wherever it starts, so also the same anchor: of its 64-byte
parts the one of the least hash, the leftmost of equal ones.  The starts that share an anchor lie side by side, and with the bytes
that their strings cover they make a segment.  Segments go by their anchor's hash, so each shard has all
segments that could share a string, and no start is in two.  Anchors that are found once are dropped, and equal segments become
one with a count.  Segments that share an anchor and differ are cut into pieces of starts that lie less than 32 bytes apart; all
strings of a piece share the bytes in its middle, which join the key, and for sorting are one character.  Pieces that share the key and
differ are sorted suffix by suffix, shard by shard, by external induced sorting (``induced_sorting``), whose common
prefixes of neighbours tell which starts repeat.

A key with very many different pieces would make one large shard.  Its pieces are cut finer, into starts less than 8 bytes apart and then
into single ones; in those the middle is the whole string, so the cutting always ends.

Texts are never shuffled: they are written once with a number for each row, whose upper bits tell the part; segments to cut
and starts to remove are written by part, and a task reads those of its own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import mark, materialize, new_path, release, small_batches
from ..skew import HOT_ROWS, with_group
from .induced_sorting import repeated_starts
from .shingles import hash_slices, mix, text_buffer
from .warc import _filesystem

#: Strings of so many bytes are removed where they repeat.
LEAST = 200
ANCHOR = 64
#: Starts of a piece, in turn.
GRAINS = (32, 8, 1)
#: Different pieces of a key that are sorted in one shard.
HOT_SEGMENTS = HOT_ROWS
#: Characters of a shard, bytes of each of its queues in memory, and bytes that are hashed at a time.
SHARD, QUEUE_BYTES, REGION = 1 << 20, 32 << 20, 1 << 20
_ROW_BITS = 33  # of monotonically_increasing_id, the row in its part
_BASE = 0x5851F42D4C957F2D
_SEED = 20240511

SEGMENT = "row long, at int, n int, ahead int, h long, s long"


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of the base and of its inverse modulo 2**64."""
    size = REGION + 2 * LEAST
    up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return np.random.default_rng(_SEED).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1), up, down


def _least_from(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` keys from each place on."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[: len(keys) - span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if span < width else keys


def segments(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, at, n, ahead, h, s) of the texts that ``bounds`` parts: n starts from ``at`` on share the anchor that lies ``ahead`` of the first.

    h is the anchor's hash and s that of all bytes of the strings that start there.  Numbers are by row.
    """
    table, up, down = _powers()
    found = []
    for first in range(0, max(0, len(raw) - LEAST + 1), REGION):
        part = raw[first : first + REGION + LEAST - 1]
        prefix = np.r_[np.uint64(0), np.cumsum(table[part] * up[: len(part)], dtype=np.uint64)]
        whole = lambda a, b, prefix=prefix: (prefix[b] - prefix[a]) * down[a]
        k = np.arange(len(part) - ANCHOR + 1)
        hashes = mix(whole(k, k + ANCHOR))
        low = np.uint64((1 << 24) - 1)
        anchor = (_least_from((hashes & ~low) | k.astype(np.uint64), LEAST - ANCHOR + 1) & low).astype(np.int64)
        start = np.arange(len(anchor))
        row = np.searchsorted(bounds, start + first, "right") - 1
        inside = np.flatnonzero(start + first + LEAST <= bounds[row + 1])
        if not len(inside):
            continue
        row, anchor = row[inside], anchor[inside]
        begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])])
        n = np.diff(np.r_[begin, len(inside)])
        a, p, own = inside[begin], anchor[begin], row[begin]
        s = mix(whole(a, a + n - 1 + LEAST) + n.astype(np.uint64))
        found.append((own, a + first - bounds[own], n, p - a, hashes[p].view(np.int64), s.view(np.int64)))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(6))


def pieces(raw: np.ndarray, at: np.ndarray, n: np.ndarray, ahead: np.ndarray, h: np.ndarray, grain: int) -> tuple[np.ndarray, ...]:
    """(index, at, n, ahead, h, s): segments cut so that the starts of a piece have anchors in one block of ``grain`` distances."""
    last = (ahead - n + 1) // grain
    times = ahead // grain - last + 1
    index = np.repeat(np.arange(len(at)), times)
    block = last[index] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    most = np.minimum(ahead[index], block * grain + grain - 1)
    least = np.maximum((ahead - n + 1)[index], block * grain)
    anchor = (at + ahead)[index]
    middle, end = anchor - block * grain, anchor - (block * grain + grain - 1) + LEAST  # in every string of the block
    key = mix(hash_slices(raw, middle, end - middle) + mix(h[index].view(np.uint64) + block.astype(np.uint64)))
    size = most - least + 1
    s = hash_slices(raw, anchor - most, size - 1 + LEAST)
    return index, anchor - most, size, most, key.view(np.int64), s.view(np.int64)


def _by_part(rows: DataFrame, label: str) -> str:
    """Write rows by the part of their text, sorted; a part has as many at most as its texts have bytes."""
    path = new_path(rows.sparkSession, label)
    part = F.shiftright("row", _ROW_BITS).cast("int")
    rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", "row", "at").write.parquet(path, partitionBy="part")
    return path


class _Beside:
    """What ``_by_part`` wrote, for the batches of a task that scans the texts."""

    def __init__(self, path: str):
        (self.fs, self.path), self.part, self.held = _filesystem(path), None, None

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, pa.Table | None]:
        """The places of the batch's rows for each row beside it, and those rows; a batch is of one part, its rows in order."""
        part = int(rows[0]) >> _ROW_BITS
        if part != self.part:
            folder = f"{self.path}/part={part}"
            there = self.fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory
            files = [f.path for f in self.fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet")] if there else []
            tables = [pq.ParquetFile(self.fs.open_input_file(f)).read() for f in files]
            self.part, self.held = part, pa.concat_tables(tables).sort_by([("row", "ascending"), ("at", "ascending")]) if tables else None
            self.rows = self.held.column("row").to_numpy() if tables else None
        if self.held is None:
            return np.zeros(0, np.int64), None
        low, high = np.searchsorted(self.rows, [rows[0], rows[-1] + 1])
        table = self.held.slice(low, high - low)
        return np.searchsorted(rows, self.rows[low:high]), table if len(table) else None


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows by part; a task may scan several parts."""
    rows = batch.column(0).to_numpy()
    cuts = np.flatnonzero(np.r_[True, np.diff(rows >> _ROW_BITS) != 0, True]) if len(rows) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def _segment_batch(rows: np.ndarray, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    row, at, n, ahead, h, s = columns
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((rows[row], at, n, ahead, h, s), kinds, strict=True)], [c.split()[0] for c in SEGMENT.split(", ")])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffer(batch.column(1))
        yield _segment_batch(batch.column(0).to_numpy(), segments(raw, bounds))


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def _finer(texts: DataFrame, path: str, grain: int) -> DataFrame:
    """The segments that were written to ``path``, cut finer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = _Beside(path)
        for batch in (p for b in batches for p in _parts(b)):
            rows = batch.column(0).to_numpy()
            place, table = beside.of(rows)
            if table is None:
                continue
            raw, bounds = text_buffer(batch.column(1))
            at, n, ahead, h = _numbers(table, "at", "n", "ahead", "h")
            index, begin, size, most, key, s = pieces(raw, at + bounds[place], n, ahead, h, grain)
            yield _segment_batch(rows, (place[index], begin - bounds[place[index]], size, most, key, s))

    return texts.mapInArrow(run, SEGMENT)


def _sorted(texts: DataFrame, path: str, grain: int, shards: int) -> DataFrame:
    """(row, at, n): the starts of the pieces that were written to ``path`` whose strings repeat in their shard.

    Of a string of 200 bytes the shared middle leaves ``grain`` - 1 on both sides together, so strings are of ``grain`` characters.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = _Beside(path)
        for batch in (p for b in batches for p in _parts(b)):
            place, table = beside.of(batch.column(0).to_numpy())
            if table is None:
                continue
            raw, bounds = text_buffer(batch.column(1))
            at, n, ahead = _numbers(table, "at", "n", "ahead")
            first, left, data = at + bounds[place], ahead % grain, raw.tobytes()
            middle = LEAST - grain + 1
            held = [data[a : a + m] + data[a + m + middle : a + k - 1 + LEAST] for a, m, k in zip(first.tolist(), left.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("h", "row", "at")), pa.array(left, pa.int32()), pa.array(held, pa.binary())], ["h", "row", "at", "left", "bytes"])

    spill = new_path(texts.sparkSession, "queues")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, held = [], []
        for batch in batches:
            columns.append([c.to_numpy() for c in batch.columns[:4]])
            held += batch.column(4).to_pylist()
        if not held:
            return
        key, row, at, left = (np.concatenate(c) for c in zip(*columns, strict=True))
        fs, folder = _filesystem(spill)
        fs.create_dir(folder, recursive=True)
        repeated = repeated_starts(held, grain, QUEUE_BYTES, fs, folder, (left, key))
        which = np.repeat(np.arange(len(held)), [len(r) for r in repeated])
        flat = np.concatenate(repeated)
        begin = np.flatnonzero(flat & ~(np.r_[False, flat[:-1]] & np.r_[False, which[1:] == which[:-1]]))
        end = np.flatnonzero(flat & ~(np.r_[flat[1:], False] & np.r_[which[1:] == which[:-1], False]))
        first = np.searchsorted(which, which[begin])
        columns = row[which[begin]], at[which[begin]] + begin - first, end - begin + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["row", "at", "n"])

    return texts.mapInArrow(cut, "h long, row long, at int, left int, bytes binary").repartition(shards, "h").mapInArrow(order, "row long, at int, n int")


def _repeated(texts: DataFrame) -> DataFrame:
    """(row, at, n): runs of n starts in a text whose strings start anywhere else too."""
    spark = texts.sparkSession
    rows, found = texts.mapInArrow(_find, SEGMENT), []
    for grain, finer in zip((None, *GRAINS), (*GRAINS, None), strict=True):
        began = mark()
        rows = materialize(rows, "segments")
        shared = with_group(rows, "h", "row", rows.count(), F.count("*").alias("copies"), having="copies > 1")
        shared, read = materialize(shared.drop("copies"), "shared"), mark()
        release(spark, began, read - 1)
        same = materialize(shared.groupBy("h", "s").agg(F.count("*").alias("copies"), F.min(F.struct("row", "at", "n", "ahead")).alias("first")), "different")
        keyed = shared.withColumn("hs", F.struct("h", "s"))
        found.append(with_group(keyed, "hs", "row", shared.count(), F.count("*").alias("copies"), having="copies > 1").select("row", "at", "n"))
        differ = with_group(same, "h", "s", same.count(), F.count("*").alias("kinds"), having="kinds > 1")
        differ = materialize(differ.select("first.*", "h", "kinds"), "differ")
        most = HOT_SEGMENTS if grain else 0
        few, many = differ.where(F.col("kinds") <= most), differ.where(F.col("kinds") > most)
        size = few.agg(F.sum(F.col("n") + (grain or 0))).first()[0] or 0
        if size:
            shards = max(-(-size // SHARD), spark.sparkContext.defaultParallelism)
            found.append(_sorted(texts, _by_part(few.drop("kinds"), "few"), grain, shards))
        if finer is None or many.isEmpty():
            break
        rows = _finer(texts, _by_part(many.drop("kinds"), "many"), finer)
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    return runs


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and ``kept`` with ``keep_text``: each text without its repeated strings.

    A byte goes if a string of 200 bytes covers it that starts anywhere else too, in the same text or another
    one; strings do not cross texts, overlapping ones count, and all are judged on the texts as given, so of equal
    long texts nothing stays.  Null texts are empty; texts below 200 bytes stay whole; rows that
    repeat are texts of their own; null ids are kept; other columns are ignored; no rows give none.  ``kept`` is binary: a
    character may lose some of its bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), text.alias("text"), F.col(id_col).alias("doc_id"))
    texts = materialize(texts, "texts")
    path = _by_part(_repeated(texts.where(F.octet_length("text") >= LEAST).select("row", "text")), "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = _Beside(path)
        for batch in (p for b in batches for p in _parts(b)):
            raw, bounds = text_buffer(batch.column(1))
            keep, spans = np.ones(len(raw), bool), np.zeros(batch.num_rows, np.int64)
            place, table = beside.of(batch.column(0).to_numpy())
            if table is not None:
                at, n = _numbers(table, "at", "n")
                edges = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edges, bounds[place] + at, 1)
                np.add.at(edges, bounds[place] + at + n - 1 + LEAST, -1)
                keep = np.cumsum(edges[:-1]) == 0
                gone = ~keep
                begin = gone & ~np.r_[False, gone[:-1]]
                begin[bounds[:-1][bounds[:-1] < len(raw)]] = gone[bounds[:-1][bounds[:-1] < len(raw)]]
                total = np.r_[0, np.cumsum(begin)]
                spans = total[bounds[1:]] - total[bounds[:-1]]
            left = [raw[a:b][keep[a:b]].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sizes = np.diff(bounds)
            removed = sizes - np.array([len(x) for x in left], np.int64)
            columns = [batch.column(2), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.binary())] * keep_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    return texts.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


#: Texts as hexadecimal; windows are read from stretches of 256 starts, as reading from a long text's middle is slow.
ORACLE_SQL = """
with d as (select row_number() over () as id, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select id, length(h) // 2 - 199 as n, unnest(range(0, (length(h) // 2 - 199 + 255) // 256)) as c, h from d where length(h) >= 400),
b as (select id, 256 * c as off, least(256, n - 256 * c) as n, substr(h, 512 * c + 1, 910) as h from c),
w as (select id, off, unnest(range(0, n)) as j, h from b),
m as (select id, off + j as i, md5(substr(h, 2 * j + 1, 400)) as m from w),
r as (select id, i from m where m in (select m from m group by m having count(*) > 1)),
n as (select *, coalesce(i > lag(i) over (partition by id order by i) + 200, true) as opens from r),
g as (select *, sum(cast(opens as int)) over (partition by id order by i) as k from n),
s as (select id, min(i) as a, max(i) + 200 as b from g group by id, k),
p as (select *, coalesce(lag(b) over (partition by id order by a), 0) as before from s),
k as (select d.id, any_value(d.doc_id) as doc_id, any_value(d.h) as h, coalesce(sum(b - a), 0) as n_removed, count(p.a) as n_spans, coalesce(max(b), 0) as last, coalesce(string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' order by a), '') as kept from d left join p using (id) group by d.id)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans, sha256(unhex(kept || substr(h, 2 * last + 1))) as kept_sha256 from k"""
