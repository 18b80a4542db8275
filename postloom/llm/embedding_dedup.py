"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random, eight numbers at a time, and decoded to the nearest point of the E8
lattice; the points of a table's blocks make its cell.  A vector is filed in its own cell of every table
and also looks into the neighbouring cells whose lattice points are next nearest.  The number of blocks
grows with the logarithm of the number of vectors that share a label, so a cell's chance occupancy stays bounded.

Only filed cells are rows of tables at first.  A Bloom filter of them goes to the tasks, and a look into a cell
becomes a row only if the filter has the cell; so empty neighbours, nearly all of them, cost no shuffle, and no
look that could meet a vector is lost.  Where the filter would exceed its bound, tables are taken in groups,
each with its own filter.

Groups of near copies are not expanded into pairs.  Vectors within half the linking angle of a cell's
first vector, its pivot, are linked with each other for certain, and make one ball.  Cells then propose
pairs of balls, which angles settle: all members link, none can, or their pairs are computed.  Every link
that is counted has an exact double-precision cosine of at least the threshold, or follows from such
cosines by the triangle inequality of angles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from ..scratch import materialize
from .shingles import mix
from ..skew import with_group
from .url_filter import bloom_filter, passes

THRESHOLD = 0.93
PROBES = 6
#: Lattice units of a projected unit vector's root mean square, times one half.
SCALE = 0.8
#: The least of three measurements (12,000 to 80,000 pairs by tables): a pair at the threshold meets in a table of so many blocks with this probability.
MEET = {2: 0.39, 3: 0.139, 4: 0.047, 5: 0.016, 6: 0.0049}
#: What each further block leaves of it at least, and the aim over all tables.
BEYOND, AIM = 0.28, 0.99
#: Bits of a filter of filed cells (64 MB), bits for each cell, and its share of wrong answers.
FILTER_BITS, CELL_BITS, WRONG = 1 << 29, 10, 0.01
#: A cell with more balls than this is split over tasks.
CELL_ROWS = 1000
SEED = 20240229


@lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((240, 8))
    for k, (i, j, a, b) in enumerate(pairs):
        out[k, i], out[k, j] = a, b
    signs = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1
    out[112:] = signs[(signs < 0).sum(axis=1) % 2 == 0] / 2
    return out


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: of D8, or of D8 moved by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    whole[closer] = half[closer]
    return whole


class Hasher:
    """The cells of vectors of one dimension."""

    def __init__(self, dimension: int, blocks: int, tables: int | None = None, probes: int = PROBES, scale: float = SCALE):
        tables = tables or tables_for(blocks)
        random = np.random.default_rng(SEED + dimension)
        self.blocks, self.tables, self.probes = blocks, tables, probes
        self.projections = random.normal(size=(tables, dimension, 8 * blocks)) * (scale / math.sqrt(8) * 2)
        self.shifts = random.uniform(-1, 1, (tables, 8 * blocks))
        self.weights = random.integers(0, 2**62, (tables, 8 * blocks)).astype(np.int64) * 2 + 1

    def cells(self, unit: np.ndarray, labels: np.ndarray, tables: range | None = None, probe: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(own, probed): keys by row and table, and by row, table and probe; of some tables, or without probes."""
        tables = tables or range(self.tables)
        own = np.zeros((len(unit), len(tables)), np.uint64)
        probed = np.zeros((len(unit), len(tables), self.probes if probe else 0), np.uint64)
        salt = mix(labels.astype(np.int64).view(np.uint64))
        with np.errstate(over="ignore"):
            for k, t in enumerate(tables):
                x = (unit @ self.projections[t] + self.shifts[t]).reshape(-1, 8)
                point = nearest_e8(x)
                weights = self.weights[t].reshape(self.blocks, 8)
                doubled = (2 * point).astype(np.int64).reshape(-1, self.blocks, 8)
                raw = (doubled * weights).sum(axis=(1, 2))
                base = salt + np.uint64(t) * np.uint64(0x9E3779B97F4A7C15)
                own[:, k] = mix(mix(raw.view(np.uint64)) + base)
                if probe:
                    gain = ((x - point) @ roots().T).reshape(len(unit), -1)  # the larger, the nearer that neighbour
                    best = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
                    step = ((2 * roots()).astype(np.int64) @ weights.T).T.ravel()  # by block and root
                    probed[:, k] = mix(mix((raw[:, None] + step[best]).view(np.uint64)) + base[:, None])
        return own, probed


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h2 = mix(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h2.view(np.int64))], ["h1", "h2"])


def blocks_for(n: int) -> int:
    """Blocks of eight projections in a cell: two, and one more for each factor of 32 beyond 32,768 vectors of a label."""
    return 2 + max(0, math.ceil(math.log(max(n, 1) / 32_768) / math.log(32)))


def tables_for(blocks: int) -> int:
    """Tables that let a pair at the threshold meet with the probability AIM: ten for two blocks, 31 for three."""
    most = max(MEET)
    return math.ceil(math.log(1 - AIM) / math.log1p(-MEET.get(blocks, MEET[most] * BEYOND ** (blocks - most))))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.float64) for x in column]


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(2).to_pylist():
            v = np.array([np.nan if c is None else c for c in x], np.float64) if x else np.zeros(0)
            with np.errstate(over="ignore", invalid="ignore"):
                v = v / np.abs(v).max(initial=0) if len(v) and np.isfinite(v).all() and v.any() else v[:0]
            out.append((v / np.linalg.norm(v)).tobytes() if len(v) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], ["vec_id", "label", "said", "unit"])


def _cells(batches: Iterator[pa.RecordBatch], blocks: int, tables: range, among=None) -> Iterator[pa.RecordBatch]:
    """(node, cell) rows: filed cells, or, of a filter's cells, the neighbours looked into."""
    hashers: dict[int, Hasher] = {}
    for whole in batches:
        sizes = np.array([len(x.as_py()) // 8 for x in whole.column(2)], np.int64)
        for size in np.unique(sizes):
            batch = whole.filter(pa.array(sizes == size))
            hasher = hashers.setdefault(int(size), Hasher(int(size), blocks))
            own, probed = hasher.cells(np.stack(_vectors(batch.column(2))), batch.column(1).to_numpy() * 4096 + size, tables, among is not None)
            keys = own if among is None else probed.reshape(len(own), -1)
            nodes, keys = np.repeat(batch.column(0).to_numpy(), keys.shape[1]), keys.ravel()
            if among is not None:
                hit = passes(0, among.value, keys, mix(keys))
                nodes, keys = nodes[hit], keys[hit]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys.view(np.int64))], ["node", "cell"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link only where their labels are equal.  A null, empty or zero vector, one with a null or
    non-finite component, one with a null label or id, links with nothing (a null id has a null component
    and is not kept).  Vectors of different dimensions do not link.  Rows that repeat an id, label and vector are one
    vector; rows that repeat an id with another vector are vectors of their own in one component.  Each row comes
    out with its links.  Other columns are ignored.
    """
    spark, angle = vectors.sparkSession, math.acos(threshold)
    half = math.cos(angle / 2) + 1e-9
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("said", F.xxhash64("label", "v"))
    unit = rows.where("vec_id is not null and label is not null and v is not null").mapInArrow(_unit, "vec_id long, label long, said long, unit binary").where("unit is not null")
    unit = unit.groupBy("vec_id", "said").agg(F.min(F.struct("label", "unit")).alias("x")).select("vec_id", "said", "x.label", "x.unit", F.monotonically_increasing_id().alias("place"))
    unit = materialize(unit, "unit")
    repeated = materialize(unit.groupBy("vec_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    single_ids = repeated.isEmpty()  # then a vector's id can stand for it, and components need no other names
    unit = unit.withColumn("node", F.col("vec_id") if single_ids else F.col("place"))
    names = unit.select("vec_id", "said", "node")
    share = unit.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("s")).first()
    blocks = blocks_for(round(share["s"] / share["n"]) if share["n"] else 0)  # how many vectors a vector shares its label with, on average
    tables, all_cells = tables_for(blocks), unit.select("node", "label", "unit")
    groups = min(tables, max(1, -(-(share["n"] or 0) * tables * CELL_BITS // FILTER_BITS)))
    filed = probed = None
    for k in range(groups):
        part = range(tables * k // groups, tables * (k + 1) // groups)
        own = materialize(all_cells.mapInArrow(lambda it, part=part: _cells(it, blocks, part), "node long, cell long"), "filed")
        keys = own.select(F.col("cell").alias("h1")).distinct()
        keys = materialize(keys.mapInArrow(_second, "h1 long, h2 long"), "cells")
        among = spark.sparkContext.broadcast(bloom_filter(keys, 0, max(1, keys.count()), WRONG))
        looked = materialize(all_cells.mapInArrow(lambda it, part=part, among=among: _cells(it, blocks, part, among), "node long, cell long"), "probed")
        filed, probed = (own, looked) if filed is None else (filed.unionByName(own), probed.unionByName(looked))

    def of(name: str, vector: str) -> DataFrame:
        return unit.select(F.col("node").alias(name), F.col("unit").alias(vector))

    def close(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.array([x @ y if len(x) == len(y) else -1.0 for x, y in zip(_vectors(batch.column("x")), _vectors(batch.column("y")), strict=True)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(c)], [*batch.schema.names[:2], "c"]).filter(pa.array(c >= least))

    near = with_group(filed, "cell", "node", max(1, filed.count()), F.min("node").alias("pivot"), F.max("node").alias("last"), having="pivot <> last")
    near = near.where("node <> pivot").select("node", "pivot").distinct()
    near = near.join(of("node", "x"), "node").join(of("pivot", "y"), "pivot").select("node", "pivot", "x", "y")
    near = materialize(near.mapInArrow(lambda it: close(it, half), "node long, pivot long, c double"), "near")
    moved = near.select("node").distinct()
    held = near.join(moved.withColumnRenamed("node", "pivot"), "pivot", "left_anti").groupBy("node").agg(F.min(F.struct("pivot", "c")).alias("b"))
    ball = unit.select("node").join(held, "node", "left")
    ball = materialize(ball.select("node", F.coalesce("b.pivot", "node").alias("ball"), F.coalesce("b.c", F.lit(1.0)).alias("c")), "balls")
    balls = ball.groupBy("ball").agg(F.count("*").alias("size"), F.acos(F.least(F.lit(1.0), F.min("c"))).alias("radius"))

    sought = filed.withColumn("filed", F.lit(True)).unionByName(probed.withColumn("filed", F.lit(False))).join(ball.select("node", "ball"), "node")
    sought = materialize(sought.groupBy("cell", "ball").agg(F.max("filed").alias("filed")), "sought")
    several = F.min("ball").alias("low"), F.max("ball").alias("high"), F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")
    sought = with_group(sought, "cell", "ball", max(1, sought.count()), *several, having="low <> high").select("cell", "ball", "filed", "parts")
    # filed balls are dealt out over the parts of a crowded cell, and those that look into it are copied for each part
    a = sought.where("filed").select("cell", F.col("ball").alias("p"), F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int").alias("part"))
    b = sought.select("cell", F.col("ball").alias("q"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, ["cell", "part"]).where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    pairs = pairs.join(of("p", "x"), "p").join(of("q", "y"), "q").select("p", "q", "x", "y")
    pairs = pairs.mapInArrow(lambda it: close(it, math.cos(min(math.pi, 2 * angle)) - 1e-9), "p long, q long, c double")
    for side in "pq":
        pairs = pairs.join(balls.select(F.col("ball").alias(side), F.col("size").alias(f"n_{side}"), F.col("radius").alias(f"r_{side}")), side)
    apart, spread, slack = F.acos(F.least(F.lit(1.0), "c")), F.col("r_p") + F.col("r_q"), 1e-7
    single = (F.col("n_p") == 1) & (F.col("n_q") == 1)
    state = F.when(single, F.when(F.col("c") >= threshold, "all").otherwise("none"))
    state = state.when(apart + spread <= angle - slack, "all").when(apart - spread > angle + slack, "none").otherwise("some")
    pairs = materialize(pairs.withColumn("state", state).where("state <> 'none'"), "pairs")

    sure = pairs.where("state = 'all'")
    each = ball.select("node", "ball")
    some = pairs.where("state = 'some'").select("p", "q")
    some = some.join(each.select(F.col("node").alias("u"), F.col("ball").alias("p")), "p").join(each.select(F.col("node").alias("v"), F.col("ball").alias("q")), "q")
    some = some.join(of("u", "x"), "u").join(of("v", "y"), "v").select("u", "v", "x", "y", "p", "q")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.array([x @ y for x, y in zip(_vectors(batch.column("x")), _vectors(batch.column("y")), strict=True)], float)
            yield batch.select(["u", "v", "p", "q"]).filter(pa.array(c >= threshold))

    linked = materialize(some.mapInArrow(link, "u long, v long, p long, q long"), "linked")
    counted = linked.select(F.col("u").alias("node")).union(linked.select("v")).groupBy("node").agg(F.count("*").alias("some"))
    by_ball = sure.select(F.col("p").alias("ball"), F.col("n_q").alias("n")).union(sure.select("q", "n_p")).groupBy("ball").agg(F.sum("n").alias("sure"))
    edges = sure.select("p", "q").union(linked.select("p", "q").distinct())
    if not single_ids:
        same = unit.join(repeated, "vec_id").select("node", "first")
        of_first = each.withColumnsRenamed({"node": "first", "ball": "q"})
        edges = edges.union(same.join(each.withColumnRenamed("ball", "p"), "node").join(of_first, "first").where("p <> q").select("p", "q"))
    joined = connected_components(edges, "p", "q").withColumnRenamed("node", "ball")
    of_ball = balls.join(by_ball, "ball", "left").join(joined, "ball", "left")
    of_ball = of_ball.select("ball", (F.col("size") - 1 + F.coalesce("sure", F.lit(0))).alias("base"), F.coalesce("component", "ball").alias("component"))
    found = each.join(of_ball, "ball").join(counted, "node", "left").select("node", (F.col("base") + F.coalesce("some", F.lit(0))).alias("n"), "component")
    if not single_ids:
        named = materialize(found.join(names.select("node", "vec_id"), "node"), "named")
        found = with_group(named, "component", "node", max(1, named.count()), F.min("vec_id").alias("least")).select("node", "n", F.col("least").alias("component"))
    found = found.join(names, "node").select("vec_id", "said", "n", "component")
    out = rows.select("vec_id", "said").join(found, ["vec_id", "said"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
