"""Hard negatives by dual-tree search.

Anchors are taken in blocks of a bounded size.  A block's anchors form a ball tree, and so do the candidates
that a task holds at a time; the top of each tree parts by label.  A pair of nodes has an interval that holds
every inner product between them,

    <a, b> in <ca, cb> +- (|ca| rb + |cb| ra + ra rb),

so one comparison prunes a whole group of anchors against a whole group of candidates: if the interval ends
below what every anchor of the group still needs, or begins above what any may take.  Pairs of leaves are
scored exactly, best upper ends first, and each scored chunk raises what the group still needs.

A first pass finds each anchor's positives, a second one the negatives of each anchor and positive, whose
band of scores is known by then.  Candidates are only scanned; a task gives at most the wanted rows for each
anchor and positive, whatever the number of its rows, and these are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import materialize

ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score in hundredths of the positive's, least and most.
BAND = (30, 90)
SCALE = 256
#: A scaled component's greatest magnitude, and the most components: so every inner product fits 64 bits.
LIMIT, COMPONENTS = 1 << 25, 1 << 12
#: Anchors sent to the tasks at a time, candidates of a tree, rows of a leaf of either tree, candidates scored at a time.
ANCHOR_BLOCK, TREE_ROWS = 4096, 16_384
ANCHOR_LEAF, LEAF, CHUNK = 16, 64, 1024
_NONE = -(1 << 62)


class Tree:
    """A ball tree below a root for each label; its rows are kept in the order of the leaves."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        order = np.argsort(labels, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(labels[order]) != 0, True]) if len(x) else np.zeros(1, np.int64)
        start, end = bounds[:-1].tolist(), bounds[1:].tolist()
        left, right, centre, radius = [-1] * len(start), [-1] * len(start), [], []
        self.roots, k = len(start), 0
        while k < len(start):  # children are appended, so their turn comes
            a, b = start[k], end[k]
            rows = x[order[a:b]]
            centre.append(rows.mean(axis=0))
            radius.append(float(np.sqrt(((rows - centre[k]) ** 2).sum(axis=1).max())))
            if b - a > leaf:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, rows.var(axis=0).argmax()], half)] if rows.shape[1] else order[a:b]
                left[k], right[k] = len(start), len(start) + 1
                start += [a, a + half]
                end += [a + half, b]
                left += [-1, -1]
                right += [-1, -1]
            k += 1
        self.order, self.x = order, x[order]
        self.start, self.end, self.left, self.right = (np.array(v, np.int64) for v in (start, end, left, right))
        self.centre, self.radius = np.array(centre).reshape(len(start), x.shape[1]), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.labels = labels[order][self.start] if len(x) else labels

    def over(self, values: np.ndarray, kind: np.ufunc) -> np.ndarray:
        """The least or greatest of the rows' values by node; values are in the order of the leaves."""
        ends = np.stack([self.start, self.end], axis=1).ravel()
        return kind.reduceat(np.append(values, values[-1:]), ends)[::2] if len(self.start) else values[:0]


def intervals(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of an interval that holds all inner products between nodes i of one tree and j of the other."""
    middle = np.einsum("ij,ij->i", a.centre[i], b.centre[j])
    reach = a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
    reach = reach + 1e-9 * (a.norm[i] * b.norm[j] + reach) + 1e-6  # what doubles may round off
    return middle - reach, middle + reach


def _children(tree: Tree, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with each inner node replaced by its two children."""
    inner = tree.left[nodes] >= 0
    return np.concatenate([nodes[~inner], tree.left[nodes[inner]], tree.right[nodes[inner]]]), np.concatenate([others[~inner], others[inner], others[inner]])


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in doubles where all sums fit their 53 bits."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    return (x @ y.T).astype(np.int64) if most < 2.0**53 else x.astype(np.int64) @ y.astype(np.int64).T


class Search:
    """The best ``k`` candidates of each query so far; an anchor has ``low.shape[1]`` queries, each a range of scores."""

    def __init__(self, anchors: Tree, places: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.anchors, self.places, self.low, self.high, self.k, self.same = anchors, places, low, high, k, same_label
        self.scores = np.full((*low.shape, k), _NONE)
        self.ids, self.found = np.zeros_like(self.scores), np.zeros_like(self.scores)
        self.scored = 0

    def needed(self) -> np.ndarray:
        """The least score that could still enter, by query."""
        return np.maximum(self.low, self.scores[:, :, -1])

    def leaf_pairs(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of leaves that the intervals leave over, with the upper ends."""
        a = self.anchors
        least, most = a.over(self.needed().min(axis=1), np.minimum), a.over(self.high.max(axis=1), np.maximum)
        i, j = (v.ravel() for v in np.meshgrid(np.arange(a.roots), np.arange(tree.roots), indexing="ij"))
        alike = a.labels[i] == tree.labels[j]
        i, j = i[alike == self.same], j[alike == self.same]
        while True:
            lower, upper = intervals(a, tree, i, j)
            open_ = (upper >= least[i]) & (lower <= most[i])
            i, j, upper = i[open_], j[open_], upper[open_]
            if not ((a.left[i] >= 0) | (tree.left[j] >= 0)).any():
                return i, j, upper
            i, j = _children(a, i, j)
            j, i = _children(tree, j, i)

    def add(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """Search a block of candidates."""
        width = max(x.shape[1], self.anchors.x.shape[1])
        if not len(x) or not len(self.places) or not width:
            return
        if x.shape[1] < self.anchors.x.shape[1]:
            x = np.pad(x, ((0, 0), (0, self.anchors.x.shape[1] - x.shape[1])))
        tree = Tree(x[:, : self.anchors.x.shape[1]], labels, LEAF)  # components that no anchor has add nothing
        ids, places = ids[tree.order], places[tree.order]
        i, j, upper = self.leaf_pairs(tree)
        order = np.lexsort((-upper, i))
        i, j, upper = i[order], j[order], upper[order]
        for group, at, stop in zip(*np.unique(i, return_index=True), np.r_[np.unique(i, return_index=True)[1][1:], len(i)], strict=True):
            rows = slice(self.anchors.start[group], self.anchors.end[group])
            while at < stop and upper[at] >= self.needed()[rows].min():
                sizes = np.cumsum(tree.end[j[at:stop]] - tree.start[j[at:stop]])
                now = at + max(1, int(np.searchsorted(sizes, CHUNK, "right")))
                self._score(rows, np.concatenate([np.arange(tree.start[b], tree.end[b]) for b in j[at:now]]), tree.x, ids, places)
                at = now

    def _score(self, rows: slice, columns: np.ndarray, x: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        s = inner_products(self.anchors.x[rows], x[columns])
        self.scored += s.size
        other = self.places[rows][:, None] != places[columns]
        low, high = self.needed()[rows], self.high[rows]
        q, r, c = np.nonzero(np.stack([(s >= low[:, w, None]) & (s <= high[:, w, None]) & other for w in range(low.shape[1])]))
        if not len(q):
            return
        a, w, k = np.nonzero(self.scores[rows] > _NONE)
        row = np.concatenate([r * low.shape[1] + q, a * low.shape[1] + w])
        score = np.concatenate([s[r, c], self.scores[rows][a, w, k]])
        ids = np.concatenate([ids[columns[c]], self.ids[rows][a, w, k]])
        places = np.concatenate([places[columns[c]], self.found[rows][a, w, k]])
        order = np.lexsort((places, ids, -score, row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        a, w = row // low.shape[1] + rows.start, row % low.shape[1]
        self.scores[a, w, rank], self.ids[a, w, rank], self.found[a, w, rank] = score[order], ids[order], places[order]


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors as rows of doubles; shorter ones end in zeros."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64), np.diff(ends)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


_FOUND = "anchor long, query int, id long, place long, score long, anchor_id long, positive_id long, positive_score long"


def _pass(rows: DataFrame, anchors: pa.Table, low: np.ndarray, high: np.ndarray, k: int, same_label: bool, positives: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Each task's best rows for every query of a block of anchors."""
    vectors = anchors.column("q").combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((_matrix(vectors), *(anchors.column(c).to_numpy() for c in ("label", "place", "vec_id")), low, high, positives))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, labels, places, ids, low, high, positives = shared.value
        tree = Tree(x, labels, ANCHOR_LEAF)
        search = Search(tree, places[tree.order], low[tree.order], high[tree.order], k, same_label)
        held: list[tuple] = []

        def settle() -> None:
            search.add(_stack([h[0] for h in held]), *(np.concatenate([h[n] for h in held]) for n in (1, 2, 3)))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((_matrix(batch.column(3)), *(batch.column(n).to_numpy() for n in (1, 0, 2))))
            if sum(len(h[0]) for h in held) >= TREE_ROWS:
                settle()
        if held:
            settle()
        a, w, n = np.nonzero(search.scores > _NONE)
        at = tree.order[a]
        told = [p[at, w] for p in positives] if positives else [np.zeros(len(a), np.int64)] * 2
        columns = [places[at], w.astype(np.int32), search.ids[a, w, n], search.found[a, w, n], search.scores[a, w, n], ids[at], *told]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in _FOUND.split(", ")])

    return rows.select("vec_id", "label", "place", "q").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc(), F.col("place").asc()]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "query").orderBy(*order))).where(F.col("rank") <= k)


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, q, place) of the rows that take part: shifted labels, components floor(256 * x), and a number for each row."""
    label, x = F.col(label_col).cast("int"), F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).where("vec_id is not null and label is not null and x is not null")
    sound = F.forall("x", lambda c: F.coalesce(F.abs(c) * SCALE < LIMIT, F.lit(False))) & (F.size("x") <= COMPONENTS)  # NaN is greater than any number
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(sound).select("vec_id", shifted.alias("label"), F.transform("x", lambda c: F.floor(c * SCALE).cast("int")).alias("q"), F.monotonically_increasing_id().alias("place"))


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_every``; an anchor's positives are its best other rows
    of the same label, and each has the best rows of other labels whose score lies within ``band`` hundredths of the
    positive's.  Higher scores come first, then smaller ids.  Rows with a null id, label, vector or component, a
    component that is not finite or is 2**17 or more in magnitude, or over 4096 components take no part; shorter vectors count as
    ending in zeros.  Rows that repeat an id are rows of their own, as anchors and as others.  Other columns are
    ignored; without rows, anchors, positives or negatives there are no results.
    """
    rows = materialize(prepare(vectors, id_col, vector_col, label_col), "vectors")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    blocks = -(-anchors.count() // ANCHOR_BLOCK)
    found = None
    for b in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).toArrow()  # of a bounded size
        ends = [np.full((len(block), 1), v) for v in (_NONE + 1, -_NONE)]
        known = _best(_pass(rows, block, *ends, positives, True), positives).select("anchor", "rank", "id", "score").toArrow()
        at = {p: k for k, p in enumerate(block.column("place").to_pylist())}
        a, k = np.array([at[p] for p in known.column("anchor").to_pylist()], np.int64), known.column("rank").to_numpy() - 1
        ids, scores = np.zeros((2, len(block), positives), np.int64)
        low, high = np.full(ids.shape, -_NONE), np.full(ids.shape, _NONE)
        ids[a, k], scores[a, k] = known.column("id").to_numpy(), known.column("score").to_numpy()
        low[a, k], high[a, k] = -(-band[0] * scores[a, k] // 100), band[1] * scores[a, k] // 100
        one = _pass(rows, block, low, high, negatives, False, (ids, scores))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return _best(found, negatives).select("anchor_id", "positive_id", F.col("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = f"""
with r as (select row_number() over () as place, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from r where vec_id % {ANCHOR_EVERY} = 0),
s as (select a.place as anchor, a.vec_id as anchor_id, a.label = r.label as same, r.place, r.vec_id, cast(list_inner_product(a.q, r.q) as bigint) as score from a join r on a.place <> r.place),
p as (select anchor, anchor_id, place, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor order by score desc, vec_id) <= {POSITIVES}),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor, p.place order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor = p.anchor and not s.same and {BAND[0]} * positive_score <= 100 * s.score and 100 * s.score <= {BAND[1]} * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
