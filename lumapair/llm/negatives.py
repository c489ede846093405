"""Hard negatives through vantage-point trees over norm-augmented vectors (operator 13).

Components become whole numbers, so inner products are exact. In a shard of rows, each
vector gets one more component that brings all to the norm of the longest; the anchor's
is 0. Then squared distance = anchor norm squared + longest norm squared - 2 x score: a window of
scores is an annulus around the anchor, and the highest scores in it are the nearest rows.

Rows are ordered by the pivot next to them (pivots: a bounded sample) and by their distance from it, cut
into shards of bounded size, and each shard's tree is built once and written. A shard is split at the median
distance from a vantage point, down to leaves; a node knows the least and largest distance of its
rows from the vantage point above it. A search takes nodes nearest first, passes over those that
lie inside the annulus' inner radius, and ends beyond the outer one, which shrinks as soon as
enough rows are found; what is found in one shard bounds the search of the next.

The anchors are a stated query set against all rows, in blocks: a task holds one block of
anchors, with a few rows for each of their windows, and takes the shards of one split in turn.
Splits follow from the tasks that can run, not from the rows, so what a task returns does
not grow with the table. First each anchor's positives are searched (any score, same label), then its negatives,
all its windows in one search. Results are exact: pruning allows for rounding of distances.

Defined results for odd input: rows with a null label, a null or empty vector, or a null or
non-finite component take no part; rows with a null id are no anchors and stand last among ties
(an id of 2^63 - 1 counts as null); vectors of each length are a space of their own; repeated rows are rows
of their own, as anchors too, and the copy of an anchor is one of its positives; an anchor without positives, and a positive without
negatives in its window (one with a score below 0 has an empty window), give no row; whole components beyond 2^24 are
taken at that; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush
from math import inf, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumapair.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Negatives have between so many percent of the positive's score.
LOW, HIGH = 80, 100
#: Rows of a shard and of a leaf.
SHARD_ROWS, LEAF_ROWS = 2048, 48
PIVOTS = 256
#: Anchors of a block, about: their vectors and what is found for them are in a task's memory.
BLOCK_ANCHORS = 50_000
LARGEST = 1 << 24
NO_ID = (1 << 63) - 1


class Window_(NamedTuple):
    """Scores from low to high; `what` comes back with what is found in it."""

    low: float
    high: float
    what: tuple


class Tree:
    """A vantage-point tree over the rows of a shard. Node n covers rows begin[n] to end[n]; inner nodes have the children 2n + 1 and 2n + 2 in `child`."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, uids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        own = x.astype(float)
        norms = np.einsum("ij,ij->i", own, own)
        self.longest = float(norms.max())
        y = np.column_stack([own, np.sqrt(self.longest - norms)])
        order = np.arange(len(x))
        #: begin, end, vantage row (-1: leaf), left child, right child, and their least and largest distances
        nodes: list[list] = [[0, len(x), -1, -1, -1, 0.0, 0.0, 0.0, 0.0]]
        for node in nodes:  # grows meanwhile
            begin, end = node[:2]
            if end - begin <= leaf_rows:
                continue
            rows = order[begin:end]
            away = y[rows] - y[rows].mean(axis=0)
            vantage = rows[np.einsum("ij,ij->i", away, away).argmax()]
            gap = y[rows] - y[vantage]
            distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            by, half = np.argsort(distance, kind="stable"), (end - begin) // 2
            order[begin:end], distance = rows[by], distance[by]
            node[2:] = [vantage, len(nodes), len(nodes) + 1, distance[0], distance[half - 1], distance[half], distance[-1]]
            nodes += [[begin, begin + half, -1, -1, -1, 0.0, 0.0, 0.0, 0.0], [begin + half, end, -1, -1, -1, 0.0, 0.0, 0.0, 0.0]]
        self.nodes = [tuple(n) for n in nodes]
        self.inner = [n for n, node in enumerate(nodes) if node[2] >= 0]
        self.at = {n: i for i, n in enumerate(self.inner)}
        self.vantage = x[[nodes[n][2] for n in self.inner]].reshape(-1, x.shape[1])
        self.x, self.labels, self.ids, self.uids = x[order], labels[order], ids[order], uids[order]
        self.largest = int(np.abs(x).max())

    def ready(self) -> Tree:
        """With vectors in a type that is exact for this shard."""
        self.own = self.x.astype(float)
        self.points = self.vantage.astype(float)
        return self

    def scores(self, rows: slice, q: Anchor) -> np.ndarray:
        if self.largest * q.largest * self.x.shape[1] < 1 << 53:
            return self.own[rows] @ q.real
        return self.x[rows].astype(np.int64) @ q.x

    def search(self, q: Anchor, same: bool, k: int) -> None:
        """Add to what the anchor has found: rows of its own label other than itself, or of other labels."""
        both = q.norm + self.longest
        slack = sqrt(both * 1e-13) + 1e-9
        near = sqrt(max(both - 2 * q.high, 0.0)) - slack if q.high < inf else -inf
        low = q.low()
        far = sqrt(max(both - 2 * low, 0.0)) + slack if low > -inf else inf
        reach = np.sqrt(np.maximum(both - 2 * (self.points @ q.real), 0.0)).tolist()
        heap = [(0.0, 0, inf)]
        while heap:
            least, n, most = heappop(heap)
            if least > far:
                return
            if most < near:
                continue
            begin, end, vantage, left, right, a, b, c, d = self.nodes[n]
            if vantage >= 0:
                r = reach[self.at[n]]
                for child, lo, hi in ((left, a, b), (right, c, d)):
                    nearest = max(least, r - hi, lo - r)
                    if nearest <= far and (farthest := min(most, r + hi)) >= near:
                        heappush(heap, (nearest, child, farthest))
                continue
            rows = slice(begin, end)
            s = self.scores(rows, q)
            mine = self.labels[rows] == q.label
            fits = (s >= low) & (s <= q.high) & (mine & (self.uids[rows] != q.uid) if same else ~mine)
            if fits.any():
                found = begin + np.flatnonzero(fits)
                q.add(s[fits].astype(np.int64), self.ids[found], self.uids[found], k)
                if q.low() > low:
                    low = q.low()
                    far = sqrt(max(both - 2 * low, 0.0)) + slack


class Anchor:
    def __init__(self, uid: int, anchor_id: int, label: int, x: np.ndarray, windows: list[Window_]) -> None:
        self.uid, self.id, self.label, self.x, self.windows = uid, anchor_id, label, x, windows
        self.real = x.astype(float)
        self.norm = float(self.real @ self.real)
        self.largest = int(np.abs(x).max())
        self.high = max(w.high for w in windows)
        #: (-score, id, uid) of the best rows so far, per window, and the score from which on others count
        self.best: list[list[tuple]] = [[] for _ in windows]
        self.floors = [w.low for w in windows]

    def low(self) -> float:
        return min(self.floors)

    def add(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> None:
        for i, w in enumerate(self.windows):
            inside = np.flatnonzero((scores >= self.floors[i]) & (scores <= w.high))
            if len(inside):
                first = inside[np.lexsort((uids[inside], ids[inside], -scores[inside]))[:k]]
                self.best[i] = sorted(self.best[i] + list(zip((-scores[first]).tolist(), ids[first].tolist(), uids[first].tolist())))[:k]
                if len(self.best[i]) == k:
                    self.floors[i] = -self.best[i][-1][0]


def whole_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: Column, scale: int = SCALE) -> DataFrame:
    """uid, id, label, anchor, d, x (little-endian 32-bit): the rows that take part, each with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["v"].value_lengths().to_numpy()
            c = b["v"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            whole = np.floor(c * scale)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
            fine = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
            small = np.clip(np.nan_to_num(whole), -LARGEST, LARGEST).astype(np.int32)
            x = [small[ends[i] - sizes[i] : ends[i]].tobytes() for i in fine]
            at = pa.array(fine)
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in ("uid", "id", "label", "anchor")), pa.array(sizes[fine].astype(np.int32)), pa.array(x, pa.binary())], ["uid", "id", "label", "anchor", "d", "x"])

    label = F.col(f"`{label_col}`")
    key = label.cast("long") if isinstance(rows.schema[label_col].dataType, IntegralType) else F.xxhash64(label)
    own = rows.select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.when(label.isNotNull(), key).alias("label"),
        F.coalesce(anchors & F.col(f"`{id_col}`").isNotNull(), F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").alias("v"),
    )
    return materialize(own.where("label IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "uid long, id long, label long, anchor boolean, d int, x binary"), "vectors")


def shards(vectors: DataFrame, rows: int, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(shard, d, tree): vantage-point trees over rows that lie near each other."""
    drawn: dict[int, list[np.ndarray]] = {}
    for r in vectors.orderBy(F.xxhash64("uid")).select("d", "x").limit(PIVOTS).collect():
        drawn.setdefault(r["d"], []).append(np.frombuffer(r["x"], np.int32).astype(float))
    pivots = {d: np.array(p) for d, p in drawn.items()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away = np.zeros(len(b), np.int32), np.zeros(len(b))
            sizes = b["d"].to_numpy()
            for d in np.unique(sizes):
                if d in pivots:
                    at = np.flatnonzero(sizes == d)
                    x = np.frombuffer(b"".join(b["x"].take(pa.array(at)).to_pylist()), np.int32).reshape(-1, d).astype(float)
                    p = pivots[d]
                    apart = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ p.T) + np.einsum("ij,ij->i", p, p)
                    cell[at] = apart.argmin(axis=1)
                    away[at] = apart.min(axis=1)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("uid", "id", "label", "d", "x")), pa.array(cell), pa.array(away)], ["uid", "id", "label", "d", "x", "cell", "away"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list[tuple]) -> pa.RecordBatch:
            uids, ids, labels, _, x = zip(*held)
            tree = Tree(np.frombuffer(b"".join(x), np.int32).reshape(len(x), -1), np.array(labels), np.array(ids), np.array(uids), leaf_rows)
            return pa.RecordBatch.from_arrays([pa.array([uids[0]], pa.int64()), pa.array([held[0][3]], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], ["shard", "d", "tree"])

        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("uid", "id", "label", "d", "x"))):
                if held and (len(held) == shard_rows or held[0][3] != r[3]):
                    yield row(held)
                    held = []
                held.append(r)
        if held:
            yield row(held)

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = min(-(-rows // shard_rows), max(tasks, rows // (16 * shard_rows)))
    placed = vectors.mapInArrow(near, "uid long, id long, label long, d int, x binary, cell int, away double")
    # The hash deals even very many equal vectors over several ranges.
    ordered = placed.withColumn("h", F.xxhash64("uid")).repartitionByRange(max(dealt, 1), "d", "cell", "away", "h").sortWithinPartitions("d", "cell", "away", "h")
    return materialize(ordered.mapInArrow(build, "shard long, d int, tree binary"), "shards")


_FOUND = "uid long, id long, w int, positive_id long, positive_score long, score long, found_id long, found_uid long"


def _searched(anchors: DataFrame, trees: DataFrame, blocks: int, splits: int, same: bool, k: int) -> DataFrame:
    """_FOUND: the best k rows in each window of each anchor (uid, id, label, d, x, windows), per split of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Anchor] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(held), 1000):
                got = [(q.uid, q.id, i, *w.what, -s, f, u) for q in held[lo : lo + 1000] for i, w in enumerate(q.windows) for s, f, u in q.best[i]]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(zip(*got))], _NAMES)

        for b in batches:
            for block, split, uid, own_id, label, d, x, windows, tree in zip(*(b[c].to_pylist() for c in ("block", "split", "uid", "id", "label", "d", "x", "windows", "tree"))):
                if now != (block, split):
                    yield from out()
                    held, now = [], (block, split)
                if tree is None:
                    w = [Window_(-inf if v["low"] is None else v["low"], inf if v["high"] is None else v["high"], (v["id"], v["score"])) for v in windows]
                    held.append(Anchor(uid, own_id, label, np.frombuffer(x, np.int32).astype(np.int64), w))
                elif held:
                    shard = pickle.loads(tree).ready()
                    for q in held:
                        if len(q.x) == d:
                            shard.search(q, same, k)
        yield from out()

    none = F.lit(None)
    kinds = dict(uid="long", id="long", label="long", d="int", x="binary", windows=_WINDOWS, tree="binary")
    asked = anchors.select(
        F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("kind"),
        *[(none.cast(t) if c == "tree" else F.col(c)).alias(c) for c, t in kinds.items()],
    )
    asking = trees.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("shard"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("kind"),
        *[(F.col(c) if c in ("d", "tree") else none.cast(t)).alias(c) for c, t in kinds.items()],
    )
    both = asked.union(asking).repartition(blocks * splits, "block", "split").sortWithinPartitions("block", "split", "kind")
    found = both.mapInArrow(run, _FOUND)
    best = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "found_id", "found_uid")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)


_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_WINDOWS = "array<struct<low:bigint,high:bigint,id:bigint,score:bigint>>"


def mine(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    vectors = whole_rows(rows, id_col, vector_col, label_col, anchors, scale)
    n, asked = vectors.agg(F.count("*"), F.count_if("anchor")).first()
    trees = shards(vectors, n, shard_rows, leaf_rows)
    spark = rows.sparkSession
    blocks = max(1, -(-asked // block_anchors))
    tasks = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    splits = max(1, min(-(-n // shard_rows), -(-tasks // blocks)))
    null = F.lit(None).cast("long")
    any_score = F.array(F.struct(null.alias("low"), null.alias("high"), null.alias("id"), null.alias("score")))
    queries = vectors.where("anchor").drop("anchor")
    near = _searched(queries.withColumn("windows", any_score), trees, blocks, splits, True, positives)
    # 100 x negative between low and high x positive, in whole numbers; a window that holds nothing is left out.
    window = F.struct(
        F.expr(f"(score * {low} + pmod(-score * {low}, 100L)) div 100").alias("low"), F.expr(f"(score * {high} - pmod(score * {high}, 100L)) div 100").alias("high"), F.col("found_id").alias("id"), "score",
    )
    windows = near.withColumn("v", window).where("v.low <= v.high").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("vs")).select("uid", F.col("vs.v").alias("windows"))
    queries = materialize(queries.join(windows, "uid"), "windows")
    found = _searched(queries, trees, blocks, splits, False, negatives)
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        F.col("id").alias("anchor_id"), shown("positive_id").alias("positive_id"), F.col("n").cast("int").alias("rank"), shown("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
