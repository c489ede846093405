"""Fréchet distance of two sets of feature vectors, from moments that merge as a tree.

A set of n vectors of width d travels in the smaller of two forms: as its vectors while there
are at most d / 2, else as (n, mean, sum of centred outer products). The latter's upper triangle
goes in blocks of rows, each with n and mean, so that blocks merge by themselves: no message is larger than
a block, and no task holds more than one set's matrix and what is added to it.

Tasks first sort their own rows, so that each meets one set at a time. Sets that stay small keep
their vectors to the end, where the root of a matrix is not needed. The blocks of large sets merge
over salted keys, `FAN` at a time, so that no task reads the blocks of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumapair.session import materialize

#: Bytes of a block of the triangle and of a chunk of vectors.
BLOCK_BYTES = 1 << 20
#: Blocks that merge at a time.
FAN = 16
#: Vectors that a task turns into a matrix in the shuffle of vectors, in widths.
SALT_WIDTHS = 8

Moments = tuple[float, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    """(n, mean, sum of centred outer products)"""
    mean = x.mean(axis=0)
    c = x - mean
    return float(len(x)), mean, c.T @ c


def merged(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


class Few(NamedTuple):
    """A set by its vectors: those less the mean, divided by the root of n - 1."""

    n: int
    mean: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Few:
        mean = x.mean(axis=0)
        return cls(len(x), mean, (x - mean) / np.sqrt(max(len(x) - 1, 1)))

    def trace(self) -> float:
        return float(np.square(self.root).sum())


def _root(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def distance(a: Few | Moments | None, b: Few | Moments | None) -> float:
    """NaN if a side has fewer than two vectors."""
    if a is None or b is None or a[0] < 2 or b[0] < 2:
        return float("nan")
    trace, few, full = 0.0, [], []
    for x in (a, b):
        if isinstance(x, Few):
            trace += float(np.square(x.root).sum())
            few.append(x.root)
        else:
            full.append(x[2] / (x[0] - 1))
            trace += float(np.trace(full[-1]))
    # What the traces of both are less by: the trace of the root of the product of the covariances.
    if len(few) == 2:
        both = np.linalg.svd(few[0] @ few[1].T, compute_uv=False)
    else:
        left = few[0] if few else _root(full.pop(0))
        both = np.sqrt(np.maximum(np.linalg.eigvalsh(left @ full[0] @ left.T), 0))
    d = a[1] - b[1]
    return float(d @ d + trace - 2 * both.sum())


#: block: -1 for a chunk of vectors, else the number of a block of rows of the triangle.
_PART = "key string, side string, part long, n long, block int, mean binary, data binary"
_NAMES = [c.split()[0] for c in _PART.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def block_rows(width: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, block_bytes // (8 * width))


class _Set:
    """Vectors of one key and side that a task meets: themselves while they are few, else their moments."""

    def __init__(self, key: str, side: str, few: bool, block_bytes: int) -> None:
        self.key, self.side, self.few, self.block_bytes = key, side, few, block_bytes
        self.held: list[np.ndarray] = []
        self.count, self.of = 0, None

    def add(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.count += len(x)
        # More vectors than this are larger than the triangle.
        if 2 * self.count > x.shape[1]:
            self.settle()

    def settle(self) -> None:
        if self.held:
            own = moments(np.concatenate(self.held))
            self.of = merged(self.of, own) if self.of else own
            self.held, self.count = [], 0

    def parts(self, part: int) -> Iterator[pa.RecordBatch]:
        if self.of is None and self.few and self.held:
            x = np.concatenate(self.held)
            step = block_rows(x.shape[1], self.block_bytes)
            for lo in range(0, len(x), step):
                yield _rows([(self.key, self.side, part, len(x[lo : lo + step]), -1, None, x[lo : lo + step].tobytes())])
            return
        self.settle()
        if self.of:
            n, mean, m2 = self.of
            step = block_rows(len(mean), self.block_bytes)
            for block, lo in enumerate(range(0, len(mean), step)):
                yield _rows([(self.key, self.side, part, int(n), block, mean.tobytes(), m2[lo : lo + step, lo:].tobytes())])


def _met(few: bool, width: int, block_bytes: int):
    """Rows sorted by key and side, with vectors `f` or chunks `data`, to parts; one set is held at a time."""

    def vectors(b: pa.RecordBatch) -> Iterator[tuple[str, str, np.ndarray]]:
        keys, sides = b["key"].to_pylist(), b["side"].to_pylist()
        if "data" in b.schema.names:
            for k, s, x in zip(keys, sides, b["data"].to_pylist()):
                yield k, s, np.frombuffer(x).reshape(-1, width)
            return
        lengths = pc.unique(pc.list_value_length(b["f"])).to_pylist()
        if lengths != [width]:
            raise ValueError(f"feature vectors of different lengths: {sorted({width, *lengths})}")
        x = b["f"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
        edges = [0, *(i for i in range(1, len(keys)) if (keys[i], sides[i]) != (keys[i - 1], sides[i - 1])), len(keys)]
        for i, j in zip(edges, edges[1:]):
            yield keys[i], sides[i], x[i:j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Set | None = None
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            if not len(b):
                continue
            for key, side, x in vectors(b):
                if now is None or (now.key, now.side) != (key, side):
                    if now:
                        yield from now.parts(part)
                        part += 1
                    now = _Set(key, side, few, block_bytes)
                now.add(x)
        if now:
            yield from now.parts(part)

    return run


def _add_blocks(block_bytes: int):
    """Blocks sorted by key, side and block, those of one key added up; one block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, part = None, None, 0
        for b in batches:
            for key, side, p, n, block, mean, data in zip(*(b[c].to_pylist() for c in _NAMES)):
                mean, data = np.frombuffer(mean), np.frombuffer(data)
                if now == (key, side, block):
                    step = block_rows(len(mean), block_bytes)
                    d, total, at = mean - of[1], of[0] + n, block * step
                    grown = np.outer(d[at : at + step], d[at:]).ravel() * (of[0] * n / total)
                    of = (total, of[1] + d * (n / total), of[2] + data + grown)
                    continue
                if now:
                    yield _rows([(now[0], now[1], part, of[0], now[2], of[1].tobytes(), of[2].tobytes())])
                now, of, part = (key, side, block), (n, mean, data), p
        if now:
            yield _rows([(now[0], now[1], part, of[0], now[2], of[1].tobytes(), of[2].tobytes())])

    return run


def _distances(sides: tuple[str, str], width: int, block_bytes: int):
    """Parts sorted by key, side and block to the distance per key; two sets are held, by their vectors or their matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        chunks: dict[str, list[np.ndarray]] = {}
        full: dict[str, tuple] = {}

        def out() -> pa.RecordBatch:
            of: dict[str, Few | Moments] = {s: Few.of(np.concatenate(x)) for s, x in chunks.items()}
            for s, (n, mean, m2) in full.items():
                of[s] = (float(n), mean, np.triu(m2) + np.triu(m2, 1).T)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([distance(of.get(sides[0]), of.get(sides[1]))], pa.float64())], ["key", "distance"])

        for b in batches:
            for key, side, n, block, mean, data in zip(*(b[c].to_pylist() for c in ("key", "side", "n", "block", "mean", "data"))):
                if now != key:
                    if now is not None:
                        yield out()
                    now, chunks, full = key, {}, {}
                x = np.frombuffer(data)
                if block < 0:
                    chunks.setdefault(side, []).append(x.reshape(n, width))
                    continue
                if side not in full:
                    full[side] = (n, np.frombuffer(mean), np.zeros((width, width)))
                at = block * block_rows(width, block_bytes)
                full[side][2][at : at + block_rows(width, block_bytes), at:] = x.reshape(-1, width - at)
        if now is not None:
            yield out()

    return run


def _merge_blocks(blocks: DataFrame, block_bytes: int, fan: int) -> DataFrame:
    """One row per key, side and block."""
    counts = blocks.where("block = 0").groupBy("key", "side").agg(F.count("*").alias("n"))
    width = counts.agg(F.max("n")).first()[0] or 0
    out = blocks.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(max(width, 1))))
    while width > 1:
        width = -(-width // fan)
        to = ["key", "side", "block", "salt"]
        salted = out.withColumn("salt", F.pmod("salt", F.lit(width))).repartition(*to).sortWithinPartitions(*to)
        # A merged block has the number of one of its parts, from which its next salt follows.
        out = salted.mapInArrow(_add_blocks(block_bytes), _PART).withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(width)))
    return out.drop("salt")


def _summed(parts: DataFrame, always: bool, width: int, block_bytes: int, fan: int) -> DataFrame:
    """Parts (written) of each key and side in one form: chunks while its vectors are few (unless blocks are asked for always), else merged blocks."""
    sizes = parts.where("block <= 0").groupBy("key", "side").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("block") < 0, F.col("n"))).alias("loose"))
    # One row per key and side, not per vector.
    sizes = materialize(sizes.withColumn("few", F.lit(not always) & (2 * F.col("all") <= width)), "frechet-sizes")
    chunks = parts.where("block < 0").join(sizes, ["key", "side"])
    salts = F.greatest(F.ceil(F.col("loose") / (SALT_WIDTHS * width)), F.lit(1).cast("long"))
    # The number that a chunk came with is its task's; equal chunks are told apart by their place.
    loose = chunks.where("NOT few").withColumn("salt", F.pmod(F.xxhash64("part", F.monotonically_increasing_id()), salts))
    dealt = loose.repartition("key", "side", "salt").sortWithinPartitions("key", "side", "salt").select("key", "side", "data")
    settled = dealt.mapInArrow(_met(False, width, block_bytes), _PART).withColumn("part", -1 - F.col("part"))
    whole = materialize(parts.where("block >= 0").union(settled), "frechet-blocks")
    return chunks.where("few").select(_NAMES).union(_merge_blocks(whole, block_bytes, fan))


def _parts(features: DataFrame, key: Column, side: str, vector: str, block_bytes: int) -> tuple[DataFrame, int]:
    """What tasks make of their own vectors, written, and the width of vectors. Null vectors are left out."""
    rows = features.select(key.alias("key"), F.col(side).cast("string").alias("side"), F.col(vector).alias("f")).where("f IS NOT NULL")
    one = rows.select(F.size("f").alias("d")).first()
    width = one["d"] if one else 1
    met = rows.sortWithinPartitions("key", "side").mapInArrow(_met(True, width, block_bytes), _PART)
    return materialize(met, "frechet-parts"), width


def _key(*columns: Column) -> Column:
    return F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"})


def _measured(parts: DataFrame, width: int, sides: tuple[str, str], block_bytes: int, fan: int) -> DataFrame:
    summed = _summed(parts, False, width, block_bytes, fan)
    return summed.repartition("key").sortWithinPartitions("key", "side", "block").mapInArrow(_distances(sides, width, block_bytes), "key string, distance double")


def frechet(features: DataFrame, key: str, side: str, vector: str, sides: tuple[str, str], block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(key, distance) per key."""
    parts, width = _parts(features, _key(F.col(key)), side, vector, block_bytes)
    return _measured(parts, width, sides, block_bytes, fan).withColumn("key", F.from_json("key", "array<string>")[0])


def frechet_levels(features: DataFrame, group: str, sub: str, side: str, vector: str, sides: tuple[str, str], block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(level, group, sub, distance) per sub-dataset, per group and overall. Features are read once; the levels above merge what tasks made of them for sub-datasets."""
    parts, width = _parts(features, _key(F.col(group), F.col(sub)), side, vector, block_bytes)
    names = F.from_json("key", "array<string>")
    none = F.lit(None).cast("string")
    levels = F.array(_key(names[0], names[1], F.lit("sub")), _key(names[0], none, F.lit("group")), _key(none, none, F.lit("all")))
    spread = parts.withColumn("key", F.explode(levels))
    done = _measured(spread, width, sides, block_bytes, fan)
    return done.select(names[2].alias("level"), names[0].alias(group), names[1].alias(sub), "distance")


def moment_blocks(features: DataFrame, key: str, side: str, vector: str, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(key, side, block, n, mean, m2): per key and side the blocks of rows of the sum of centred outer products, from the diagonal on; means and sums are little-endian doubles."""
    parts, width = _parts(features, _key(F.col(key)), side, vector, block_bytes)
    done = _summed(parts, True, width, block_bytes, fan)
    return done.select(F.from_json("key", "array<string>")[0].alias("key"), "side", "block", "n", "mean", F.col("data").alias("m2"))


def block_terms(blocks: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, side, block, n, trace, total, squares) of `moment_blocks`: sums over the covariance's entries on the diagonal, all, and squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trace, total, squares = [], [], []
            for n, block, mean, m2 in zip(*(b[c].to_pylist() for c in ("n", "block", "mean", "m2"))):
                width = len(mean) // 8
                at = block * block_rows(width, block_bytes)
                c = np.frombuffer(m2).reshape(-1, width - at) / (n - 1 if n > 1 else np.nan)
                for into, value in ((trace, np.trace(c)), (total, c.sum()), (squares, np.square(c).sum())):
                    into.append(float(value))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("key", "side", "block", "n")), *(pa.array(x, pa.float64()) for x in (trace, total, squares))], ["key", "side", "block", "n", "trace", "total", "squares"])

    return blocks.mapInArrow(run, "key string, side string, block int, n long, trace double, total double, squares double")


def trace_terms(features: DataFrame, side: str, vector: str) -> DataFrame:
    """Per side: n, squared norm of the mean vector and trace of the sample covariance, by plain aggregates per component."""
    parts = features.select(side, F.posexplode(vector).alias("i", "x"))
    per = parts.groupBy(side, "i").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    return per.groupBy(side).agg(F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mean_norm2"), F.sum("v").alias("cov_trace"))
