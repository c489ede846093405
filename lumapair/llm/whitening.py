"""Whitening of vectors by a tiled covariance (operator 12).

Components become whole numbers x = floor(scale * c) + shift. The fit list holds each
distinct x vector once; sums over it are exact. Its vectors, less the mean, are cut into row
blocks and column blocks. Dimension pairs form tiles: the column blocks are shuffled by
row block, each task multiplies the pairs of its row blocks tile by tile, and the products are
added per tile. The assembled matrix (the width squared) is decomposed on the driver.

Vectors are centred before they are multiplied, around a whole number near the mean first,
so that the shift costs no digits. What the whitened fit list really has as covariance is
measured by a pass of its own, not derived.

Defined results for odd input: rows whose vector is null, empty, or holds null or non-finite
components have no result; vectors of each length are a space of their own, with its own fit list, n and
components; repeated rows count once in the fit list and get their rows each; rows with a null id
too; a component without variance (fewer distinct vectors than dimensions, say) gives `whitened` 0
and is left out of the identity error, which is 0 if none has variance; components whose x
has no exact double are taken at the largest that has one; a deviation beyond a long is null; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumapair.session import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Dimensions of a column block; a tile has their square.
TILE = 32
#: Bytes of a row block's doubles.
BLOCK_BYTES = 4 << 20
#: Bytes of tile sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 52
#: Share of the trace below which a component counts as without variance.
NONE = 1e-13


class Space(NamedTuple):
    """What whitens the vectors of one length."""

    n: int
    sums: np.ndarray
    base: int  # x less this is small
    axes: np.ndarray  # width x components
    values: np.ndarray  # variance of each component, 0 for none
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - (self.sums - self.n * self.base) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.divide(1.0, np.sqrt(self.values), out=np.zeros_like(self.values), where=self.values > 0)
        return (self.centred(x) @ self.axes) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) squared, exactly; None beyond a long."""
        # x - base is small where x is, and n * x - sums = n * (x - base) - (sums - n * base).
        rest = self.sums - self.n * self.base
        about = (np.square(self.n * (x - self.base).astype(float) - rest)).sum(axis=1)
        if len(about) and about.max() < 2.0**62:
            return np.square(self.n * (x - self.base) - rest).sum(axis=1).tolist()
        whole = [sum((self.n * (int(v) - self.base) - int(r)) ** 2 for v, r in zip(row, rest)) for row in x]
        return [v if v < 1 << 63 else None for v in whole]


def _clean(batch: pa.RecordBatch, name: str, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) per length of vector, of the rows that take part."""
    lists = batch[name]
    flat, valid = lists.flatten(), lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()) * valid
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    ends = np.cumsum(sizes)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        own = c[(ends[at] - d)[:, None] + np.arange(d)]
        fine = np.isfinite(own).all(axis=1)
        x = np.clip(np.floor(own[fine] * scale), -EXACT, EXACT).astype(np.int64) + shift
        if fine.any():
            yield at[fine], x


def distinct_vectors(rows: DataFrame, vector: Column, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(d, x): each distinct vector of whole numbers once, as its length and little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _clean(b, "v", scale, shift):
                once = np.unique(x, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(once), x.shape[1], np.int32)), pa.array([r.tobytes() for r in once], pa.binary())], ["d", "x"])

    return rows.select(vector.alias("v")).mapInArrow(run, "d int, x binary").distinct()


def _arrays(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of a batch of (d, x)."""
    d = b["d"].to_numpy()
    for one in np.unique(d):
        own = b["x"].filter(pa.array(d == one))
        yield int(one), np.frombuffer(b"".join(own.to_pylist()), np.int64).reshape(-1, one)


def sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per length: number of vectors and exact sums per dimension. Tasks send one row a length; the driver gets one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, x in _arrays(b):
                n, s = held.get(d, (0, 0))
                held[d] = (n + len(x), s + x.sum(axis=0))
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], ["d", "n", "s"])

    parts = fit.mapInArrow(run, "d int, n long, s array<long>")
    per = parts.select("d", "n", F.posexplode("s").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in per.collect():
        found.setdefault(r["d"], {})[r["i"]] = (r["n"], r["s"])
    return {d: (at[0][0], np.array([at[i][1] for i in range(d)], np.int64)) for d, at in found.items()}


def column_blocks(fit: DataFrame, totals: dict[int, tuple[int, np.ndarray]], tile: int = TILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(d, row_block, col_block, x): centred doubles, row by row. Row blocks hold as many rows as the bytes allow."""
    means = {d: ((base := int(s[0] // n)), (s - n * base) / n) for d, (n, s) in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for d, x in _arrays(b):
                base, rest = means[d]
                step = max(1, block_bytes // (8 * d))
                for lo in range(0, len(x), step):
                    c = (x[lo : lo + step] - base) - rest
                    parts = [np.ascontiguousarray(c[:, at : at + tile]).tobytes() for at in range(0, d, tile)]
                    k = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * k, pa.int32()), pa.array([block] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], ["d", "row_block", "col_block", "x"]
                    )
                    block += 1

    return fit.mapInArrow(run, "d int, row_block long, col_block int, x binary")


_TILE = "d int, i int, k int, m binary"


def _tile_rows(held: dict[tuple[int, int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (d, i, k), m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["d", "i", "k", "m"])


def tile_products(blocks: DataFrame, tile: int = TILE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(d, i, k, m): products of column blocks i <= k, added up over the row blocks that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        now, own, size = None, {}, 0

        def multiply() -> int:
            grown = 0
            for i, a in own.items():
                for k, b in own.items():
                    if i <= k:
                        key, m = (now[0], i, k), a.T @ b
                        grown += 0 if key in held else m.nbytes
                        held[key] = held[key] + m if key in held else m
            return grown

        for b in batches:
            for d, block, col, x in zip(b["d"].to_pylist(), b["row_block"].to_pylist(), b["col_block"].to_pylist(), b["x"].to_pylist()):
                if now is not None and now != (d, block):
                    size += multiply()
                    own = {}
                    if size > held_bytes:
                        yield from _tile_rows(held)
                        held, size = {}, 0
                now = (d, block)
                own[col] = np.frombuffer(x).reshape(-1, min(tile, d - col * tile))
        if now is not None:
            multiply()
        yield from _tile_rows(held)

    # Each row block is one key of bounded size.
    return blocks.repartition("d", "row_block").sortWithinPartitions("d", "row_block").mapInArrow(run, _TILE)


def tile_sums(products: DataFrame) -> DataFrame:
    """(d, i, k, m): the products of each tile added. A task holds one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for d, i, k, m in zip(*(b[c].to_pylist() for c in ("d", "i", "k", "m"))):
                own = np.frombuffer(m)
                if now == (d, i, k):
                    total = total + own
                    continue
                if now:
                    yield from _tile_rows({now: total})
                now, total = (d, i, k), own
        if now:
            yield from _tile_rows({now: total})

    return products.repartition("d", "i", "k").sortWithinPartitions("d", "i", "k").mapInArrow(run, _TILE)


def covariances(fit: DataFrame, totals: dict[int, tuple[int, np.ndarray]], tile: int = TILE) -> dict[int, np.ndarray]:
    """The covariance per length (divisor n), assembled from its tiles: the width squared, whatever the number of rows."""
    out = {d: np.zeros((d, d)) for d in totals}
    for r in tile_sums(tile_products(column_blocks(fit, totals, tile), tile)).toLocalIterator():
        d, a, b = r["d"], r["i"] * tile, r["k"] * tile
        m = np.frombuffer(r["m"]).reshape(min(tile, d - a), min(tile, d - b)) / totals[d][0]
        out[d][a : a + m.shape[0], b : b + m.shape[1]] = m
        out[d][b : b + m.shape[1], a : a + m.shape[0]] = m.T
    return out


def decomposed(n: int, s: np.ndarray, v: np.ndarray, components: int = COMPONENTS) -> Space:
    """The leading components of a covariance, by falling variance."""
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    trace = float(np.trace(v))
    e = np.where(e > NONE * trace, e, 0.0)[:components]
    return Space(n, s, int(s[0] // n), axes[:, :components].copy(), e, e / trace if trace > 0 else e, 0.0)


def identity_errors(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Per length: the largest entry by which the covariance of the whitened fit list differs from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in _arrays(b):
                # A column of ones beside them gives the sums too.
                z = np.column_stack([np.ones(len(x)), spaces[d].whitened(x)])
                held[d] = held.get(d, 0) + z.T @ z
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["d", "m"])

    per = fit.mapInArrow(run, "d int, m array<double>").select("d", F.posexplode("m").alias("i", "m")).groupBy("d", "i").agg(F.sum("m").alias("m"))
    found: dict[int, np.ndarray] = {d: np.zeros((len(s.values) + 1) ** 2) for d, s in spaces.items()}
    for r in per.collect():
        found[r["d"]][r["i"]] = r["m"]
    out = {}
    for d, s in spaces.items():
        m = found[d].reshape(len(s.values) + 1, -1) / s.n
        real = s.values > 0
        off = (m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(len(real)))[np.ix_(real, real)]
        out[d] = float(np.abs(off).max()) if off.size else 0.0
    return out


def fitted(rows: DataFrame, vector: Column, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, tile: int = TILE) -> dict[int, Space]:
    """A space per length of vector."""
    fit = materialize(distinct_vectors(rows, vector, scale, shift), "fit")
    totals = sums(fit)
    spaces = {d: decomposed(*totals[d], v, components) for d, v in covariances(fit, totals, tile).items()}
    errors = identity_errors(fit, spaces) if spaces else {}
    return {d: s._replace(identity_error=errors[d]) for d, s in spaces.items()}


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, tile: int = TILE) -> DataFrame:
    """Per row that takes part and component: id_col, component (from 1), n, deviation, whitened, explained, identity_error."""
    vector = F.col(f"`{vector_col}`")
    spaces = fitted(rows, vector, components, scale, shift, tile)
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _clean(b, "v", scale, shift):
                space = spaces[x.shape[1]]
                k, rows_ = len(space.values), len(at)
                again = np.repeat(np.arange(rows_), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        b["i"].take(pa.array(at[again])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, space.n)),
                        pa.array(space.deviations(x), pa.int64()).take(pa.array(again)), pa.array(space.whitened(x).ravel()),
                        pa.array(np.tile(space.explained, rows_)), pa.array(np.full(rows_ * k, space.identity_error)),
                    ],
                    ["i", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kept = rows.select(F.col(f"`{id_col}`").alias("i"), vector.alias("v"))
    out = kept.mapInArrow(run, f"i {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("i", id_col)
