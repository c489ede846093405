"""Sum-of-squares packing of documents into token sequences (operator 7).

A document is its token ids and one end id. Only longer documents than a sequence
are cut, into full pieces and a last one. A piece goes where the sum of the
squared counts of open sequences per residual gap becomes smallest: into an open
sequence, or into a new one. A sequence counts as open while a piece still to come fits it:
gaps that nothing fits would only draw pieces away from good fits.

Pieces are dealt by hash into groups of a bounded number of pieces, which are
packed side by side, longest piece first. What a group leaves in open sequences
goes on to the next round, with fewer groups, until one group is left. A round that
closes next to nothing is the last: its groups are samples of the same pieces, so
dealing them again would close as little, and their open sequences stay as they are.

Defined results for odd input: null text is empty, and an empty text is the end
id alone; a text of any length is cut into as many pieces as it needs; pieces of equal
length are packed in the order of id and piece; repeated rows are packed each for itself; an empty table gives an empty
result; other columns are ignored. Ids may be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumapair.llm.tokens import IdCache
from lumapair.session import materialize

LENGTH, END = 4096, 1
#: Pieces that one task packs, at most about.
GROUP_PIECES = 40_000
#: Share of its pieces that a round must place for another to follow.
LEAST_PLACED = 1 / 16
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces_of(ids: bytes, length: int = LENGTH, end: int = END) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document given by its little-endian 32-bit ids."""
    ids += end.to_bytes(4, "little")
    step = 4 * length
    return [(i, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for i, at in enumerate(range(0, len(ids), step))]


def _cut(tokenizer: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = IdCache.of(tokenizer)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, ids in zip(b["id"].to_pylist(), cache.each(b["text"])):
                for piece in pieces_of(ids, length, end):
                    for col, v in zip(cols, (i, *piece)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECE_SCHEMA.types)], schema=_PIECE_SCHEMA)

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH, until_none_fits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length, in the given order: bin and offset in it; and the gap each bin is left with. A bin is open while it has a gap, or only while a length still to come fits it."""
    # The smallest gap that is open after each length.
    least = np.ones(len(lengths), np.int64)
    if until_none_fits:
        least = np.append(np.minimum.accumulate(lengths[::-1])[::-1][1:], capacity + 1).astype(np.int64)[: len(lengths)]
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        # Change of the sum of squares if a bin of gap g takes n; a bin that closes no longer counts.
        change = 2 - 2 * counts[n:]
        change[1:] += 2 * counts[1 : capacity + 1 - n]
        change[0] -= 1
        closed = int(min(least[i], capacity + 1 - n))
        change[1:closed] = 1 - 2 * counts[n + 1 : n + closed]
        change[counts[n:] == 0] = np.iinfo(np.int64).max
        g = int(change.argmin())
        fresh = 2 * int(counts[capacity - n]) + 1 if capacity - n >= least[i] else 0
        # Of equal changes, an open bin comes before a new one, and the smallest gap first.
        if change[g] <= fresh:
            gap = g + n
            b = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - n
        if gap > n:
            counts[gap - n] += 1
            stacks[gap - n].append(b)
    return bins, offsets, np.array(gaps, np.int64)


_DEALT = pa.schema([*_PIECE_SCHEMA, ("g", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def _pack(capacity: int, last: bool):
    """Sorted runs of pieces by group g to the same with bin, offset and whether the bin is left open."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        bins, offsets, gaps = sum_of_squares(t["length"].to_numpy(), capacity, True)
        is_open = np.zeros(len(bins), bool) if last else gaps[bins] > 0
        for name, values in (("bin", bins), ("offset", offsets), ("open", is_open)):
            t = t.append_column(name, pa.array(values))
        yield from t.select(_DEALT.names).cast(_DEALT).to_batches(16384)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            g = b["g"].to_numpy()
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
            for x, y in zip(edges, edges[1:]):
                part = b.slice(x, y - x)
                if held and held[0]["g"][0] != part["g"][0]:
                    yield from packed(held)
                    held = []
                held.append(part)
        if held:
            yield from packed(held)

    return run


def pack(pieces: DataFrame, capacity: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (see document_pieces) with sequence_id and offset; pieces is read several times and should be a written table."""
    left, n, done, round_ = pieces, pieces.count(), None, 0
    while done is None or n:
        groups = max(1, n // group_pieces)
        # By row, so that repeated rows spread too; a written table numbers its rows alike each time.
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups))
        dealt = left.withColumn("g", key).repartition(groups, "g").sortWithinPartitions("g", F.col("length").desc(), "doc_id", "piece")
        schema = f"{_PIECE}, g long, bin long, offset long, open boolean"
        packed = dealt.mapInArrow(_pack(capacity, groups == 1), schema).withColumn("round", F.lit(round_))
        packed = materialize(packed, "packed")
        left = packed.where("open").select(*_PIECE_SCHEMA.names)
        before, n = n, left.count()
        last = groups == 1 or before - n < LEAST_PLACED * before
        whole = packed if last else packed.where("not open")
        done = whole if done is None else done.union(whole)
        if last:
            break
        round_ += 1
    # Rounds, groups and bins are below 2^8, 2^31 and 2^24.
    sequence = F.shiftleft(F.shiftleft(F.col("round").cast("long"), 31) + F.col("g"), 24) + F.col("bin")
    return done.select(*_PIECE_SCHEMA.names, sequence.alias("sequence_id"), "offset")


def document_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer, length, end), _PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(document_pieces(docs, tokenizer, id_col, text_col, length, end), "pieces"), length)
