"""Bit filters of longs, by which rows without a match are known before anything is shuffled.

A filter has 16 bits for each value, as long as that is at most 2 ** `MOST_BITS`, so its
size is bounded whatever the data's. It never denies a value that it was made
of; of others it lets some through (of very many values, more of them), so a join
decides after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 25
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _positions(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.view(np.uint64) * _FACTOR) >> np.uint64(64 - bits)


def _words(bits: int):
    """Values to (word, bits): 64 positions of the filter each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_positions(b["value"].to_numpy(), bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(held.view(np.int64))], ["word", "held"])

    return run


def bit_filter(values: DataFrame) -> bytes:
    """The filter of a table with one column of longs; a null is no value. The table is read twice and should be a written one."""
    own = values.toDF("value").where("value IS NOT NULL")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * own.count()).bit_length()))
    found = own.mapInArrow(_words(bits), "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found["word"].to_numpy()] = found["held"].to_numpy()
    return words.tobytes()


def may_hold(packed: bytes, values: np.ndarray) -> np.ndarray:
    words = np.frombuffer(packed, np.uint64)
    at = _positions(values, (len(words) * 64).bit_length() - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_be_in(packed: bytes, value: Column) -> Column:
    """False if a long is not among the filter's values, or null."""

    @F.arrow_udf("boolean")
    def held(x: pa.Array) -> pa.Array:
        return pa.array(may_hold(packed, x.to_numpy(zero_copy_only=False)))

    return value.isNotNull() & held(F.coalesce(value, F.lit(0).cast("long")))
