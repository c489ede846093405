"""Minimax contiguous partition of documents into shards (operator 4).

Equal texts form one atomic group. Groups are ordered by the first 64 bits of
the SHA-256 of their text; shards are contiguous runs of this order, and the
largest shard is as small as contiguous runs allow. The smallest feasible capacity is found by
binary search with a greedy check. Within that capacity the smallest shard is as large as can be, found
by a second binary search over what can still be completed; of the cuts that keep both, each is made
where the running sum comes nearest to an equal share of what is left. With fewer groups than shards,
groups larger than an equal share stand alone. The driver never holds all groups: it works on
sums over ranges of keys. A range that is refined no further is one that no greedy
cut can fall into for any capacity still in question; the others are split until
what is left in them are single groups. Sums held are bounded by
2^RANGE_BITS + MOST_SUMS per level.

Defined results for odd input: null text counts as empty and falls into the group
of empty texts; a text of any length is one size; equal rows are slotted in any order;
repeated rows and ids are rows of their own; fewer groups than
shards leave shards empty; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumapair.llm.ranks import numbered
from lumapair.session import materialize

SHARDS = 40
#: Bytes that each document counts besides its text.
OVERHEAD = 16
#: Ranges of keys of the first level.
RANGE_BITS = 14
#: Sums of refined ranges, or of single groups, that the driver may get at once.
MOST_SUMS = 1 << 17
_TOP = 1 << 64


def greedy(ends: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """Cuts (positions after the last group of each shard), each shard as full as capacity allows; None if over `most` are needed. ends: running sums."""
    cuts, at, done, n = [], 0, 0, len(ends)
    while at < n:
        if len(cuts) == most:
            return None
        nxt = int(np.searchsorted(ends, done + capacity, "right"))
        if nxt == at:
            return None
        cuts.append(nxt)
        at, done = nxt, int(ends[nxt - 1])
    return cuts


def smallest_capacity(sums: np.ndarray, most: int) -> int:
    """Smallest capacity at which a greedy partition of whole items into `most` runs succeeds."""
    if not len(sums):
        return 0
    ends = np.cumsum(sums)
    low, high = max(int(sums.max()), -(-int(ends[-1]) // most)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, most) is None:
            low = mid + 1
        else:
            high = mid
    return low


def balanced(sums: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts (positions after the last item of each shard) of whole items into runs of at most capacity, near an equal share each."""
    n, ends = len(sums), np.cumsum(sums)
    total = int(ends[-1])
    large = sums * shards > total
    cuts, at, done = [], 0, 0
    while at < n:
        left = shards - len(cuts)
        last = int(np.searchsorted(ends, done + capacity, "right"))
        # The first place from which the rest fits into the shards that are left; later places are no worse.
        low, high = at + 1, last
        while low < high:
            mid = (low + high) // 2
            rest = ends[mid:] - ends[mid - 1]
            if greedy(rest, capacity, left - 1) is None:
                low = mid + 1
            else:
                high = mid
        own = large[at:]
        nxt = at + int(own.argmax()) if own.any() else n
        if nxt == at:
            want = at + 1
        else:
            share = int(sums[at:][~own].sum()) / max(1, left - int(own.sum()))
            want = int(np.searchsorted(ends, done + share))
            # Up to the item that passes the share, or without it, whichever is nearer.
            if want < n and (want == at or ends[want] - done - share <= done + share - ends[want - 1]):
                want += 1
            want = min(want, nxt)
        at = min(max(want, low), last)
        cuts.append(at)
        done = int(ends[at - 1])
    return cuts


def _completable(ends: np.ndarray, least: int, most: int, shards: int) -> list[np.ndarray]:
    """For k = 0 to shards: from which places the rest can be cut into k runs of least to most each. ends starts with 0."""
    found = [np.zeros(len(ends), bool)]
    found[0][-1] = True
    low = np.maximum(np.searchsorted(ends, ends + least, "left"), np.arange(len(ends)) + 1)
    high = np.searchsorted(ends, ends + most, "right")
    for _ in range(shards):
        before = np.concatenate([[0], np.cumsum(found[-1])])
        found.append(before[high] > before[np.minimum(low, high)])
    return found


def even_cuts(sums: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cuts of whole items into runs of at most capacity, so that the smallest run is as large as can be; among these cuts, each near an equal share of what is left. None if some run would be empty."""
    ends = np.concatenate([[0], np.cumsum(sums)])
    low, high = 0, int(ends[-1]) // shards
    if not _completable(ends, 0, capacity, shards)[shards][0]:
        return None
    while low < high:
        mid = (low + high + 1) // 2
        if _completable(ends, mid, capacity, shards)[shards][0]:
            low = mid
        else:
            high = mid - 1
    ways = _completable(ends, low, capacity, shards)
    cuts, at = [], 0
    for left in range(shards, 0, -1):
        first = max(int(np.searchsorted(ends, ends[at] + low, "left")), at + 1)
        reach = np.arange(first, int(np.searchsorted(ends, ends[at] + capacity, "right")))
        reach = reach[ways[left - 1][reach]]
        share = (int(ends[-1]) - int(ends[at])) / left
        at = int(reach[np.abs(ends[reach] - ends[at] - share).argmin()])
        cuts.append(at)
    return cuts


def _possible_cuts(ends: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """Items into which a greedy cut may fall for a capacity from low to high, if items could be cut anywhere within."""
    total, n = int(ends[-1]), len(ends)
    starts = ends - np.diff(ends, prepend=0)
    hit = np.zeros(n, bool)
    lo = hi = 0
    for _ in range(most):
        # The shard ends after lo + low less one whole item at least, and before hi + high at most.
        a = int(np.searchsorted(ends, lo + low, "right"))
        b = int(np.searchsorted(ends, min(hi + high, total), "left"))
        if a >= n:
            break
        hit[a : b + 1] = True
        lo, hi = int(starts[a]), min(hi + high, total)
    return hit


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, range_bits: int = RANGE_BITS, most_sums: int = MOST_SUMS) -> tuple[int, list[int]]:
    """(capacity, first keys of shards 1, 2, ...) for a table (key, bytes) with a row per group; keys are distinct longs."""
    size = 1 << (64 - range_bits)
    bucket = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - range_bits)
    got = groups.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.min("key").alias("k")).collect()
    # (low end of the range as unsigned, width, bytes, distinct keys)
    parts = sorted((int(r["b"]) * size if r["n"] > 1 else int(r["k"]) + (1 << 63), size if r["n"] > 1 else 1, int(r["s"]), int(r["n"])) for r in got)
    while parts:
        sums = np.array([p[2] for p in parts], np.int64)
        ends = np.cumsum(sums)
        single = np.array([p[3] == 1 for p in parts])
        if single.all():
            break
        total = int(ends[-1])
        largest = int(sums[single].max()) if single.any() else 0
        low = max(largest, -(-total // shards))
        high = smallest_capacity(sums, shards)  # ranges kept whole: feasible
        split = _possible_cuts(ends, low, high, shards) & ~single
        if not split.any():  # pragma: no cover - a cut always falls somewhere
            break
        wanted = [p for p, s in zip(parts, split) if s]
        if sum(p[3] for p in wanted) <= most_sums:
            width = 1
        else:  # each into a power of two of ranges, two at least
            width = max(p[1] for p in wanted) >> max(1, (most_sums // len(wanted)).bit_length() - 1)
        parts = [p for p, s in zip(parts, split) if not s] + _refined(groups, wanted, width)
        parts.sort()
    if not parts:
        return 0, []
    sums = np.array([p[2] for p in parts], np.int64)
    capacity = smallest_capacity(sums, shards)
    cuts = even_cuts(sums, capacity, shards) or balanced(sums, capacity, shards)
    return capacity, [parts[c][0] - (1 << 63) for c in cuts[:-1]]


def _refined(groups: DataFrame, wanted: list[tuple[int, int, int, int]], width: int) -> list[tuple[int, int, int, int]]:
    spark = groups.sparkSession
    by_width: dict[int, list[int]] = {}
    for low, w, _, _ in wanted:
        by_width.setdefault(w, []).append(low // w)
    out = []
    for w, which in by_width.items():
        shift, fine = w.bit_length() - 1, min(w, width).bit_length() - 1
        unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        bucket = F.shiftrightunsigned(unsigned, shift)
        # At most shards x 2^range_bits range numbers, known to the driver already.
        chosen = spark.createDataFrame([(b,) for b in which], "b long")
        inside = groups.withColumn("b", bucket).join(chosen, "b", "left_semi")
        part = F.shiftrightunsigned(unsigned, fine) if fine else unsigned
        got = inside.groupBy(part.alias("p")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.min("key").alias("k")).collect()
        for r in got:
            alone = r["n"] == 1
            out.append((int(r["k"]) + (1 << 63) if alone else (int(r["p"]) % _TOP) << fine, 1 if alone else 1 << fine, int(r["s"]), int(r["n"])))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # conv() clamps nothing here: 16 hexadecimal digits are an unsigned long.
    key = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    _, firsts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for k in firsts:
        shard = shard + (F.col("key") >= F.lit(k)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    out = numbered(placed, F.col("shard"), [F.col("key"), F.col("_id").asc_nulls_last()], "slot", total)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
