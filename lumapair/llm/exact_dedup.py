"""Exact deduplication by Grace hashing (operator 5).

Two rounds of the same hash deduplication keep every task bounded. Round one
runs inside each input partition, so a text with very many copies shrinks to one
entry per partition before anything is shuffled. Round two runs on the entries,
partitioned by content hash. In both, an open-addressing table compares complete
contents; when what it holds passes the memory budget, records of contents it does not
hold are partitioned by further hash bits to spill files, which are treated the
same way, recursively. Spill files are private to a task and made anew when a task is
run again, so a lost executor loses none of them.

`exact_dedup` tells each row's group. `distinct_rows` returns the rows that stay, all
columns: the texts travel with their rows, in one shuffle.

Defined results for odd input: null text counts as empty; texts of any length are
compared whole (a task holds at least one); a null id is larger than every id; rows
that repeat an id and a text are copies of one another and carry the same keep_id
(kept is true for each of them, as it is a function of doc_id), while `distinct_rows`
keeps one of them: the one whose raw text, and then whose other values, come first in
order; an empty table gives an empty result; `exact_dedup` ignores other columns,
whatever their names.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumapair.session import materialize

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of distinct content that one table may hold before records spill.
MEMORY_BUDGET = 48 << 20
FANOUT_BITS = 4
_BATCH = 4096

#: (hash, content, what belongs to the record)
Record = tuple[int, bytes, object]


class OpenTable:
    """Open addressing with linear probing; a hit needs equal complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.bodies: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, body: bytes) -> tuple[int, int]:
        """(entry or -1, slot)"""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.bodies[e] == body:
                return e, at
            at = (at + 1) & mask
        return -1, at

    def add(self, h: int, body: bytes, slot: int) -> int:
        e = len(self.bodies)
        self.hashes.append(h)
        self.bodies.append(body)
        self.bytes += len(body) + 64
        self.slots[slot] = e
        if 2 * len(self.bodies) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, x in enumerate(self.hashes):
                at = (x ^ (x >> 29)) & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i
        return e


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Group:
    """Records of one content; `value` is for the caller, who says by `grow` how many bytes it holds more."""

    __slots__ = ("_table", "body", "h", "value")

    def __init__(self, h: int, body: bytes, table: OpenTable) -> None:
        self.h, self.body, self.value, self._table = h, body, None, table

    def grow(self, n: int) -> None:
        self._table.bytes += n


def grace(records: Iterable[Record], budget: int = MEMORY_BUDGET, level: int = 0) -> Iterator[tuple[Group, object, bool]]:
    """(group, what belongs to the record, False) for each record as it is placed, and (group, None, True) once for a group that is whole."""
    table, groups = OpenTable(), []
    files: list | None = None
    shift = (FANOUT_BITS * (level + 1)) % 60
    try:
        for r in records:
            h, body, extra = r
            e, slot = table.find(h, body)
            if e < 0:
                if table.bytes and table.bytes + len(body) > budget:
                    if files is None:
                        files = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
                    pickle.dump(r, files[(h >> shift) & ((1 << FANOUT_BITS) - 1)], pickle.HIGHEST_PROTOCOL)
                    continue
                e = table.add(h, body, slot)
                groups.append(Group(h, table.bodies[e], table))
            yield groups[e], extra, False
        for g in groups:
            yield g, None, True
        table = groups = None
        for i, f in enumerate(files or []):
            yield from grace(_read(f), budget, level + 1)
            f.close()
            files[i] = None
    finally:
        for f in files or []:
            if f:
                f.close()


def _read(file) -> Iterator[Record]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= _BATCH or size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_LOCAL = pa.schema([("link", pa.int64()), ("row_id", pa.int64()), ("sha", pa.string()), ("h", pa.int64()), ("small", pa.int64()), ("n", pa.int64()), ("body", pa.string())])
_GLOBAL = pa.schema([("link", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _within_partition(budget: int):
    """Rows of an input partition to member rows (row_id, sha, link), as they come, and one entry row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36

        def records() -> Iterator[Record]:
            for b in batches:
                for i, h, sha, body in zip(b["id"].to_pylist(), b["h"].to_pylist(), b["sha"].to_pylist(), b["body"].to_pylist()):
                    yield h, body.encode(), (i, sha)

        def rows() -> Iterator[tuple]:
            number = 0
            for g, extra, whole in grace(records(), budget):
                if whole:
                    link, small, n = g.value
                    yield link, None, None, g.h, small, n, g.body.decode()
                    continue
                i, sha = extra
                if g.value is None:
                    g.value, number = (base + number, i, 1), number + 1
                    g.grow(128)
                else:
                    link, small, n = g.value
                    g.value = link, _smaller(small, i), n + 1
                yield g.value[0], i, sha, None, None, None, None

        yield from _batches(rows(), _LOCAL)

    return run


def _across_partitions(budget: int):
    """Entries to (link, smallest id, count); a text has one entry per input partition at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                for link, h, small, n, body in zip(*(b[c].to_pylist() for c in ("link", "h", "small", "n", "body"))):
                    yield h, body.encode(), (link, small, n)

        def rows() -> Iterator[tuple]:
            for g, extra, whole in grace(records(), budget):
                if whole:
                    small, n, links = g.value
                    for link in links:
                        yield link, small, n
                    continue
                link, small, n = extra
                if g.value is None:
                    g.value = [small, n, [link]]
                else:
                    g.value[0], g.value[1] = _smaller(g.value[0], small), g.value[1] + n
                    g.value[2].append(link)
                g.grow(64)

        yield from _batches(rows(), _GLOBAL)

    return run


def _first_rows(names: list[str], id_at: int, text_at: int, budget: int):
    """Rows (h, body and the named columns) to the first row of each content; body is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def records() -> Iterator[Record]:
            nonlocal schema
            for whole in batches:
                schema = pa.schema([whole.schema.field("h"), *(whole.schema.field(c) for c in names)])
                for lo in range(0, len(whole), _BATCH):
                    b = whole.slice(lo, _BATCH)
                    for h, body, *row in zip(b["h"].to_pylist(), b["body"].to_pylist(), *(b[c].to_pylist() for c in names)):
                        yield h, body.encode(), row

        def order(row: list) -> tuple:
            i, text = row[id_at], row[text_at]
            return i is None, 0 if i is None else i, text is not None, text or "", repr(row)

        def rows() -> Iterator[tuple]:
            for g, row, whole in grace(records(), budget):
                if whole:
                    yield (g.h, *g.value)
                elif g.value is None:
                    g.value = row
                    g.grow(len(row[text_at] or "") + 256)
                elif order(row) < order(g.value):
                    g.grow(len(row[text_at] or "") - len(g.value[text_at] or ""))
                    g.value = row

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row[text_at + 1] or "") + 64
            if len(held) >= _BATCH or size >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return run


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = MEMORY_BUDGET) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    body = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("body"))
    hashed = body.select("id", F.xxhash64("body").alias("h"), F.sha2("body", 256).alias("sha"), "body")
    local = materialize(hashed.mapInArrow(_within_partition(budget), "link long, row_id long, sha string, h long, small long, n long, body string"), "dedup")
    entries = local.where("n is not null").select("link", "h", "small", "n", "body")
    groups = entries.repartition("h").mapInArrow(_across_partitions(budget), "link long, keep_id long, group_size long")
    members = local.where("n is null").select("link", "row_id", "sha")
    return members.join(groups, "link").select(
        F.col("row_id").alias(id_col), "keep_id", "group_size",
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = MEMORY_BUDGET) -> DataFrame:
    """The rows of docs that stay, one per text, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = docs.toDF(*names)
    schema = StructType([StructField("h", LongType()), *(StructField(f.name, f.dataType) for f in rows.schema)])
    first = _first_rows(names, id_at, text_at, budget)

    def reduced(table: DataFrame) -> DataFrame:
        body = normalised(F.col(names[text_at]))
        return table.select(F.xxhash64(body).alias("h"), body.alias("body"), *names).mapInArrow(first, schema)

    # The first round leaves one row per text and partition; only these are shuffled.
    return reduced(reduced(rows).repartition("h").select(names)).select(names).toDF(*docs.columns)
