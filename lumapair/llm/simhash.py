"""SimHash near-duplicates linked through BK-trees (operator 8).

Fingerprints within `radius` bits agree on at least one choice of `blocks - radius`
out of `blocks` blocks of bits. Each distinct fingerprint goes to one shard per
choice; in a shard a BK-tree, its children keyed by their Hamming distance to the
parent, is searched along edges within the radius only. A shard returns a spanning
chain of what it links, never all pairs. A shard above `SPLIT_ROWS` is dealt into parts,
and every two parts are searched together, so that no task holds more and no link is
lost. The number of blocks follows the number of
distinct fingerprints, so that shards of unrelated fingerprints stay small; every
choice of it finds the same links.

`near_groups` links documents by the exact Jaccard similarity of their shingle sets, in two
passes. The first is a search that finds nearly all links at little cost: documents that share
one of their least shingle hashes meet in a shard, a BK-tree of SimHash fingerprints finds those within `reach` bits there; shards above
`shard_docs` are dealt into parts in a random order, whose leaders (documents
similar to none before them) meet again, so that a family costs its size and not all its
pairs. The second finds every link that the first left out: in an order of all shingles, two
documents of the similarity share one of their first ones, so documents
of different groups that do are compared, unless size, place of the shingle or the parity of
their shingles rules it out. Texts do not move: their sets are made where they are read, of those
documents only that a bit filter lets through.

Defined results for odd input: null and empty texts, and texts of white space
only, have fingerprint zero and link like any other; fewer words than a shingle
make one shingle (`near_groups` links no text without a word); texts of any length are
read whole; ties in a bit (set in exactly half) give 0; equal rows share a
fingerprint; an empty table gives an empty result; other columns are ignored.
Ids must not be null; rows without one are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumapair.llm.components import connected_components
from lumapair.llm.membership import bit_filter, may_hold
from lumapair.session import discard, materialize

BITS, SEED = 64, 42
#: Unrelated fingerprints that a shard holds on average, at most.
SHARD_ROWS = 64
#: Fingerprints that one BK-tree holds, about; larger shards are searched part by part.
SPLIT_ROWS = 4000
_LANES = np.uint64(0x0101010101010101)
_CHUNK = 255 * 256
_FACTOR, _MIX = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, n = xxhash.xxh64_digest, len(starts)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        joined = b"".join([digest(whole[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])])
        h = np.frombuffer(joined, "<u8")
        h = np.concatenate((h, np.zeros(-len(h) % 255, np.uint64))).reshape(-1, 255)
        for bit in range(8):  # eight byte lanes are counted at once
            lanes = ((h >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
            counts[bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    # digests are big-endian: byte 0, read as the lowest, holds the highest bits
    value = 0
    for lane in range(8):
        for bit in range(8):
            if 2 * counts[8 * lane + bit] > n:
                value |= 1 << (8 * (7 - lane) + bit)
    return value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), shingle)) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps, pa.int64())], ["id", "fp"])

    return run


def bk_chain(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Positions linked in chains, one chain for each set that links within radius connect."""
    kids: list[dict[int, int]] = [{}]
    group = list(range(len(fps)))

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i in range(1, len(fps)):
        x, mine, stack = fps[i], i, [0]
        while stack:
            j = stack.pop()
            d = (x ^ fps[j]).bit_count()
            if d <= radius and (r := root(j)) != mine:
                low, high = (r, mine) if r < mine else (mine, r)
                group[high] = mine = low
            for e, k in kids[j].items():
                if -radius <= e - d <= radius:
                    stack.append(k)
        j = 0
        while (nxt := kids[j].get(d := (x ^ fps[j]).bit_count())) is not None:
            j = nxt
        kids[j][d] = i
        kids.append({})
    last: dict[int, int] = {}
    chain = []
    for i in range(len(fps)):
        if (r := root(i)) in last:
            chain.append((last[r], i))
        last[r] = i
    return chain


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, nodes = None, [], []

        def links():
            pairs = bk_chain(fps, radius) if len(fps) > 1 else []
            return [nodes[i] for i, _ in pairs], [nodes[j] for _, j in pairs]

        for b in batches:
            a_out, b_out = [], []
            for k, fp, node in zip(b["k"].to_pylist(), b["fp"].to_pylist(), b["node"].to_pylist()):
                if k != key:
                    x, y = links()
                    a_out += x
                    b_out += y
                    key, fps, nodes = k, [], []
                fps.append(fp & (2**64 - 1))
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
        x, y = links()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def block_masks(distinct: int, radius: int, shard_rows: int = SHARD_ROWS) -> list[int]:
    """A mask for each choice of blocks, as few choices as give shards of shard_rows on average."""
    for blocks in range(radius + 1, 2 * radius + 3):
        edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
        choices = list(combinations(range(blocks), blocks - radius))
        bits = min(sum(edges[i + 1] - edges[i] for i in c) for c in choices)
        if distinct <= shard_rows << bits:
            break
    return [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in choices]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 lowercase hex digits), component_id."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = materialize(texts.mapInArrow(_fingerprints(shingle), "id long, fp long"), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    masks = [_signed(m) for m in block_masks(nodes.count(), radius)]
    shards = nodes.select("fp", "node", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("p", "mask"))
    shards = shards.select(F.xxhash64("p", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "fp", "node")
    large = materialize(shards.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > split_rows), "large-shards")
    if not large.isEmpty():
        parts = F.coalesce(F.ceil(2 * F.col("n") / split_rows), F.lit(1).cast("long"))
        dealt = shards.join(large, "k", "left").withColumn("parts", parts).withColumn("t", F.pmod(F.xxhash64("fp", "k"), F.col("parts")))
        both = dealt.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 or t <> u")
        shards = both.select(F.xxhash64("k", F.least("t", "u"), F.greatest("t", "u")).alias("k"), "fp", "node")
    links = shards.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(_shard_links(radius), "a long, b long")
    classes = connected_components(links)
    found = materialize(nodes.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Least shingle hashes by which a document looks for others in the first pass.
KEYS = 5
#: Bits within which a BK-tree searches in the first pass; at a similarity of 0.8 two fingerprints differ in 9.7 bits, and in more than 18 once in 1000.
REACH = 18
SHARD_DOCS = 1000
#: Sets that are laid out as arrays at a time.
GRAM_ROWS = 512
#: A large shard that its parts' leaders do not shrink to this share is left to the second pass.
SHRUNK = 0.75
#: Buckets of shingle hashes (bits) whose level, 0 to 3, tells how often their most frequent shingle repeats.
LEVEL_BITS = 22
#: Shingles of a task that are counted together, about.
COUNTED = 1 << 21


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, which stand for the shingles: hashes of the words, put together and mixed."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle, len(words))
    n = len(words) - k + 1
    own = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _FACTOR + own[i : i + n]
    h ^= h >> np.uint64(33)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _keys(shingle: int, keys: int):
    """Documents to the least of their shingle hashes (node, keys), and of blocks of documents the shingles that several have, with their numbers (keys, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows(nodes: pa.Array, least: list, times: list) -> pa.RecordBatch:
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([nodes, pa.array(least, kind), pa.array(times, kind)], ["node", "keys", "times"])

        def repeated() -> Iterator[pa.RecordBatch]:
            if held:
                grams, times = np.unique(np.concatenate(held), return_counts=True)
                grams, times = grams[times > 1].view(np.int64), times[times > 1].astype(np.int64)
                for lo in range(0, len(grams), 1 << 16):
                    yield rows(pa.nulls(1, pa.int64()), [grams[lo : lo + (1 << 16)]], [times[lo : lo + (1 << 16)]])

        for b in batches:
            least = []
            for t in b["text"]:
                own = shingle_set(t.as_py(), shingle)
                least.append(own[:keys].copy().view(np.int64))
                held.append(own)
                n += len(own)
                if n >= COUNTED:
                    yield from repeated()
                    held, n = [], 0
            yield rows(b["id"], least, [None] * len(least))
        yield from repeated()

    return run


def _levels(counted: DataFrame) -> bytes:
    """A level for each bucket of shingle hashes, from (keys, times). It serves the order of shingles only, which may be any: every order finds the same links."""
    each = counted.select(F.explode(F.arrays_zip("keys", "times")).alias("e")).groupBy(F.col("e.keys").alias("gram")).agg(F.sum("e.times").alias("n")).where("n >= 8")
    level = F.least(F.lit(3), F.floor(F.log2("n") / 3)).cast("int")
    found = each.groupBy(F.col("gram").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).alias("bucket")).agg(F.max(level).alias("level")).toArrow()
    levels = np.zeros(1 << LEVEL_BITS, np.uint8)
    levels[found["bucket"].to_numpy()] = found["level"].to_numpy()
    return levels.tobytes()


def parity(own: np.ndarray) -> bytes:
    """A bit for each bucket of shingle hashes, as many as there are hashes at least and 64: whether it holds an odd number of them."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits(np.bincount(own.view(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_shared(m: int, n: int, a: bytes, b: bytes) -> int:
    """What sets of m and n shingles have in common at most, by their parities: a bucket in which these differ has a shingle of one set alone."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    p, q = 8 * len(a), 8 * len(b)
    # The larger one's halves together are the parity for half as many buckets.
    while p != q:
        if p < q:
            x, y, p, q = y, x, q, p
        p //= 2
        x = (x >> p) ^ (x & ((1 << p) - 1))
    return (m + n - (x ^ y).bit_count()) // 2


def _may_be_similar(similarity: float):
    """Pairs with sizes and parities to those that these do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("m", "n", "a_bits", "b_bits")]
            may = pa.array([most_shared(m, n, x, y) >= similarity / (1 + similarity) * (m + n) - 1e-6 for m, n, x, y in zip(*cols)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(may), batch["b"].filter(may)], ["a", "b"])

    return run


def _first_grams(shingle: int, similarity: float, packed: bytes):
    """Documents to the number of their shingles, their parity and the first of them, by level and hash: as many as may be missing in a similar document, and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(packed, np.uint8)
        for b in batches:
            sizes, bits, first = [], [], []
            for t in b["text"]:
                own = shingle_set(t.as_py(), shingle)
                level = levels[own & np.uint64(len(levels) - 1)].astype(np.uint64)
                placed = np.sort((level << np.uint64(61)) | (own >> np.uint64(3))).view(np.int64)
                sizes.append(len(own))
                bits.append(parity(own))
                first.append(placed[: len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1].copy() if len(own) else placed)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["node", "size", "bits", "grams"])

    return run


def _places(packed: bytes):
    """Documents (node, size, grams) to a row for each of the grams that the filter lets through, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), GRAM_ROWS):
                b = whole.slice(lo, GRAM_ROWS)
                key = b["grams"].flatten().to_numpy()
                n = pc.list_value_length(b["grams"]).to_numpy()
                may = np.flatnonzero(may_hold(packed, key))
                place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(np.arange(len(b)), n)[may]
                cols = [pa.array(key[may]), b["node"].take(pa.array(of)), b["size"].take(pa.array(of)), pa.array(place[may].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "node", "size", "place"])

    return run


def candidates(nodes: np.ndarray, groups: np.ndarray, sizes: np.ndarray, places: np.ndarray, similarity: float, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different groups that share a shingle, at its places in their orders, and may be similar if it is the first that they share; `one` pair for each two groups, or all."""
    a_out, b_out = [], []
    rest = sizes - places
    for lo in range(0, len(nodes), 256):
        i = slice(lo, lo + 256)
        least = np.ceil(similarity / (1 + similarity) * (sizes[i, None] + sizes) - 1e-6)
        may = (groups[i, None] != groups) & (np.minimum(rest[i, None], rest) >= least)
        may &= np.minimum(sizes[i, None], sizes) >= similarity * np.maximum(sizes[i, None], sizes) - 1e-6
        may &= np.arange(len(nodes))[i, None] < np.arange(len(nodes))
        x, y = np.nonzero(may)
        x += lo
        if one and len(x):
            low, high = np.minimum(groups[x], groups[y]), np.maximum(groups[x], groups[y])
            at = np.unique(np.stack([low, high]), axis=1, return_index=True)[1]
            x, y = x[at], y[at]
        a_out.append(np.minimum(nodes[x], nodes[y]))
        b_out.append(np.maximum(nodes[x], nodes[y]))
    return np.concatenate(a_out), np.concatenate(b_out)


def _candidates(similarity: float, one: bool):
    """Rows sorted by key to candidate pairs (a, b), key by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            key, *cols = [t[c].to_numpy() for c in ("key", "node", "component", "size", "place")]
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(edges, edges[1:]):
                a, b = candidates(*[c[i:j] for c in cols], similarity, one)
                for lo in range(0, len(a), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + (1 << 16)]), pa.array(b[lo : lo + (1 << 16)])], ["a", "b"])

        for b in batches:
            key = b["key"].to_numpy()
            # What may go on in the next batch waits for it.
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if held and len(key) and held[-1]["key"][0].as_py() != key[0]:
                yield from out()
                held = []
            if last:
                held.append(b.slice(0, last))
                yield from out()
                held = []
            if len(key):
                held.append(b.slice(last))
        if held:
            yield from out()

    return run


def _let_through(packed: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents whose id the filter lets through."""
    for b in batches:
        yield b.filter(pa.array(may_hold(packed, b["id"].to_numpy())))


def _arrays(shingle: int, packed: bytes):
    """Documents that the filter lets through to their shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _let_through(packed, batches):
            for lo in range(0, len(whole), GRAM_ROWS):
                b = whole.slice(lo, GRAM_ROWS)
                own = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b["text"]]
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(own, pa.list_(pa.int64()))], ["node", "grams"])

    return run


def _sets(shingle: int, packed: bytes):
    """Documents that the filter lets through to fingerprint and set; 32 bits of a hash tell the shingles of two documents apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _let_through(packed, batches):
            for lo in range(0, len(whole), GRAM_ROWS):
                b = whole.slice(lo, GRAM_ROWS)
                fps, grams = [], []
                for t in b["text"]:
                    fps.append(_signed(fingerprint(t.as_py(), shingle)))
                    grams.append(np.unique(shingle_set(t.as_py(), shingle).astype("<u4")).tobytes())
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps, pa.int64()), pa.array(grams, pa.binary())], ["node", "fp", "grams"])

    return run


def leaders_and_links(nodes: list[int], fps: list[int], sets: list[np.ndarray], similarity: float, reach: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Positions of the leaders (those similar to none before them), and pairs of positions that are similar; each position is compared with all before it that its group does not hold yet."""
    leaders: list[int] = []
    kids: list[dict[int, int]] = []
    group = list(range(len(nodes)))
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i in range(len(nodes)):
        x, near = fps[i], []
        stack = [0] if i else []
        while stack:
            j = stack.pop()
            d = (x ^ fps[j]).bit_count()
            if d <= reach:
                near.append((d, j))
            for e, k in kids[j].items():
                if -reach <= e - d <= reach:
                    stack.append(k)
        linked = False
        a = sets[i]
        for _, j in sorted(near):
            b = sets[j]
            if root(i) == root(j) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both):
                links.append((i, j))
                group[root(i)] = root(j)
                linked = True
        if not linked:
            leaders.append(i)
        kids.append({})
        at = 0
        while at != i:
            at = kids[at].setdefault((x ^ fps[at]).bit_count(), i)
    return leaders, links


_FOUND = pa.schema([("what", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("grams", pa.binary())])


def _part(similarity: float, reach: int):
    """Rows of a part, sorted by (key, g) and a random order, to links (what 0: a, b) and, of shards in several parts, leaders (what 1: a is the node, b the size of its shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            nodes = t["node"].to_pylist()
            fps = [x & (2**64 - 1) for x in t["fp"].to_pylist()]
            sets = [np.frombuffer(x, "<u4") for x in t["grams"].to_pylist()]
            leaders, links = leaders_and_links(nodes, fps, sets, similarity, reach)
            n, none = len(links), [None] * len(links)
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip([[0] * n, [nodes[i] for i, _ in links], [nodes[j] for _, j in links], none, none, none], _FOUND.types)], schema=_FOUND)
            if t["parts"][0].as_py() > 1:
                at = pa.array(leaders, pa.int64())
                cols = [pa.array([1] * len(leaders), pa.int32()), t["node"].take(at), t["n"].take(at), t["key"].take(at), t["fp"].take(at), t["grams"].take(at)]
                yield from pa.table([c if isinstance(c, pa.Array) else c.combine_chunks() for c in cols], schema=_FOUND).to_batches(2048)

        for b in batches:
            key, g = b["key"].to_numpy(), b["g"].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (g[1:] != g[:-1])) + 1).tolist(), len(key)] if len(key) else [0]
            for i, j in zip(edges, edges[1:]):
                if held and now != (key[i], g[i]):
                    yield from out()
                    held = []
                now = (key[i], g[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from out()

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as arrays, once per shard of each document."""
    for whole in batches:
        for lo in range(0, len(whole), GRAM_ROWS):
            b = whole.slice(lo, GRAM_ROWS)
            sizes = pc.binary_length(b["grams"]).to_numpy() // 4
            flat = np.frombuffer(b"".join(b["grams"].to_pylist()), "<u4").astype(np.int64)
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b["key"], b["node"], own], ["key", "node", "grams"])


def _meeting(each: DataFrame) -> DataFrame:
    """(key, n) of the shards of (key, node) that hold two documents or more; of shards with the same documents, one is enough."""
    sizes = each.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("n > 1")
    return sizes.groupBy("n", "members").agg(F.min("key").alias("key")).select("key", "n")


def _rare_keys(stuck: DataFrame, similarity: float, shard_docs: int) -> tuple[DataFrame, DataFrame]:
    """The keys of the second pass with exact counts of shingles, as tests hold them; for documents (key, node, grams) of shards too large to be compared whole: (key, node) by shingles that few of the shard have, and (key, node) of those made of shingles that many have.

    Shingles in more than shard_docs documents of a shard are left aside. Two documents of the
    similarity still share so many others that each has one of them among its first, in any order common
    to both: as many as may differ, and one. So no pair is lost, and no key has more than
    shard_docs documents. Only pairs of documents that consist of the shingles left aside to that
    share may have nothing else in common; these are the second result.
    """
    each = stuck.select("key", "node", "grams").mapInArrow(_grams, "key long, node long, grams array<long>")
    each = materialize(each.select("key", "node", F.size("grams").alias("size"), F.explode("grams").alias("gram")), "near-grams")
    common = each.groupBy("key", "gram").agg(F.count("*").alias("n")).where(F.col("n") > shard_docs)
    rare = each.join(common, ["key", "gram"], "left_anti").groupBy("key", "node").agg(F.sort_array(F.collect_list("gram")).alias("rare"))
    sizes = each.select("key", "node", "size").distinct()
    docs = materialize(sizes.join(rare, ["key", "node"], "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<long>"))), "near-rare")
    shared = F.ceil(F.lit(similarity) * F.col("size")) - (F.col("size") - F.size("rare"))
    first = F.when(shared > 0, F.slice("rare", 1, (F.size("rare") - shared + 1).cast("int"))).otherwise(F.col("rare"))
    keys = docs.select("key", "node", F.explode(first).alias("gram")).select(F.xxhash64("key", "gram").alias("key"), "node")
    return keys, docs.where(shared <= 0).select("key", "node")


def _compared(texts: DataFrame, parities: DataFrame, met: DataFrame, shingle: int, similarity: float, shard_docs: int, one: bool) -> DataFrame:
    """(a, b) of similar documents of different components among those that have a key in common; met is (key, node, component, size, place), parities (node, size, bits)."""
    sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rows = met.join(sizes.select("key", "n"), "key")
    # Every two parts of a large group, so that no task meets the whole of it.
    parts = F.when(F.col("n") > shard_docs, F.ceil(2 * F.col("n") / shard_docs)).otherwise(1).cast("long")
    dealt = rows.withColumn("parts", parts).withColumn("t", F.pmod(F.xxhash64("node", "key"), F.col("parts")))
    both = dealt.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 OR t <> u")
    own = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("t", "u"), F.greatest("t", "u")))
    keyed = both.select(own.alias("key"), "node", "component", "size", "place").repartition("key").sortWithinPartitions("key")
    pairs = materialize(keyed.mapInArrow(_candidates(similarity, one), "a long, b long").distinct(), "near-pairs")
    own, other = (parities.select(F.col("node").alias(c), F.col("size").alias(size), F.col("bits").alias(f"{c}_bits")) for c, size in (("a", "m"), ("b", "n")))
    near = pairs.join(own, "a").join(other, "b").mapInArrow(_may_be_similar(similarity), "a long, b long").distinct()
    met_pairs, pairs = pairs, materialize(near, "near-pairs")
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-named")
    grams = texts.mapInArrow(_arrays(shingle, bit_filter(named)), "node long, grams array<long>")
    sets = materialize(grams.join(named, "node", "left_semi"), "near-sets")
    first, second = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")) for c in ("a", "b"))
    shared = pairs.join(first, "a").join(second, "b").select("a", "b", F.size("a_grams").alias("m"), F.size("b_grams").alias("n"), F.size(F.array_intersect("a_grams", "b_grams")).alias("shared"))
    links = materialize(shared.where(F.col("shared") >= F.lit(similarity) * (F.col("m") + F.col("n") - F.col("shared"))).select("a", "b"), "near-links")
    discard(met_pairs, pairs, named, sets)
    return links


def _found_by_search(texts: DataFrame, least: DataFrame, shingle: int, similarity: float, reach: int, shard_docs: int) -> list[DataFrame]:
    """Tables with (a, b) of similar documents, nearly all links that count, by shards of the least hashes (node, keys)."""
    each = least.select(F.explode("keys").alias("key"), "node")
    shards = materialize(_meeting(each), "near-shards")
    mine = materialize(each.join(shards, "key").groupBy("node").agg(F.collect_set(F.struct("key", "n")).alias("shards")), "near-members")
    # Only documents that meet another are cut into shingles again, and send their sets.
    sets = texts.mapInArrow(_sets(shingle, bit_filter(mine.select("node"))), "node long, fp long, grams binary").join(mine, "node")
    rows = sets.select(F.explode("shards").alias("s"), "node", "fp", "grams").select("s.key", "s.n", "node", "fp", "grams")
    links, round_ = [], 0
    while True:
        parts = F.ceil(F.col("n") / shard_docs)
        dealt = rows.withColumn("parts", parts).withColumn("g", F.pmod(F.xxhash64("node", "key", F.lit(round_)), F.col("parts")))
        dealt = dealt.repartition("key", "g").sortWithinPartitions("key", "g", F.xxhash64("node", "key"), "node")
        found = materialize(dealt.mapInArrow(_part(similarity, reach), "what int, a long, b long, key long, fp long, grams binary"), "near-found")
        links.append(found.where("what = 0").select("a", "b"))
        leaders = found.where("what = 1").select("key", F.col("a").alias("node"), F.col("b").alias("before"), "fp", "grams")
        counts = leaders.groupBy("key").agg(F.count("*").alias("n"), F.max("before").alias("before"))
        counts = materialize(counts.where((F.col("n") <= shard_docs) | (F.col("n") <= SHRUNK * F.col("before"))).select("key", "n"), "near-leaders")
        if counts.isEmpty():
            break
        rows, round_ = leaders.join(counts, "key").select("key", "n", "node", "fp", "grams"), round_ + 1
    discard(shards, mine)
    return links


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, keys: int = KEYS, reach: int = REACH, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(node, component) of every id that is linked to another: component is the smallest id reachable over pairs of at least that similarity.

    `keys`, `reach` and `shard_docs` decide what the first pass finds and how large its shards are, not the result:
    the second pass compares what may be similar and is in different components, first one pair of each two
    components that meet (most of them become one by it), then all that are left.
    """
    texts = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = materialize(texts.mapInArrow(_keys(shingle, keys), "node long, keys array<long>, times array<long>"), "near-keys")
    links = _found_by_search(texts, counted.where("node IS NOT NULL").select("node", "keys"), shingle, similarity, reach, shard_docs)
    groups = connected_components(_united(links))
    levels = _levels(counted.where("node IS NULL"))
    first = materialize(texts.mapInArrow(_first_grams(shingle, similarity, levels), "node long, size int, bits binary, grams array<long>"), "near-first")
    # Shingles that several documents have; of those with the same documents, the first in order is enough.
    several = first.select(F.explode("grams").alias("key"), "node").groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    several = materialize(several.where("low <> high").select("key"), "near-several")
    each = first.select("node", "size", "grams").mapInArrow(_places(bit_filter(several)), "key long, node long, size int, place int")
    each = materialize(each.join(several, "key"), "near-each")
    members = each.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = materialize(members.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "near-chosen")
    met = materialize(each.join(chosen, "key").select("key", "node", "size", "place"), "near-met")
    discard(several, each, chosen)
    for one in (True, False):
        left = met.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        links = _compared(texts, first.select("node", "size", "bits"), left, shingle, similarity, shard_docs, one)
        if not links.isEmpty():
            groups = connected_components(links.union(groups.select("node", "component")))
    discard(counted, first, met)
    return groups


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out
