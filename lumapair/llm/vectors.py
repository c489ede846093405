"""Near-duplicate vectors through a robust-pruned flat graph (operator 9).

Unit vectors are dealt to overlapping cluster shards: each goes to its `overlap`
nearest centres, and a shard that holds too many is dealt again with centres of its
own, level by level. The nearest is its home. Each shard builds a flat proximity
graph: vectors are inserted in batches, the greedy search from the medoid over the
graph so far names a vector's candidates, and robust pruning drops a candidate if a kept
neighbour is closer to it by `alpha`; a second pass goes over the whole graph. Edges lead
both ways. The adjacency lists of a vector from all its shards are united; they say where it leads to.

Vectors then walk over shards in rounds. A vector visits the homes of its nearest
centres first. In a shard, a greedy search starts at the medoid (and at a few vectors far from it and
each other) and expands the best vectors of its beam and every vector within the search range, until none is left. What
it has met at `cosine` or more, in double precision, is a link. It goes on to the shards
that the united lists of those within the search range lead to; whoever it finds visits
its home in turn. Rounds end when nobody has a shard left to go to, so a group of any
size is walked through whole.

Equal vectors (bit for bit after scaling) are one node with a multiplicity, so a
third of all rows being copies costs one node. A vector is counted in its home only,
so a pair counts once for each end; what leaves a shard are sums per visitor and
spanning links, never all pairs of a group.

Recall is audited: `audit` compares a bounded sample of queries with all rows.

Defined results for odd input: vectors that are null, zero, or hold null or non-finite
components link with nothing and keep themselves; vectors of each length are a space
of their own; repeated rows are vectors of their own and link with each other; ties in
distance go to the smaller node; an empty table gives an empty result; other columns
are ignored, whatever their names. Ids must not be null; rows without one are left out
of the result.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumapair.llm.components import connected_components
from lumapair.session import materialize

COSINE = 0.9
#: Vectors that a shard holds on average, and above which it is dealt again.
SHARD_ROWS, MOST_ROWS = 400, 2000
OVERLAP, LEVELS = 2, 6
#: Shards that a vector visits first, among the children of one shard.
VISITS = 4
#: Bytes of vectors that centres are drawn from on the driver, at most about, over all shards too large for a task; centres are fewer.
SAMPLE_BYTES = 64 << 20
#: Rows of a shard that one task deals again by centres of its own, at most.
TASK_ROWS = 20_000
MOST_CENTRES = 1024
DEGREE, BEAM, ALPHA = 24, 32, 1.2
#: Nodes of its beam that a search expands in a step.
STEP = 6
#: Vectors that a search starts from: the medoid, and others far from it and from each other.
STARTS = 4
#: Searches that run side by side.
BLOCK = 256
#: How far beyond the radius the walk goes on, in cosine.
SLACK = 0.1
AUDITED = 200


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def robust_prune(near: np.ndarray, sims: np.ndarray, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours kept of the candidates `near` (closest first) with cosines sims."""
    if not len(near):
        return []
    own = x[near]
    # stays[i]: the candidates that stay when candidate i is kept
    stays = alpha * (1.0 - own @ own.T) > 1.0 - sims
    np.fill_diagonal(stays, False)
    kept, alive, at = [], np.ones(len(near), bool), 0
    while len(kept) < degree:
        kept.append(at)
        alive[at] = False
        alive &= stays[at]
        at = int(alive.argmax())
        if not alive[at]:
            break
    return near[kept].tolist()


class Graph:
    """A flat proximity graph over unit vectors; row n of `lists` holds the neighbours of n, filled up with -1."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE) -> None:
        self.x = x
        self.lists = np.full((len(x), degree), -1, np.int32)
        # The medoid, and the vectors farthest from those chosen, so that a tight group around it traps no search.
        self.starts = [int((x @ x.mean(axis=0)).argmax())] if len(x) else []
        nearest = x @ x[self.starts[0]] if len(x) else x
        while len(self.starts) < min(STARTS, len(x)):
            self.starts.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[self.starts[-1]])
        self._dense: np.ndarray | None = None

    @classmethod
    def of(cls, x: np.ndarray, lists: list[np.ndarray]) -> Graph:
        g = cls(x, max([1, *map(len, lists)]))
        for i, a in enumerate(lists):
            g.lists[i, : len(a)] = a
        return g

    def _reached(self, row: np.ndarray, node: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Which nodes the expanded nodes of each search lead to."""
        if len(row) * 64 < shape[0] * shape[1]:
            out = np.zeros(shape, bool)
            to = self.lists[node]
            has = to >= 0
            out[np.broadcast_to(row[:, None], to.shape)[has], to[has]] = True
            return out
        if self._dense is None:
            self._dense = np.zeros((len(self.x), len(self.x)), np.float32)
            i, k = np.nonzero(self.lists >= 0)
            self._dense[i, self.lists[i, k]] = 1
        mask = np.zeros(shape, np.float32)
        mask[row, node] = 1
        return mask @ self._dense > 0

    def search(self, q: np.ndarray, beam: int = BEAM, within: float = np.inf) -> np.ndarray:
        """Cosines of each query with the nodes it met, -inf for the others: a greedy search from the medoid that ends when the best `beam` nodes and all within the range are expanded."""
        n = len(self.x)
        sims = np.full((len(q), n), -np.inf)
        sims[:, self.starts] = q @ self.x[self.starts].T
        unread = np.zeros(sims.shape, bool)
        unread[:, self.starts] = True
        active = np.arange(len(q))
        while len(active):
            own, fresh = sims[active], unread[active]
            kth = np.partition(own, n - beam, axis=1)[:, n - beam] if n > beam else np.full(len(active), -np.inf)
            open_ = np.where(fresh, own, -np.inf)
            best = np.argpartition(-open_, min(STEP, n) - 1, axis=1)[:, : min(STEP, n)]
            value = np.take_along_axis(open_, best, axis=1)
            go = open_ >= within
            r, c = np.nonzero((value >= kth[:, None]) & (value > -np.inf))
            go[r, best[r, c]] = True
            r, node = np.nonzero(go)
            if not len(r):
                break
            unread[active[r], node] = False
            new = self._reached(r, node, go.shape) & (own == -np.inf)
            r, node = np.nonzero(new)
            row = active[r]
            if 8 * len(r) > new.size:
                sims[row, node] = (q[active] @ self.x.T)[r, node]
            else:
                sims[row, node] = np.einsum("ij,ij->i", q[row], self.x[node])
            unread[row, node] = True
            active = active[go.any(axis=1)]
        return sims


def _linked(g: Graph, node: int, near: np.ndarray, sims: np.ndarray, degree: int) -> None:
    kept = robust_prune(near, sims, g.x, degree)
    g.lists[node] = -1
    g.lists[node, : len(kept)] = kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 11) -> Graph:
    """Robust-pruned graph of a shard, by greedy insertion: batches of doubling size, then all once more."""
    # Reverse edges may fill half as much again before a list is pruned.
    g, n = Graph(x, degree + degree // 2), len(x)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate((g.starts[:1], order[order != g.starts[0]])) if n else order
    size = np.zeros(n, np.int64)
    steps, at = [], 1
    while at < n:
        steps.append(order[at : at + min(max(1, at // 2), BLOCK)])
        at += len(steps[-1])
    steps += [order[i : i + BLOCK] for i in range(0, n, BLOCK)] if n > 1 else []
    for batch in steps:
        sims = g.search(x[batch], beam)
        back: dict[int, list[int]] = {}
        for i, row in zip(batch.tolist(), sims):
            row[i] = -np.inf
            met = np.flatnonzero(row > -np.inf)
            if len(met) > 2 * beam:
                met = met[np.argpartition(-row[met], 2 * beam - 1)[: 2 * beam]]
            met = np.union1d(met, (own := g.lists[i])[own >= 0])
            cosine = row[met]
            if not np.isfinite(cosine).all():
                cosine = x[met] @ x[i]
            rank = np.lexsort((met, -cosine))
            _linked(g, i, met[rank], cosine[rank], degree)
            size[i] = (g.lists[i] >= 0).sum()
            for j in g.lists[i, : size[i]].tolist():
                back.setdefault(j, []).append(i)
        for j, more in back.items():
            own = g.lists[j, : size[j]]
            more = np.setdiff1d(more, own)
            if size[j] + len(more) <= g.lists.shape[1]:
                g.lists[j, size[j] : size[j] + len(more)] = more
            else:
                near = np.concatenate((own, more))
                cosine = x[near] @ x[j]
                rank = np.lexsort((near, -cosine))
                _linked(g, j, near[rank], cosine[rank], degree)
            size[j] = (g.lists[j] >= 0).sum()
    return g


def _valid(vec: F.Column) -> F.Column:
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda v: v != 0)


_DEALT = "node long, v binary, shard long, rank int"


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _child(shard: int, k: int) -> int:
    """Number of the k-th child of a shard."""
    h = xxhash.xxh64_intdigest(struct.pack("<qq", shard, k), 5)
    return h - (1 << 64) if h >> 63 else h


def _deal(x: np.ndarray, rank: np.ndarray, c: np.ndarray, shard: int, visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, rank) of rows in the nearest of the centres c; rank is the place of the centre (0: home)."""
    k = min(visits, len(c))
    numbers = np.array([_child(shard, i) for i in range(len(c))], np.int64)
    top = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k]
    at = np.broadcast_to(np.arange(k), top.shape)
    # Who is at home goes to all; a row of the graph to two, another to one.
    go = at < np.where(rank == 0, visits, np.where(rank < OVERLAP, OVERLAP, 1))[:, None]
    return np.broadcast_to(np.arange(len(x))[:, None], top.shape)[go], numbers[top[go]], np.maximum(at, rank[:, None])[go]


def _nearest(packed: bytes, visits: int):
    """Rows to the same in the nearest centres of their shard, by centres known beforehand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: dict[int, np.ndarray] = pickle.loads(packed)
        for b in batches:
            if not len(b):
                continue
            shard = b["shard"].to_numpy()
            rows, to, place = [], [], []
            for s in np.unique(shard):
                mine = np.flatnonzero(shard == s)
                row, child, rank = _deal(_matrix(b["v"].take(pa.array(mine))), b["rank"].to_numpy()[mine], centres[int(s)], int(s), visits)
                rows.append(mine[row])
                to.append(child)
                place.append(rank)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [b["node"].take(at), b["v"].take(at), pa.array(np.concatenate(to), pa.int64()), pa.array(np.concatenate(place), pa.int32())], ["node", "v", "shard", "rank"]
            )

    return run


def _split(visits: int, shard_rows: int):
    """A whole shard, sorted by node, to the same in shards of its own centres."""

    def each(b: pa.RecordBatch):
        x, rank = _matrix(b["v"]), b["rank"].to_numpy()
        graph = x[rank < OVERLAP]
        row, child, place = _deal(x, rank, _centres(graph, len(graph), shard_rows), int(b["shard"][0].as_py()), visits)
        return b["node"].take(pa.array(row)), b["v"].take(pa.array(row)), child, place

    return each


def _centres(x: np.ndarray, rows: int, shard_rows: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means centres for a shard of that many rows, of which x are a sample."""
    rng = np.random.default_rng(seed)
    wanted = max(2, min(MOST_CENTRES, -(-rows * OVERLAP // shard_rows)))
    c = x[rng.choice(len(x), min(wanted, len(x)), replace=False)]
    for _ in range(4):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums**2).sum(axis=1))
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def shards(nodes: DataFrame, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS, visits: int = VISITS) -> DataFrame:
    """(node, v, shard, rank) of nodes (node, v): rank 0 is a node's home, below OVERLAP are the shards whose graph it is in, all are visited.

    Vectors of each length start as a shard of their own. What LEVELS of dealing leave
    too large is cut into blocks by hash, and its vectors visit all blocks. The driver
    gets a sample of bounded size from the shards that are too large for a task, no more.
    """
    columns = ["node", "v", "shard", "rank"]
    now, done = nodes.select("node", "v", F.octet_length("v").cast("long").alias("shard"), F.lit(0).alias("rank")), None
    split_schema = pa.schema([("node", pa.int64()), ("v", pa.binary()), ("shard", pa.int64()), ("rank", pa.int32())])
    for level in range(LEVELS + 1):
        sizes = now.where(F.col("rank") < OVERLAP).groupBy("shard").agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("width"))
        big = materialize(sizes.where(F.col("n") > (shard_rows if level == 0 else most_rows)), "large-shards")
        huge_rows, width = big.agg(F.sum(F.when(F.col("n") > TASK_ROWS, F.col("n"))), F.max("width")).first()
        if width is None:
            break
        rest = now.join(big, "shard", "left_anti").select(columns)
        part = now.join(big.select("shard", "n"), "shard")
        done = rest if done is None else done.union(rest)
        if level == LEVELS:
            blocks = F.ceil(F.col("n") / shard_rows)
            own = F.pmod(F.xxhash64("node"), blocks)
            every = part.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            home = F.when((F.col("rank") == 0) & (F.col("own") == F.col("block")), 0).otherwise(F.greatest("rank", F.lit(OVERLAP)))
            now = materialize(every.select("node", "v", F.xxhash64("shard", "block").alias("shard"), home.alias("rank")), "shards")
            break
        small, huge = part.where(F.col("n") <= TASK_ROWS).select(columns), part.where(F.col("n") > TASK_ROWS)
        dealt = small.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_by_shard(_split(visits, shard_rows), split_schema), _DEALT)
        if huge_rows:
            share = min(1.0, SAMPLE_BYTES / width / huge_rows)
            drawn = huge.where(F.col("rank") < OVERLAP).where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
            sample: dict[int, tuple[int, list[bytes]]] = {}
            for r in drawn.select("shard", "n", "v").orderBy("shard", "node").collect():
                sample.setdefault(r["shard"], (r["n"], []))[1].append(bytes(r["v"]))
            centres = {s: _centres(np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1), n, shard_rows) for s, (n, v) in sample.items() if len(v) > 1}
            known = nodes.sparkSession.createDataFrame([(s,) for s in centres], "shard long")
            chosen = huge.join(known, "shard", "left_semi").select(columns).mapInArrow(_nearest(pickle.dumps(centres), visits), _DEALT)
            # A shard of which fewer than two rows were drawn waits for the next level as it is.
            dealt = dealt.union(chosen).union(huge.join(known, "shard", "left_anti").select(columns))
        now = materialize(dealt, "shards")
    return now if done is None else done.union(now)


def _by_shard(each, schema: pa.Schema):
    """Sorted runs of a shard's rows to what `each` makes of them: columns of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            cols = each(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

        for b in batches:
            s = b["shard"].to_numpy()
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else [0]
            for i, j in zip(edges, edges[1:]):
                part = b.slice(i, j - i)
                if held and held[0]["shard"][0] != part["shard"][0]:
                    yield out()
                    held = []
                held.append(part)
        if held:
            yield out()

    return run


_GRAPH = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("v", pa.binary()), ("near", pa.list_(pa.int64())), ("close", pa.list_(pa.int64()))])
_GRAPH_DDL = "shard long, node long, v binary, near array<long>, close array<long>"


def both_ways(lists: np.ndarray) -> list[np.ndarray]:
    """Neighbours by edges of either direction. Pruning may leave a vector that no list names, as in a tight group around few centres; this way it is met from those it names."""
    n = len(lists)
    i, k = np.nonzero(lists >= 0)
    j = lists[i, k].astype(np.int64)
    edges = np.unique(np.concatenate((i * n + j, j * n + i)))
    return np.split(edges % n, np.searchsorted(edges, np.arange(1, n) * n)) if n else []


def _build(within: float):
    """A shard's nodes with their graph neighbours, and those of them that are within the search range."""

    def each(b: pa.RecordBatch):
        x, node = _matrix(b["v"]), b["node"].to_numpy()
        lists = both_ways(build_graph(x).lists)
        close = [a[x[a] @ x[i] >= within] for i, a in enumerate(lists)]
        return b["shard"], b["node"], b["v"], [node[a].tolist() for a in lists], [node[a].tolist() for a in close]

    return each


_TOLD = pa.schema([("what", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
#: What a shard tells: vector a has b links here; a and b are linked; a is to visit shard b.
_SUM, _LINK, _GO = range(3)


class _Home:
    """A shard's graph, searched by its visitors. Links count with the nodes at home; a guest leads to its own home."""

    def __init__(self, shard: int, b: pa.RecordBatch, cosine: float, within: float):
        self.shard, self.cosine, self.within = shard, cosine, within
        self.x, self.node = _matrix(b["v"]), b["node"].to_numpy()
        homes = b["home"].to_numpy()
        self.at_home = homes == shard
        self.times = np.where(self.at_home, b["times"].to_numpy(), 0)
        place = {n: i for i, n in enumerate(self.node.tolist())}
        self.graph = Graph.of(self.x, [np.array([place[n] for n in a], np.int64) for a in b["near"].to_pylist()])
        leads = [{h, *(a or [])} - {shard} for h, a in zip(homes.tolist(), b["leads"].to_pylist())]
        self.to = np.array(sorted(set().union(*leads)), np.int64)
        self.leads = np.zeros((len(leads), len(self.to)), np.float32)
        for i, a in enumerate(leads):
            self.leads[i, np.searchsorted(self.to, np.array(sorted(a), np.int64))] = 1
        self.group = np.arange(len(self.node))
        self.back: dict[int, np.ndarray] = {}

    def meet(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, node, home = _matrix(b["v"]), b["node"].to_numpy(), b["home"].to_numpy()
        sims = self.graph.search(x, within=self.within)
        near = (sims >= self.cosine) & self.at_home
        links = near @ self.times - (near & (node[:, None] == self.node)) @ self.times
        some = np.flatnonzero(links > 0)
        yield _told(_SUM, node[some], links[some])
        if len(self.to):
            q, t = np.nonzero((sims >= self.within).astype(np.float32) @ self.leads > 0)
            yield _told(_GO, node[q], self.to[t])
        first = np.empty(len(some), np.int64)
        for k, q in enumerate(some.tolist()):
            found = np.flatnonzero(near[q])
            first[k] = found[0]
            groups = self.group[found]
            if (low := groups.min()) != groups.max():
                self.group[np.isin(self.group, groups)] = low
        yield _told(_LINK, node[some], self.node[first])
        for h in np.unique(home[some]).tolist():
            if h != self.shard:
                found = near[some[home[some] == h]].any(axis=0)
                self.back[h] = self.back[h] | found if h in self.back else found

    def close(self) -> Iterator[pa.RecordBatch]:
        linked = np.flatnonzero(self.group != np.arange(len(self.group)))
        yield _told(_LINK, self.node[linked], self.node[self.group[linked]])
        for h, found in self.back.items():
            yield _told(_GO, self.node[found], np.full(int(found.sum()), h))


def _told(what: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), what), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_TOLD)


def _meet(cosine: float, within: float):
    """Rows sorted by shard, a shard's own nodes (visitor false) before its visitors, to what the shard tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, there = None, [], None

        def ready() -> _Home | None:
            return there or (_Home(now, pa.Table.from_batches(own).combine_chunks().to_batches()[0], cosine, within) if own else None)

        for b in batches:
            if not len(b):
                continue
            s, v = b["shard"].to_numpy(), b["visitor"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (v[1:] != v[:-1])) + 1).tolist(), len(s)]
            for i, j in zip(edges, edges[1:]):
                if int(s[i]) != now:
                    if there:
                        yield from there.close()
                    now, own, there = int(s[i]), [], None
                if not v[i]:
                    own.append(b.slice(i, j - i))
                elif (there := ready()) is not None:
                    for at in range(i, j, BLOCK):
                        yield from there.meet(b.slice(at, min(BLOCK, j - at)))
        if there:
            yield from there.close()

    return run


def _walk(dealt: DataFrame, nodes: DataFrame, cosine: float, slack: float) -> DataFrame:
    """What all shards tell (what, a, b) until no vector has a shard left to visit."""
    homes = dealt.where("rank = 0").select("node", F.col("shard").alias("home"))
    graph = dealt.where(F.col("rank") < OVERLAP).select("node", "v", "shard").repartition("shard").sortWithinPartitions("shard", "node")
    graph = materialize(graph.mapInArrow(_by_shard(_build(cosine - slack), _GRAPH), _GRAPH_DDL), "graph")
    # The lists of a vector from all its shards, united.
    edges = graph.select(F.col("node").alias("from"), F.explode("close").alias("node")).distinct()
    leads = edges.join(homes, "node").groupBy("from").agg(F.collect_set("home").alias("leads")).withColumnRenamed("from", "node")
    facts = materialize(nodes.select("node", "times").join(homes, "node").join(leads, "node", "left"), "homes")
    base = nodes.select("node", "v").join(facts.select("node", "times", "home"), "node")
    own = graph.select("shard", "node", "v", "near").join(facts, "node").select("shard", F.lit(False).alias("visitor"), "node", "v", "times", "home", "leads", "near")
    own = materialize(own, "own")
    new = materialize(dealt.select("node", "shard"), "visits")
    seen, told = new, None
    while True:
        none = F.lit(None).cast("array<long>")
        visitors = new.join(base, "node").select("shard", F.lit(True).alias("visitor"), "node", "v", "times", "home", none.alias("leads"), none.alias("near"))
        # Shards without a visitor have nothing to tell.
        here = own if told is None else own.join(new.select("shard").distinct(), "shard", "left_semi").select(own.columns)
        both = here.union(visitors).repartition("shard").sortWithinPartitions("shard", "visitor")
        found = materialize(both.mapInArrow(_meet(cosine, cosine - slack), "what int, a long, b long"), "told")
        told = found if told is None else told.union(found)
        going = found.where(F.col("what") == _GO).select(F.col("a").alias("node"), F.col("b").alias("shard")).distinct()
        new = materialize(going.join(seen, ["node", "shard"], "left_anti"), "visits")
        if new.isEmpty():
            return told
        seen = seen.union(new)


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, v or null); and one node per distinct unit vector (node = smallest id, v, times)."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for vec in b["vec"].to_pylist():
                x = np.array(vec, np.float64) if vec else None
                if x is not None:
                    big = np.abs(x).max()  # first, so that squares neither overflow nor vanish
                    x = x / big
                    x = x / np.sqrt(x @ x)
                out.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.binary())], ["id", "v"])

    vec = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(_valid(vec), vec).alias("vec"))
    rows = materialize(rows.mapInArrow(scaled, "id long, v binary"), "vectors")
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("times"))
    return rows, materialize(nodes, "nodes")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", slack: float = SLACK) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept."""
    rows, nodes = _nodes(vectors, id_col, vector_col)
    dealt = materialize(shards(nodes.select("node", "v")), "dealt")
    told = _walk(dealt, nodes, cosine, slack)
    links = told.where(F.col("what") == _SUM).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    classes = connected_components(told.where(F.col("what") == _LINK).select("a", "b"))
    whole = nodes.join(links, "node", "left").join(classes, "node", "left")
    per = materialize(whole.select("v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "classes")
    named = rows.where("v is not null").join(per, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = named.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = AUDITED) -> float:
    """Share of the links of at most `queries` vectors, drawn by hash, that result counts; all rows are compared with them in blocks."""
    rows, _ = _nodes(vectors, id_col, vector_col)
    drawn = rows.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    if not drawn:
        return 1.0
    packed = pickle.dumps(np.frombuffer(b"".join(bytes(r["v"]) for r in drawn), np.float64).reshape(len(drawn), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = pickle.loads(packed)
        n = np.zeros(len(q), np.int64)
        for b in batches:
            if len(b):
                n += (_matrix(b["v"]) @ q.T >= cosine).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(n)], ["q", "n"])

    size = len(bytes(drawn[0]["v"]))
    true = rows.where(F.octet_length("v") == size).mapInArrow(run, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()
    wanted = {drawn[r["q"]]["id"]: r["n"] - 1 for r in true}
    got = {r[id_col]: r["n_links"] for r in result.where(F.col(id_col).isin(list(wanted))).select(id_col, "n_links").collect()}
    total = sum(wanted.values())
    return sum(min(got.get(i, 0), n) for i, n in wanted.items()) / total if total else 1.0
