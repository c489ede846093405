"""The stages of corpus_pipeline against brute force, on rows with nulls, repeats, ties and clashing columns."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from lumapair.llm import exact_dedup, language, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, `n.chars` long, _id long, _copy int, c0 string, h long, node long"


def _rows() -> list[tuple]:
    rng = np.random.default_rng(30)
    words = [f"wo{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(4)]
    out = []
    for i in range(60):
        w = rng.choice(words, rng.integers(60, 200)).tolist()
        out.append((i, " ".join(w)))
        if i % 3 == 0:  # near copies, some of them just beyond the bound
            for c, step in ((100, 90), (200, 45), (300, 12)):
                out.append((i + c, " ".join("changed" if k % step == step - 1 else x for k, x in enumerate(w))))
        if i % 4 == 0:
            out.append((i + 400, "  ".join(w)))
    out += [(None, out[0][1]), (None, "no id here"), (None, None), (500, ""), (501, " \n "), (502, "12 34"), (503, "word " * 30_000), (1, out[4][1]), (7, "a b"), (7, "a b"), (7, "a  b")]
    return [(i, t, "en" if (i or 0) % 2 else None, ["a", "b", None][(i or 0) % 3], 5, 77, 78, "z", 79, 80) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


def test_stages_take_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, "")
        assert got.count() == 0 and (name == "pack" or got.columns == empty.columns)


def test_language_stage(spark, docs):
    got = Counter(map(tuple, corpus_pipeline.identified(spark, docs, "").collect()))
    assert got == Counter(r for r in _rows() if r[1] and any(map(str.isalpha, r[1])))
    assert language.identified(docs, language.Model([], np.zeros((0, 1)))).count() == 0


def _first_rows(rows: list[tuple]) -> Counter:
    by: dict[str, list[tuple]] = {}
    for r in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    return Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")) for g in by.values())


def test_exact_stage(spark, docs):
    want = _first_rows(_rows())
    assert Counter(map(tuple, corpus_pipeline.deduplicated(spark, docs, "").collect())) == want
    for budget in (1, 1 << 12):
        got = exact_dedup.distinct_rows(docs.repartition(5), budget=budget)
        assert Counter(map(tuple, got.collect())) == want and got.columns == docs.columns


def _components(rows: list[tuple], similarity: float) -> dict[int, int]:
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for (r, a), (s, b) in combinations([(r, x) for r, x in zip(rows, sets) if r[0] is not None and x], 2):
        if len(a & b) >= similarity * len(a | b):
            x, y = find(r[0]), find(s[0])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_stage(spark, docs):
    rows = _rows()
    least = _components(rows, 0.8)
    assert 15 < sum(i != c for i, c in least.items()) < len(rows) - 20
    got = corpus_pipeline.near_deduplicated(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[0] is None or least[r[0]] == r[0])


def test_near_groups_of_a_family_larger_than_a_shard(spark):
    rng = np.random.default_rng(31)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(300):
        w = list(base)
        w[int(rng.integers(0, 300))] = f"x{i}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(1000 + i, " ".join([*(f"u{x}" for x in rng.integers(0, 10**6, 60)), common])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["node"]: r["component"] for r in simhash.near_groups(df, shard_docs=20).collect()}
    assert got == dict.fromkeys(range(300), 0)


@pytest.mark.parametrize("pairs, shard_docs", [(400, 40), (400, 300), (150, 1000)])
def test_near_copies_behind_a_template(spark, pairs, shard_docs):
    """Documents that share most of their text with all others, and are near copies of one: the least hashes lie in what all share."""
    rng = np.random.default_rng(33)
    template = " ".join(f"t{i}" for i in range(300))
    rows = []
    for i in range(pairs):
        own = [f"o{i}x{j}" for j in range(100)]
        for c in (0, 1):
            own = own if c == 0 else [f"changed{i}" if j == 50 else w for j, w in enumerate(own)]
            rows.append((i + c * 10_000, template + " " + " ".join(own)))
    # Of the template alone, with a word or two of their own; these are one family.
    rows += [(20_000 + i, template.replace(f"t{int(rng.integers(0, 300))} ", f"z{i} ")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["node"]: r["component"] for r in simhash.near_groups(df, shard_docs=shard_docs).collect()}
    assert got == {i + c * 10_000: i for i in range(pairs) for c in (0, 1)} | dict.fromkeys(range(20_000, 20_060), 20_000)


@pytest.mark.parametrize("keys, reach, shard_docs", [(1, 0, 7), (1, 0, 1000), (5, 18, 20)])
def test_near_groups_find_every_link(spark, keys, reach, shard_docs):
    """Whatever the first pass finds, the result is that of all pairs."""
    rng = np.random.default_rng(35)
    rows = [(r[0], r[1]) for r in _rows()]
    common = " ".join(f"c{i}" for i in range(40))
    for i in range(40):  # families behind a passage, some of their members beyond the bound
        own = [f"o{i}x{j}" for j in range(60)]
        for c in range(3):
            own = [f"n{c}" if rng.random() < 0.02 * c else w for w in own]
            rows.append((10_000 + 100 * i + c, common + " " + " ".join(own)))
    want = _components([(*r, None) for r in rows], 0.8)
    linked = {c for i, c in want.items() if i != c}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["node"]: r["component"] for r in simhash.near_groups(df, keys=keys, reach=reach, shard_docs=shard_docs).collect()}
    assert got == {i: c for i, c in want.items() if c in linked} and len(linked) > 25


def test_near_groups_link_what_fingerprints_miss(spark):
    """Pairs of a similarity of 0.8 whose fingerprints lie beyond the search's reach, or that share no least hash."""
    rng = np.random.default_rng(36)
    rows = []
    for i in range(20_000):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 13)]
        a, b = " ".join(w), " ".join([*w[:-1], "changed"])
        far = (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > simhash.REACH
        apart = not set(simhash.shingle_set(a, 5)[: simhash.KEYS]) & set(simhash.shingle_set(b, 5)[: simhash.KEYS])
        if far or apart:
            rows += [(i, a), (i + 100_000, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["node"]: r["component"] for r in simhash.near_groups(df).collect()}
    assert len(rows) > 20 and got == {i: i % 100_000 for i, _ in rows}


def test_rare_keys_lose_no_pair(spark):
    """Sets of numbers with a common part of any share: every pair of the similarity has a key in common, or both are of the common part alone."""
    rng = np.random.default_rng(34)
    common = rng.choice(10**6, 100, replace=False)
    sets = []
    for share in (0, 20, 60, 79, 80, 81, 95, 100):
        for _ in range(12):
            base = np.concatenate([rng.choice(common, share, replace=False), rng.integers(10**6, 2 * 10**6, 100 - share)])
            for gone in (0, 5, 11):
                sets.append(np.unique(np.concatenate([base[gone:], rng.integers(2 * 10**6, 3 * 10**6, gone)])).astype("<u4"))
    df = spark.createDataFrame([(7, i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "key long, node long, grams binary")
    keys, rest = simhash._rare_keys(df, 0.8, 20)
    by: dict[int, set[int]] = {}
    for r in keys.collect():
        by.setdefault(r["node"], set()).add(r["key"])
    alone = {r["node"] for r in rest.collect()}
    sizes = Counter(k for ks in by.values() for k in ks)
    assert max(sizes.values()) <= 20 and 0 < len(alone) < len(sets)
    near = 0
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            near += 1
            assert by.get(i, set()) & by.get(j, set()) or {i, j} <= alone
    assert near > 150


def test_mix_stage(spark, docs):
    got = corpus_pipeline.mixed(spark, docs, "")
    taken = mixing.mix(docs).collect()
    assert got.columns == docs.columns
    times = Counter(map(tuple, got.collect()))
    assert sum(times.values()) == sum(r["copies"] for r in taken) and set(times) <= set(_rows())
    per: Counter = Counter()
    for r in taken:
        per[r["doc_id"], r["source"], r["size"]] += r["copies"]
    own: Counter = Counter()
    for r, n in times.items():
        own[r[0], r[3], len((r[1] or "").split())] += n
    assert own == Counter({k: n for k, n in per.items() if n})
    assert Counter(map(tuple, corpus_pipeline.mixed(spark, docs.repartition(7), "").collect())) == times


def test_mix_of_a_row_that_repeats_very_often(spark):
    df = spark.createDataFrame([(1, "a b", "x")] * 900 + [(2, "c d e", "x"), (3, "f", "y"), (None, None, "y")], "doc_id long, text string, source string")
    for partitions in (1, 6):
        got = Counter(map(tuple, mixing.mixed_documents(df.repartition(partitions)).collect()))
        want: Counter = Counter()
        for r in mixing.mix(df).collect():
            want[r["doc_id"]] += r["copies"]
        assert Counter({k[0]: n for k, n in got.items()}) == Counter({k: n for k, n in want.items() if n})


def test_run(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r[0] for r in _rows()}
