from __future__ import annotations

import re
from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumapair.llm import negatives, urls, whitening

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Names like those of helper columns, and one with a dot.
CLASHING = "_id string, host string, rule string, uid string, x string, d string, n string, `a.b` string"
EXTRA = ("e",) * 8

URLS = [
    "http://a.example.NET/en/1", "http://example.net/EN/1", "https://net", "https://net/", "https://planet/x", "https://x.org/fr/", "https://x.org:80/fr/", "http://Example.COM/de/1?q=porn",
    "http://porn.example.com/", "http://pornography.example.com/", "http://a.com/free/bets", "http://a.com/free-free", "http://a.com/x#://net/", "no scheme", "", None, "http://a.com/Casino",
    "x://y://net/", "http://a.com?://b.net/", "http://a.com/" + "free_win/" * 20_000, "http://a.com/äporn", "http://.net/", "http://a..net/", "HTTP://net/\nporn",
]


def judged_plainly(url: str | None) -> tuple:
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    text = re.sub("[A-Z]", lambda m: m[0].lower(), host + path)
    hits = sorted(t for t in urls.VOCABULARY if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", text))
    weight = sum(urls.VOCABULARY[t] for t in hits)
    rule, verdict = max(fit)[1:] if fit else (None, "block" if any(t in urls.STRICT for t in hits) or len(hits) > 1 else "allow")
    return host, path, rule, verdict, hits, weight


@pytest.mark.parametrize("as_table", [False, True])
def test_urls(spark, as_table):
    rows = [(i, u, *EXTRA) for i, u in enumerate(URLS)] + [(None, URLS[0], *EXTRA), (0, URLS[0], *EXTRA)]
    pages = spark.createDataFrame(rows, "page_id long, url string, " + CLASHING)
    rules = spark.createDataFrame(RULES + RULES[:1], "verdict string, host string, path string") if as_table else RULES
    got = urls.judge(pages, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "hits", "weight"]
    want = [(r[0], *judged_plainly(r[1])) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_urls_without_rules_terms_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://porn.example.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [urls.judge(pages, r).first()["verdict"] for r in ([], none)] == ["block"] * 2
    assert urls.judge(pages, [], {}).first()["verdict"] == "allow"
    for r in (RULES, none):
        assert urls.judge(pages.where("page_id > 1"), r).count() == 0
    both = [("allow", "example.net", "/"), ("block", "example.net", "/"), ("allow", "net", "/")]
    for r in (both, spark.createDataFrame(both, none.schema)):
        assert urls.judge(pages, r).first()["rule"] == "example.net/" and urls.judge(pages, r).first()["verdict"] == "block"


def whitened_plainly(c: np.ndarray, k: int):
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit - s[0] // n) - (s - n * (s[0] // n)) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return n, np.square(n * x - s).sum(axis=1), (x - s / n) @ axes / np.sqrt(e), e / np.trace(v), e, axes


@pytest.mark.parametrize("width, tile", [(3, 32), (40, 7), (70, 32)])
def test_whitening_equals_numpy(spark, width, tile):
    rng = np.random.default_rng(width)
    c = (rng.normal(size=(300, width)) * np.linspace(0.3, 2, width)).astype(np.float32)
    c[50:150] = c[0]  # a third of the rows are copies
    rows = spark.createDataFrame([(i, v.tolist(), *EXTRA) for i, v in enumerate(c)], "vec_id long, embedding array<float>, " + CLASHING)
    got = whitening.whiten(rows, tile=tile).toPandas().sort_values(["vec_id", "component"])
    k = min(16, width)
    n, deviation, z, explained, *_ = whitened_plainly(c.astype(float), k)
    assert n == 200 and set(got["n"]) == {n} and got["component"].tolist() == list(range(1, k + 1)) * 300
    assert got["deviation"].tolist() == np.repeat(deviation, k).tolist()
    own = got["whitened"].to_numpy().reshape(-1, k)
    assert np.abs(own * np.sign((own * z).sum(axis=0)) - z).max() < 1e-7
    assert np.allclose(got["explained"].to_numpy()[:k], explained, rtol=1e-9) and got["identity_error"].max() < 1e-8


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 3.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [5.0, 0.0, 2.0]), (8, [1e30, 0.0, -1e30])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).toPandas()
    assert sorted(got.loc[got["vec_id"] == 1, "component"]) == [1, 1, 2, 2] and got["vec_id"].isna().sum() == 2
    assert set(got["vec_id"].dropna()) == {1.0, 7.0, 8.0}
    two = got[got["vec_id"].isna() | (got["vec_id"] == 1)]
    assert set(two["n"]) == {2} and set(two["deviation"]) == {64**2 + 128**2}
    # Two distinct vectors lie on one line: the second component has no variance.
    assert set(np.abs(two["whitened"]).round(9)) == {0.0, 1.0} and two["identity_error"].max() < 1e-9
    assert got.loc[got["vec_id"] == 8, "deviation"].isna().all()
    same = whitening.whiten(spark.createDataFrame(rows[:2], schema)).toPandas()
    assert set(same["whitened"]) == {0.0} and set(same["explained"]) == {0.0} and set(same["deviation"]) == {0}
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0


def test_whitening_in_small_blocks(spark):
    """Row blocks of a few rows, and tile sums that are passed on at once, give the same matrix."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=(500, 10)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<float>")
    fit = whitening.distinct_vectors(rows, F.col("embedding")).persist()
    totals = whitening.sums(fit)
    products = whitening.tile_products(whitening.column_blocks(fit, totals, 4, 8 * 10 * 7), 4, 1)
    assert products.count() > 6
    v = {(r["i"], r["k"]): np.frombuffer(r["m"]) for r in whitening.tile_sums(products).collect()}
    assert sorted(v) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    x = np.floor(64 * c.astype(float)) - np.floor(64 * c.astype(float)).mean(axis=0)
    assert np.allclose(v[0, 2], (x.T @ x)[:4, 8:].ravel(), rtol=1e-9)
    fit.unpersist()


def mined_plainly(rows: list[tuple], anchor) -> list[tuple]:
    """rows: (id, vector, label); every pair is scored."""
    own = [(i, np.floor(256 * np.array(v, float)).astype(np.int64), lab) for i, v, lab in rows if lab is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for at, (i, v, lab) in enumerate(own):
        if i is None or not anchor(i):
            continue
        scored = [(int(v @ w), j, other, k) for k, (j, w, other) in enumerate(own) if k != at and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for score, j, _, _ in [s for s in scored if s[2] == lab][:5]:
            fits = [s for s in scored if s[2] != lab and 80 * score <= 100 * s[0] <= 100 * score][:5]
            out += [(i, j, r, s[1], score, s[0]) for r, s in enumerate(fits, 1)]
    return out


def grouped_vectors() -> list[tuple]:
    """Groups of near copies, exact copies under several labels, norms that differ, and plain noise."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    x = np.concatenate([rng.normal(size=(150, 8)), *[c + rng.normal(size=(60, 8)) * 0.02 for c in centres], np.repeat(rng.normal(size=(1, 8)), 60, axis=0)])
    x[::9] *= 3
    return [(int(i), v.tolist(), int(i * 7 % 3)) for i, v in zip(rng.permutation(len(x)), x.astype(np.float32))]


@pytest.mark.parametrize("shard_rows, leaf_rows, block", [(2048, 48, 50_000), (50, 4, 7), (7, 2, 3)])
def test_negatives_equal_all_pairs(spark, shard_rows, leaf_rows, block):
    rows = grouped_vectors()
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], "vec_id long, embedding array<float>, label int, " + CLASHING).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, leaf_rows=leaf_rows, block_anchors=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined_plainly(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)


def test_negatives_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    rows = [
        (100, [1.0, 0.5], "a"), (100, [1.0, 0.5], "a"), (1, [1.0, 0.25], "a"), (None, [1.0, 0.25], "b"), (2, [1.0, 0.25], "b"), (3, [1.0, 0.25], None), (4, None, "b"), (5, [], "b"), (6, [nan, 1.0], "b"),
        (7, [None, 1.0], "b"), (8, [inf, 1.0], "b"), (9, [1.0, 0.25, 0.0], "b"), (200, [-1.0, 0.0], "b"), (300, [0.0, 0.0], "c"), (10, [0.0, 0.0], "c"), (11, [1e30, 1e30], "z"), (400, [3.0, 1.0, 1.0], "q"),
    ]
    got = [tuple(r) for r in negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect()]
    plain = [r if r[0] != 11 else (11, [65536.0, 65536.0], "z") for r in rows]  # the largest that counts, 2^24 / 256
    assert sorted(got, key=repr) == sorted(mined_plainly(plain, lambda i: i % 100 == 0), key=repr)
    assert (100, 1, 2, None) in {g[:4] for g in got}
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame(rows, schema), F.lit(False)).count() == 0


def test_vantage_tree_passes_over_what_cannot_count():
    """In a shard of tight groups, a search with a narrow window scores few of the rows."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(128, 16)) * 0.01 for _ in range(16)])).astype(np.int32)
    tree = negatives.Tree(x, np.zeros(len(x), np.int64), np.arange(len(x)), np.arange(len(x)), 16).ready()
    seen = []
    plain = tree.scores
    tree.scores = lambda rows, q: (seen.append(rows.stop - rows.start), plain(rows, q))[1]
    whole = x[5].astype(np.int64)
    q = negatives.Anchor(-1, -1, 1, whole, [negatives.Window_(0.8 * int(whole @ whole), int(whole @ whole), (None, None))])
    tree.search(q, False, 5)
    scores = x.astype(np.int64) @ whole
    inside = [(-s, i, i) for i, s in enumerate(scores.tolist()) if 0.8 * int(whole @ whole) <= s <= int(whole @ whole)]
    assert q.best[0] == sorted(inside)[:5] and sum(seen) < len(x) / 4
