from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lumapair.llm import exact_dedup, language, licenses, mixing, packing, pages, sharding, simhash, vectors, viterbi
from lumapair.llm.tokens import IdCache

DOCS = "doc_id long, text string, lang string, source string, id long, size string, place string"
ROWS = [
    (1, "The quick brown fox, jumps over the lazy dog.", "en", "a", 0, "x", "y"),
    (2, "The quick  brown fox, jumps over the\nlazy dog.", "en", "a", 0, "x", "y"),
    (3, None, None, None, 0, "x", "y"),
    (4, "", "en", "b", 0, "x", "y"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "b", 0, "x", "y"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "b", 0, "x", "y"),
    (6, "word " * 6000, "en", "c", 0, "x", "y"),
    (7, "漢字 <|endoftext|> It's 42!", None, "c", 0, "x", "y"),
    (8, "123 !!!", "en", None, 0, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    model = language.train(empty, F.lit(True))
    assert language.predict(empty, model).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert viterbi.token_counts(empty, [("▁", -1.0)]).count() == 0
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language(docs):
    model = language.train(docs, F.lit(True))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[5]["lang_pred"] == "de"
    assert [got[i]["lang_pred"] for i in (3, 4, 8)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert model.infer("漢漢漢漢")[1] < 1 and model.infer("«—»")[0] == "und" and model.infer("ª")[0] != "und"
    both = model.infer(ROWS[0][1] * 8 + ROWS[4][1] * 8)
    assert set(both[2]) == {"en", "de"} and sum(both[2].values()) == pytest.approx(1)


def test_exact_dedup_with_spills(docs):
    for budget in (1 << 20, 1):
        got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, budget=budget).collect()}
        assert {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, True)} <= got


def _simhash(text: str | None, k: int) -> int:
    """By the definition, bit by bit."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_fingerprints_by_the_definition():
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(["A", "b\x0bc", "É", "d\te", "Zz"], rng.integers(0, 40))) for _ in range(40)] + [None, "", "  ", "one TWO", "word " * 70_000]
    for t in texts:
        for k in (3, 5):
            assert simhash.fingerprint(t, k) == _simhash(t, k)


def test_simhash_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocabulary, 300)) for _ in range(12)]
    for t in list(texts):
        for at in (5, 90):
            w = t.split(" ")
            w[at] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [_simhash(t, 3) for t in texts]
    root = list(range(len(fps)))
    for _ in fps:
        for i, j in combinations(range(len(fps)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[i] = root[j] = min(root[i], root[j])
    assert len(set(root)) < len(root) - 10
    for split_rows, shard_rows in ((4000, 64), (2, 64), (4000, 0)):  # the last takes the most blocks
        monkeypatch.setattr(simhash.block_masks, "__defaults__", (shard_rows,))
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df, split_rows=split_rows).collect()}
        assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(fps))}


def test_minimax_cuts_against_dynamic_programming(spark):
    rng = np.random.default_rng(4)
    for n, shards, bits, most in ((30, 4, 2, 8), (200, 7, 3, 16), (3, 5, 2, 8)):
        keys = np.sort(rng.integers(-(2**62), 2**62, n))
        sizes = rng.integers(1, 100, n)
        df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes)], "key long, bytes long")
        capacity, firsts = sharding.minimax_cuts(df, shards, bits, most)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        best = ends.astype(float)
        for _ in range(shards - 1):
            best = np.array([min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(n + 1)])
        assert capacity == best[n]
        shard = np.searchsorted(firsts, keys, "right")
        got = [sizes[shard == s].sum() for s in range(shards)]
        if n > 20 * shards:
            assert max(got) - min(got) <= 3 * sizes.max()
        assert max(sizes[shard == s].sum() for s in set(shard.tolist())) == capacity


def test_shards_keep_groups_and_number_slots(docs):
    rows = sharding.shard_documents(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["shard"] == by[4]["shard"] and by[3]["size"] == 16 and by[5]["text_crc32"] == zlib.crc32(ROWS[4][1].encode())


def test_mix_targets_and_copies(spark, docs):
    rows = spark.createDataFrame([(i, "w " * (i % 7 + 1), "abcd"[min(i % 10, 3)]) for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(rows).collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    target = {r["source"]: r["target"] for r in got}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    # reshare step by step
    w, want, left = dict(zip("abcd", (1, 2, 3, 1))), dict.fromkeys("abcd", 0.0), float(sum(size.values()))
    open_ = set("abcd")
    while left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            want[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if want[s] > 3 * size[s]:
                left += want[s] - 3 * size[s]
                want[s] = 3.0 * size[s]
                open_.remove(s)
    assert target == pytest.approx(want)
    for s in "abcd":
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 21
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix(rows).collect())) == sorted(map(tuple, got))
    assert mixing.mixed_documents(rows).count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs).count() == len(ROWS)


def test_token_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), IdCache(path)
    texts = [r[1] or "" for r in ROWS] + ["ÀÉ ñandú's don't I'LL x²½   é İ ΣΑΣ a\tb\x0bc <|endoftext|>x", "ſ K"]
    for t, ids in zip(texts, own.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing(docs):
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert Counter(r["doc_id"] for r in rows)[5] == 2
    whole = {i: np.frombuffer(IdCache(public_tokenizers.path("word_bpe_49k.json")).ids([t or ""])[0], "<u4").tolist() + [1] for i, t, *_ in ROWS}
    for r in rows:
        own = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    assert len(rows) == sum(-(-len(whole[r[0]]) // 4096) for r in ROWS)
    lengths = np.sort(np.random.default_rng(5).integers(1, 4097, 3000))[::-1]
    b, _, gaps = packing.sum_of_squares(lengths)
    assert len(gaps) <= -(-int(lengths.sum()) // 4096) * 1.05 and np.bincount(b, lengths).max() <= 4096


def test_sum_of_squares_by_the_definition():
    rng = np.random.default_rng(15)
    for _ in range(60):
        capacity = int(rng.integers(3, 12))
        lengths = rng.integers(1, capacity + 1, 30)
        bins, offsets, gaps = packing.sum_of_squares(lengths, capacity)
        open_: list[int] = []
        for n, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):

            def after(k: int) -> int:
                left = [g - n if i == k else g for i, g in enumerate([*open_, capacity])]
                left = left if k == len(open_) else left[:-1]
                return sum(c * c for g, c in Counter(left).items() if 0 < g)

            best = min([after(k) for k, g in enumerate(open_) if g >= n] + [after(len(open_))])
            assert at == capacity - (open_[b] if b < len(open_) else capacity)
            assert after(b) == best
            if b == len(open_):
                open_.append(capacity)
            open_[b] -= n
        assert open_ == gaps.tolist()


def test_sum_of_squares_while_a_length_to_come_fits():
    rng = np.random.default_rng(16)
    for _ in range(60):
        capacity = int(rng.integers(4, 14))
        lengths = np.sort(rng.integers(2, capacity + 1, 30))[::-1]
        bins, offsets, gaps = packing.sum_of_squares(lengths, capacity, True)
        open_: list[int] = []
        for i, (n, b, at) in enumerate(zip(lengths.tolist(), bins.tolist(), offsets.tolist())):
            least = lengths[i + 1 :].min() if i + 1 < len(lengths) else capacity + 1

            def squares(left: list[int]) -> dict[int, int]:
                return {g: c * c for g, c in Counter(left).items()}

            def change(k: int) -> int:
                """Of the two gaps that a placing changes, those that stay open count."""
                gap = open_[k] if k < len(open_) else capacity
                before, after = squares(open_), squares([g - n if j == k else g for j, g in enumerate([*open_, *([capacity] if k == len(open_) else [])])])
                out = after.get(gap, 0) - before.get(gap, 0) if k < len(open_) else 0
                return out + (after[gap - n] - before.get(gap - n, 0) if gap - n >= least else 0)

            assert at == capacity - (open_[b] if b < len(open_) else capacity)
            assert change(b) == min([change(k) for k, g in enumerate(open_) if g >= n] + [change(len(open_))])
            if b == len(open_):
                open_.append(capacity)
            open_[b] -= n
        assert open_ == gaps.tolist() and min(gaps) >= 0
    wide = np.sort(np.random.default_rng(0).integers(100, 4001, 6000))[::-1]
    assert len(packing.sum_of_squares(wide, 4096, True)[2]) < 3040 < len(packing.sum_of_squares(wide, 4096)[2])


def test_even_cuts_against_all_partitions():
    rng = np.random.default_rng(17)
    for _ in range(200):
        n, shards = int(rng.integers(1, 11)), int(rng.integers(1, 6))
        sums = rng.integers(1, 20, n)
        capacity = sharding.smallest_capacity(sums, shards)
        ways = [[sums[a:b].sum() for a, b in zip((0, *cut), (*cut, n))] for cut in combinations(range(1, n), shards - 1)]
        fitting = [w for w in ways if max(w) <= capacity]
        cuts = sharding.even_cuts(sums, capacity, shards)
        if not fitting:
            assert cuts is None
            continue
        got = [sums[a:b].sum() for a, b in zip((0, *cuts[:-1]), cuts)]
        assert cuts[-1] == n and max(got) <= capacity and min(got) == max(min(w) for w in fitting)


def test_packing_ends_when_no_sequence_closes(spark):
    for rows in ([(i, 0, 0, 3000, 7) for i in range(300)], [(1, 0, 0, 3000, 7)] * 300):
        pieces = vectors.materialize(spark.createDataFrame(rows, packing._PIECE), "pieces")
        got = packing.pack(pieces, group_pieces=20).collect()
        assert len(got) == 300 and len({r["sequence_id"] for r in got}) == 300
        assert len({r["sequence_id"] >> 24 for r in got}) > 5


def test_viterbi_against_the_library():
    from tokenizers import Tokenizer, models

    real = viterbi.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tied = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("aba", -3.0)]
    odd = [("▁", -2.5), ("a", -1.25), ("b▁a", -0.1), ("ba", -1.3)]
    for vocabulary in (real, tied, odd):
        t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0)) if vocabulary is real else Tokenizer(models.Unigram([("<unk>", min(s for _, s in vocabulary)), *vocabulary], unk_id=0))
        c = viterbi.Counter(vocabulary)
        for text in ("abab ab  aba b", "", " ", "ab\ncd 漢字 x", "The and attion to thanedble the, anea."):
            want = len(t.encode(viterbi.normalised(text)).ids) if text else 0
            assert c.count(text) == want, (text, vocabulary[:3])


def test_pages(spark):
    nav = "Home News Sport Weather Travel Culture Money Future Earth"
    html = "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav>{n}</nav><div class='cookie-notice'>We use cookies</div><article><h1>Hi</h1><p>A &amp;  b<p><b>c<br>d</b></p></article><div id=comments>bad</div><footer>f"
    plain = "<body><div>{n}</div><div>{own}</div>"
    rows = [(1, "http://h/1", html.format(n=nav)), (2, "http://h/2", plain.format(n=nav, own="only here")), (3, "http://h/3", plain.format(n=nav, own="another one")), (4, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part_bytes in (1 << 20, 1):
        got = {r["page_id"]: r["text"] for r in pages.main_texts(df, part_bytes=part_bytes).collect()}
        assert got == {1: "Hi\nA & b\nc\nd", 2: "only here", 3: "another one", 4: ""}


def test_pages_of_a_split_host_lose_the_same_runs(spark):
    menu = "".join(f"<div>item{i}</div>" for i in range(12))
    chrome = "<nav>a long line of nine words that also repeats elsewhere</nav>"
    rows = [(i, "http://h/", f"<body>{menu}<div>own{i} text{i}</div>") for i in range(9)]
    rows += [(20, "http://h/", chrome + "<article>x</article>"), (21, "http://h/", "<body><div>a long line of nine words that also repeats elsewhere</div><div>own21</div>")]
    rows += [(None, "http://h/", f"<body>{menu}<div>alone</div>"), (30, "http://i/", f"<body>{menu}"), (30, "http://i/", f"<body>{menu}")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    items = "\n".join(f"item{i}" for i in range(12))
    want = Counter([(i, f"own{i} text{i}") for i in range(9)] + [(20, "x"), (21, "own21"), (None, "alone"), (30, items), (30, items)])
    for part_bytes in (1 << 20, 100, 1):
        assert Counter((r["page_id"], r["text"]) for r in pages.main_texts(df, part_bytes=part_bytes).collect()) == want


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(6)
    tokens, page = rng.integers(0, 3, 120), np.repeat(np.arange(6), 20)
    want = np.zeros(120, bool)
    windows: dict[tuple, set] = {}
    at = [(i, tuple(tokens[i : i + 5])) for i in range(116) if page[i] == page[i + 4]]
    for i, w in at:
        windows.setdefault(w, set()).add(page[i])
    for i, w in at:
        if len(windows[w]) > 1:
            want[i : i + 5] = True
    assert (pages.covered_by(pages.run_pages(tokens, page, 5) > 1, 5) == want).all()
    assert max(pages.run_pages(tokens, page, 5)) == max(len(v) for v in windows.values())


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([c + rng.normal(size=(rng.integers(1, 25), 16)) * 0.12 for c in centres] + [np.tile(centres[0], (30, 1))])
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(len(x) + i, b) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = vectors.near_vectors(df)
    got = {r["vec_id"]: r for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    mine = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum()
    assert all(got[len(x) + i]["n_links"] == 0 and got[len(x) + i]["kept"] for i in range(len(bad)))
    assert vectors.audit(df, out) >= 0.9


def test_vectors_of_a_group_larger_than_a_shard(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=64) + rng.normal(size=(5000, 64)) * 0.17
    x = np.concatenate((x, rng.normal(size=(1000, 64))))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert links[:5000].min() > 4900
    out = vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: r for r in out.collect()}
    assert [got[i]["n_links"] for i in range(6000)] == links.tolist()
    assert {got[i]["component_id"] for i in range(5000)} == {0}


def test_vectors_linked_through_a_larger_id_are_one_component(spark):
    turn = [(2, 0.0), (3, 0.4), (1, 0.8)]
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in turn], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 2, 1)}


def test_a_search_meets_all_of_a_tight_group():
    rng = np.random.default_rng(16)
    for shape in (0.0, 1.0):
        spread = 0.02 + 0.2 * rng.random(230)[:, None] ** 3 * shape
        x = vectors.unit(np.concatenate((rng.normal(size=64) + rng.normal(size=(230, 64)) * spread, rng.normal(size=(300, 64)))))
        g = vectors.Graph.of(x, vectors.both_ways(vectors.build_graph(x).lists))
        met = g.search(x, within=0.8) >= 0.9
        assert (met == (x @ x.T >= 0.9)).mean() > 0.9999 and met[:230, :230].all()


def test_shards_drop_no_vector(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(3000, 8))
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(vectors.unit(x))], "node long, v binary")
    for task_rows, sample, levels in ((10, 40, 6), (10, 40, 1), (20_000, 1 << 20, 6)):
        monkeypatch.setattr(vectors, "TASK_ROWS", task_rows)
        monkeypatch.setattr(vectors, "SAMPLE_BYTES", sample * 64)
        monkeypatch.setattr(vectors, "LEVELS", levels)
        rows = vectors.shards(nodes, 20, 60).select("node", "shard", "rank").collect()
        homes = Counter(r["node"] for r in rows if r["rank"] == 0)
        assert len(homes) == 3000 and set(homes.values()) == {1}
        assert len({(r["node"], r["shard"]) for r in rows}) == len(rows)
        assert max(Counter(r["shard"] for r in rows if r["rank"] == 0).values()) <= 120


def test_vectors_of_every_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [0.0, 1.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)}


def test_licences(spark, docs):
    rows = spark.createDataFrame([(1, "Plain words here.\nReleased under the MIT License."), (2, None), (3, "mit der die das und nicht"), (4, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    model = licenses.train(spark, rows)
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in licenses.scan(rows, model).collect()}
    assert got[1, 1] == ("mit", True) and got[4, 0] == ("apache", True) and (1, 0) not in got and not got.get((3, 0), ("", False))[1]


def test_a_wrapped_notice_is_confirmed_with_its_neighbours(spark):
    notice = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation."
    rows = spark.createDataFrame([(1, f"Some file.\n# {notice}\nint x;"), (None, "Released under the MIT License."), (3, "\n \n"), (4, None)], "doc_id long, text string")
    model = licenses.train(spark, rows)
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in licenses.scan(rows, model).collect()}
    assert got[1, 2] == ("gpl", True) and got[None, 0] == ("mit", True) and not {k for k in got if k[0] in (3, 4)}
    assert model.held_out["right"] >= 0.6 and licenses.scan(rows.limit(0), model).count() == 0


def test_paragraphs_know_the_lines_around_them(spark):
    text = "a\n\nb\r\nc\rd\ne"
    lines = ["a", "", "b", "c", "d", "e"]
    rows = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    for pattern in (None, "[bd]"):
        got = {tuple(r) for r in licenses.paragraphs(rows, "doc_id", "text", pattern).collect()}
        assert got == {(1, i, t, "\n".join(lines[max(0, i - 2) : i + 3])) for i, t in enumerate(lines) if t and (pattern is None or t in "bd")}


def test_calibration_on_held_out_rows():
    model = licenses.Classifier(["none", "x", "y"], [0.0, 0.0, 0.0], {"g": [0.0, 2.0, 1.0]}, 0.5)
    p = np.array([[0.9, 0.05, 0.05], [0.2, 0.7, 0.1], [0.1, 0.6, 0.3], [0.05, 0.15, 0.8]])
    found = licenses.calibrated(model, ["none", "none", "x", "y"], p)
    t = found.held_out["temperature"]
    assert found.weights["g"] == [0.0, 2.0 / t, 1.0 / t]
    q = p ** (1 / t) / (p ** (1 / t)).sum(axis=1, keepdims=True)
    assert found.threshold == pytest.approx(min(0.9, max(0.5, q[1, 1]))) and found.held_out["false"] == 0.5 * (q[1, 1] > 0.9)


def test_licence_scan_loses_nothing_to_its_first_filter(spark, docs, monkeypatch):
    rows = spark.createDataFrame([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(-1, "the ... apache\nUNDER the... Apache 2.0"), (-2, "x.mit mit. MIT-like -mit")] + [(-10 - i, "\n".join([*t, *(x[: len(x) // 2] for x in t)])) for i, t in enumerate(licenses.TEMPLATES.values())], "doc_id long, text string")
    model = licenses.train(spark, rows)
    needed = licenses.telling(model)
    assert needed and len(needed) < len(model.weights)
    found = set(map(str, licenses.scan(rows, model).collect()))
    monkeypatch.setattr(licenses, "telling", lambda _: None)
    assert found and not found ^ set(map(str, licenses.scan(rows, model).collect()))
