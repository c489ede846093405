"""Token counts, packing and vectors on rows with nulls, repeats, long texts and clashing columns, against plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumapair.llm import vectors, viterbi

OTHERS = "_id long, _text string, n_chars long, n_tokens string, `a.b` string"
TEXTS = [
    (1, "abab ab  aba b"), (2, None), (None, "ab aba"), (None, None), (4, ""), (5, "  "), (6, "ab\ncd 漢字 x"),
    (7, "aba abab " * 20_000), (7, "aba abab " * 20_000), (8, "▁a ▁"), (9, "漢漢漢 a漢b"), (10, "b" * 3000),
]
VOCABULARIES = {
    "ties": [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("aba", -3.0)],
    "pieces over words": [("▁", -2.5), ("a", -1.25), ("b▁a", -0.1), ("ba", -1.3)],
    "repeated and empty pieces": [("", -0.5), ("ab", -1.0), ("ab", -9.0), ("▁ab", -1.5)],
    "none": [],
}


def _plain_count(text: str | None, vocabulary: list[tuple[str, float]]) -> int:
    """Every piece that ends at a place is looked up, from the longest to a single character."""
    if not text:
        return 0
    scores: dict[str, float] = {}
    for piece, score in vocabulary:
        scores.setdefault(piece, score)
    longest = max(map(len, scores), default=0)
    unknown = min((s for _, s in vocabulary), default=0.0) - 10
    s = "▁" + text.replace(" ", "▁")
    ways = [(0.0, 0, False)]
    for end in range(1, len(s) + 1):
        tried = [(ways[at][0] + scores[s[at:end]], ways[at][1] + 1, False) for at in range(max(0, end - longest), end) if s[at:end] in scores]
        if s[end - 1] not in scores:
            score, n, odd = ways[-1]
            tried.append((score + unknown, n if odd else n + 1, True))
        ways.append(max(tried, key=lambda w: w[0]))
    return ways[-1][1]


@pytest.mark.parametrize("vocabulary", VOCABULARIES.values(), ids=VOCABULARIES)
def test_token_counts_against_plain_python(spark, vocabulary):
    docs = spark.createDataFrame([(*r, 1, "ab", 7, "x", "y") for r in TEXTS], f"doc_id long, text string, {OTHERS}").repartition(3)
    out = viterbi.token_counts(docs, vocabulary)
    assert out.columns == ["doc_id", "n_chars", "n_tokens"]
    plain = {t: _plain_count(t, vocabulary) for t in {t for _, t in TEXTS}}
    assert Counter(tuple(r) for r in out.collect()) == Counter((i, len(t or ""), plain[t]) for i, t in TEXTS)


def test_pack_stage(spark):
    texts = [*TEXTS, *((100 + k, f"number {k} of many " * (k * 7)) for k in range(40)), (139, "number 39 of many " * 273)]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in texts], "doc_id long, text string, g long, bin string, piece long, id long, `a.b` string")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    tokenizer, want = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        placed.sort()
        ends = np.cumsum([n for _, n in placed]).tolist()
        assert [at for at, _ in placed] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_vectors_with_clashing_columns_and_repeated_rows(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 12))
    x = np.concatenate([c + rng.normal(size=(12, 12)) * 0.1 for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[5].tolist()), (201, x[5].tolist()), (202, None), (203, [0.0] * 12), (204, [None] * 12), (205, [])]
    both = "vec_id long, embedding array<double>"
    clashing = spark.createDataFrame([(*r, 1, "x", 2.0, 3, "y", 4, True) for r in rows], f"{both}, node long, v string, a double, what int, `a.b` string, n_links long, kept boolean")
    got = {r["vec_id"]: tuple(r) for r in vectors.near_vectors(clashing).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i < 202]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.9
    ids, component = [i for i, _ in good], [i for i, _ in good]
    for _ in ids:
        component = [min(component[j] for j in np.flatnonzero(linked[k])) for k in range(len(ids))]
    assert [got[i] for i in ids] == [(i, int(linked[k].sum()) - 1, component[k], component[k] == i) for k, i in enumerate(ids)]
    assert all(got[i] == (i, 0, i, True) for i in (202, 203, 204, 205))
