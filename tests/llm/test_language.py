"""Language mixtures against a literal reimplementation that tries every set of languages."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumapair.llm import language

SYLLABLES = {"aa": "ka ri to men su", "bb": "schu gen ver ich aus", "cc": "eau que ri ment ou", "dd": "da to ver ña os"}


def _text(rng: np.random.Generator, lang: str, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang].split(), rng.integers(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(3)
    rows = [(100 * k + i, _text(rng, lang, 40), lang) for k, lang in enumerate(SYLLABLES) for i in range(12)]
    return [*rows, (None, "no id", "ee"), (900, None, "ee"), (901, "no language", None), (902, "", "ff")]


def _literal_model(rows) -> dict[str, list[float]]:
    size = 1 << language.BUCKET_BITS
    counts: dict[str, Counter] = {}
    for i, text, lang in rows:
        if None not in (i, text, lang):
            counts.setdefault(lang, Counter()).update(language.ngram_buckets(text).tolist())
    own = {lang: [c[b] / sum(c.values()) for b in range(size)] for lang, c in counts.items() if c}
    common = [sum(p[b] for p in own.values()) / len(own) + 1 / size for b in range(size)]
    total = sum(common)
    return {lang: [(1 - language.SMOOTHING) * x + language.SMOOTHING * y / total for x, y in zip(p, common)] for lang, p in own.items()}


def _literal_fit(p: dict[str, list[float]], langs: tuple[str, ...], grams: Counter) -> tuple[dict[str, float], float]:
    n = sum(grams.values())
    shares = {lang: 1 / len(langs) for lang in langs}
    for _ in range(200):
        credit = dict.fromkeys(langs, 0.0)
        for g, c in grams.items():
            mixed = sum(shares[lang] * p[lang][g] for lang in langs)
            for lang in langs:
                credit[lang] += c * shares[lang] * p[lang][g] / mixed
        shares = {lang: x / n for lang, x in credit.items()}
    return shares, sum(c * log(sum(shares[lang] * p[lang][g] for lang in langs)) for g, c in grams.items())


@pytest.mark.parametrize("block", [64, 2, 1])
def test_mixtures_against_every_set(spark, labelled, monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    model = language.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"), F.lit(True))
    p = _literal_model(labelled)
    assert model.languages == sorted(p)
    rng = np.random.default_rng(4)
    texts = [_text(rng, lang, n) for lang in SYLLABLES for n in (2, 30)]
    texts += [_text(rng, a, 120) + " " + _text(rng, b, m) for a, b in combinations(SYLLABLES, 2) for m in (60, 120)]
    texts.append(" ".join(_text(rng, lang, 90) for lang in ("aa", "bb", "cc")))
    sizes = set()
    for text in texts:
        grams = Counter(language.ngram_buckets(text).tolist())
        n = sum(grams.values())
        toll = language.PENALTY * log(n + 1) / 2 + language.PENALTY_SHARE * n
        fits = {s: _literal_fit(p, s, grams) for k in (1, 2, 3, 4) for s in combinations(sorted(p), k)}
        best = max(fits, key=lambda s: fits[s][1] - toll * len(s))
        lang, score, shares = model.infer(text)
        assert set(shares) == set(best)
        assert shares == pytest.approx(fits[best][0], abs=0.01)
        assert lang == max(fits[best][0], key=fits[best][0].get) or abs(max(shares.values()) - shares[lang]) < 0.02
        one = {k: fits[k,][1] for k in p}
        top = max(one.values())
        assert score == pytest.approx(shares[lang] / sum(np.exp(max(v - top, -700)) for v in one.values()), abs=1e-6)
        sizes.add(len(best))
    assert sizes == {1, 2, 3}


def test_any_number_of_languages(spark):
    """More languages than a task holds at a time, none left out."""
    many = 405
    rows = [(i, f"{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)}{chr(0x4E02 + 3 * i)} " * 20, f"l{i:03}") for i in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert len(model.languages) == many
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()} == {i: lang for i, _, lang in rows}
    both = model.infer(rows[7][1] * 5 + rows[301][1] * 5)[2]
    assert set(both) == {"l007", "l301"}
