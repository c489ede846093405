"""The licence scan against a plain reimplementation, and lines that a first fit mistakes."""

from __future__ import annotations

import re
from math import exp

import pytest

from lumapair.llm import licenses

GERMAN = [f"Wir gehen {a} mit {b} und {c} nach Hause." for a in ("heute", "morgen", "immer", "nie") for b in ("dir", "ihm", "Freude", "den Kindern") for c in ("bald", "gern", "allein", "langsam")]
TEXTS = [
    (1, "Plain words here.\nReleased under the MIT License.\n\nThis library is long gone."),
    (2, None),
    (None, "Licensed under the Apache License, Version 2.0."),
    (4, ""),
    (5, "# This program is free software: you can redistribute it and/or modify\r\n# it under the terms of the GNU General Public License as published by\r# the Free Software Foundation."),
    (5, "All rights reserved.\n" + "word " * 20_000),
    (5, "All rights reserved.\n" + "word " * 20_000),
    (6, "\n".join(GERMAN)),
    (7, "mit mit mit\nMIT... license\nsoftware and the following conditions\nno part may be reproduced without written permission"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns, whose names are those of the operator's own columns."""
    return spark.createDataFrame([(*r, 1, "x", "y", [0.5]) for r in TEXTS], "doc_id long, text string, id long, line string, `a.b` string, p array<double>")


@pytest.fixture(scope="module")
def model(spark, docs):
    return licenses.train(spark, docs)


def _grams(text: str) -> list[str]:
    words = [w.rstrip(".") for w in re.split(r"[^a-z0-9.\-]+", text.lower())]
    words = [w for w in words if w]
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def _plain_scan(model: licenses.Classifier) -> list[tuple]:
    found = []
    for i, text in TEXTS:
        lines = re.split(r"\r\n|\n|\r", text) if text is not None else []
        for k, line in enumerate(lines):
            if not line.strip(" "):
                continue
            z = list(model.bias)
            for g in _grams(line):
                z = [a + b for a, b in zip(z, model.weights.get(g, [0.0] * len(z)))]
            odds = [exp(v - max(z)) for v in z]
            p = [v / sum(odds) for v in odds]
            if p[0] >= 0.5:
                continue
            top = max(p[1:])
            family = model.families[p.index(top)] if top in p[1:] and p[0] != top else model.families[1 + p[1:].index(top)]
            near = {*_grams(line), *_grams("\n".join(lines[max(0, k - licenses.AROUND) : k + licenses.AROUND + 1]))}
            similarity = max(len(near & set(_grams(t))) / len(_grams(t)) for t in licenses.TEMPLATES[family])
            known = top >= model.threshold
            found.append((i, k, family if known else licenses.UNKNOWN, round(top, 9), round(similarity, 9), known and similarity >= licenses.CONFIRMED, line))
    return sorted(found, key=str)


def test_scan_against_plain_python(docs, model):
    got = sorted([(*r[:3], round(r[3], 9), round(r[4], 9), *r[5:]) for r in map(tuple, licenses.scan(docs, model).collect())], key=str)
    assert got == _plain_scan(model)
    assert {r[2] for r in got if r[5]} >= {"apache", "gpl", "mit"}


def test_lines_that_a_fit_mistakes_are_learned(docs, model):
    """The German word that is spelled like a licence's name."""
    assert "mit" not in {r["family"] for r in licenses.scan(docs.where("doc_id = 6"), model).collect()}
    assert [r["family"] for r in licenses.scan(docs.where("doc_id = 1"), model).collect()].count("mit") == 1
    assert model.held_out["right"] >= 0.6 and model.held_out["false"] == 0


def test_no_rows(spark, docs):
    empty = docs.where("false")
    assert licenses.scan(empty, licenses.train(spark, empty)).count() == 0
