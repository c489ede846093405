"""Token ids of words that a worker knows already."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumapair.llm import tokens


class _Counting:
    def __init__(self, inner) -> None:
        self.inner, self.words = inner, []

    def encode_batch_fast(self, texts: list[str], **options):
        self.words += [w for t in texts for w in t.split()]
        return self.inner.encode_batch_fast(texts, **options)


def test_known_words_are_not_encoded_again():
    cache = tokens.IdCache(public_tokenizers.path("word_bpe_49k.json"))
    cache.bare = _Counting(cache.bare)
    cache.ids(["alpha beta, gamma 7"])
    assert sorted(cache.bare.words) == [",", "7", "alpha", "beta", "gamma"]
    cache.bare.words.clear()
    cache.ids(["Alpha,beta7 (gamma"])
    assert cache.bare.words == ["("]


def test_ids_of_any_chunks_in_blocks_of_any_size(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), np.random.default_rng(50)
    parts = ["don't", "I'LL", "'s's", "x²½", "ÀÉÞß", "×÷", "é", "é", "İ", "ΣΑΣ", "<|endoftext|>", "<|", "12,345.67", "a_b-c", "\x00", " ", "漢字", "...", "ſ", "word", "$&", "\\1"]
    texts = ["".join(p + ["", " ", "\t", " "][k] for p, k in zip(rng.choice(parts, 12).tolist(), rng.integers(0, 4, 12).tolist())) for _ in range(300)] + ["", " ", None]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for block, most in ((1, 3), (500, 20), (1 << 20, 50_000)):
        monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
        monkeypatch.setattr(tokens, "MOST_WORDS", most)
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.IdCache(path).each(texts)] == want
