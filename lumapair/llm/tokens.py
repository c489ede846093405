"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once while a worker remembers it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of each of the two generations that a worker remembers; the older one goes when the younger is full.
MOST_WORDS = 50_000
#: Bytes of text that are cut into chunks at once, about.
BLOCK_BYTES = 2 << 20
_LATIN = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
#: Composed letters and ASCII only: lower-casing and NFC change nothing but A-Z and À-Þ.
_PLAIN = r"\A[!-~À-ÖØ-öø-ÿ]+\z"


def _laid_out(each: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all, one after the other, and where each one's begin and how many they are."""
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    return np.frombuffer(b"".join(each), "<u4"), np.cumsum(size) - size, size


def _put_together(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of what `at` numbers, one after the other, and where each one's end, from 0."""
    n = size[at]
    ends = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])], ends


class IdCache:
    """Little-endian 32-bit ids of texts, as the tokenizer gives them without special tokens.

    The tokenizer drops white space between pre-tokens, so the ids of a text are
    those of its chunks between ASCII white space. That holds for the files with a
    `</w>` suffix and a pre-tokenizer that removes white space; others are refused.
    The chunks of a block of texts are numbered by Arrow, and the distinct ones are cut into words,
    which are numbered too, so that each distinct word is looked up once. The ids of words
    are put together with NumPy, to chunks and to texts. Chunks that Arrow cannot cut as
    the tokenizer does are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        if getattr(self.whole.model, "end_of_word_suffix", None) != "</w>":
            raise ValueError(f"{path}: white space is part of the tokens of this tokenizer")
        # The same model for pre-tokens that are already lower case and cut.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Words, and chunks encoded whole: the younger and the older generation.
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.others: list[dict[str, bytes]] = [{}, {}]

    @staticmethod
    @cache
    def of(path: str) -> IdCache:
        return IdCache(path)

    def _learn_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
        if len(ends) == len(words):
            raw = ids.tobytes()
            return [raw[x:y] for x, y in zip([0, *ends[:-1]], ends)]
        return self._learn_others(words)

    def _learn_others(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(chunks, add_special_tokens=False)]

    @staticmethod
    def _known(names: list[str], generations: list[dict[str, bytes]], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        young, old = generations
        out = list(map(young.get, names))
        missing = [i for i, v in enumerate(out) if v is None]
        if not missing:
            return out
        found = {c: v for c in [names[i] for i in missing] if (v := old.get(c)) is not None}
        if new := [c for i in missing if (c := names[i]) not in found]:
            found.update(zip(new, learn(new)))
        for i in missing:
            out[i] = found[names[i]]
        if len(young) + len(found) > MOST_WORDS:
            generations[:] = found, young
        else:
            young |= found
        return out

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other in any order, and where each one's begin and how many they are."""
        plain = pc.and_not(pc.match_substring_regex(chunks, _PLAIN), pc.match_substring(chunks, "<|"))
        words = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), _LATIN, r"\1 ")))
        numbered = words.flatten().dictionary_encode()
        each = self._known(numbered.dictionary.to_pylist(), self.words, self._learn_words)
        ids, ends = _put_together(*_laid_out(each), numbered.indices.to_numpy())
        at = ends[words.offsets.to_numpy()]
        others, begin, n = _laid_out(self._known(chunks.filter(pc.invert(plain)).to_pylist(), self.others, self._learn_others))
        start, size, own = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64), plain.to_numpy(zero_copy_only=False)
        start[own], size[own] = at[:-1], np.diff(at)
        start[~own], size[~own] = begin + len(ids), n
        return np.concatenate([ids, others]), start, size

    def _block(self, texts: pa.Array) -> list[bytes]:
        parts = pc.ascii_split_whitespace(texts)
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        numbered = parts.flatten().dictionary_encode()
        ids, ends = _put_together(*self._chunks(numbered.dictionary), numbered.indices.to_numpy())
        at = ends[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def each(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Ids of each text, a block of texts at a time; null counts as empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        ends = pc.cumulative_sum(pc.binary_length(texts)).to_numpy()
        begin = 0
        while begin < len(texts):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
            yield from self._block(texts.slice(begin, stop - begin))
            begin = stop

    def ids(self, texts: pa.Array | list[str]) -> list[bytes]:
        return list(self.each(texts))
