"""Count-only Viterbi for unigram tokenizers (operator 3).

For each text, the number of pieces of its best segmentation, without building it.
An Aho-Corasick automaton enumerates the vocabulary's matches; at each end, dynamic
programming carries the best score and its piece count. The tie rules are those of
the unigram model: matches that end at a place are tried from the longest (earliest
start) to the shortest, the first of equal scores stays, and where no single
character is in the vocabulary, the unknown piece of one character competes with the
score of the lowest piece less ten.

Texts are normalised by putting the blank sign in front of every word. If no piece
has that sign behind other characters, the best segmentation of a text consists of
those of its words; and if all scores are whole numbers, sums are exact, so that ties
fall the same way. Then each distinct word is segmented once per worker; else every
text is segmented as a whole, like texts with runs of blanks.

Defined results for odd input: null and empty texts have 0 pieces; texts of any length are
counted whole; repeated rows are
counted each for itself; an empty table gives an empty result; other columns are
ignored. Ids may be null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: How far below the lowest piece an unknown character scores.
UNKNOWN_BELOW = 10.0
MOST_WORDS = 400_000

Vocabulary = list[tuple[str, float]]


def read_vocabulary(model_file: str, unknown: str = "<unk>") -> Vocabulary:
    """Pieces and scores of a sentencepiece file, without its control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_BELOW
        whole = all(float(s).is_integer() for _, s in vocabulary)
        # Pieces of blank signs only match where blanks stand side by side; texts with such places are segmented as a whole.
        self.by_word = whole and any(p == BLANK for p, _ in vocabulary) and not any(BLANK in p[1:] and p.strip(BLANK) for p, _ in vocabulary)
        self.words: dict[str, int] = {}

    def pieces(self, text: str) -> int:
        """Pieces of the best segmentation of an already normalised text; runs of unknown characters are one piece each."""
        n = len(text)
        # score, pieces and whether the last piece is unknown, of the best way to each place
        score, count, odd = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ends: Iterator = iter(()) if self.empty else self.automaton.iter(text)
        item = next(ends, None)
        for end in range(n):
            best, pieces, single = None, 0, False
            # Longer matches come first at an end, so an earlier start wins a tie.
            while item is not None and item[0] == end:
                size, s = item[1]
                total = score[end + 1 - size] + s
                if size == 1:
                    single = True
                if best is None or total > best:
                    best, pieces = total, count[end + 1 - size] + 1
                item = next(ends, None)
            unknown = False
            if not single:
                total = score[end] + self.unknown
                if best is None or total > best:
                    # Neighbouring unknown characters fuse into one piece.
                    best, pieces, unknown = total, count[end] + (not odd[end]), True
            score[end + 1], count[end + 1], odd[end + 1] = best, pieces, unknown
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word or text[0] == " " or "  " in text or BLANK in text:
            return self.pieces(normalised(text))
        total, known = 0, self.words
        for w in text.split(" "):
            n = known.get(w)
            if n is None:
                if len(known) > MOST_WORDS:
                    known.clear()
                n = known[w] = self.pieces(BLANK + w)
            total += n
        return total


def normalised(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


@cache
def _counter(packed: bytes) -> Counter:
    return Counter(pickle.loads(packed))


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_chars (code points), n_tokens."""
    packed = pickle.dumps(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(packed)
        for b in batches:
            texts = b["_text"].to_pylist()
            found = pa.array([counter.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array([len(t or "") for t in texts], pa.int64()), found], ["_id", "n_chars", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_chars long, n_tokens long").withColumnRenamed("_id", id_col)
