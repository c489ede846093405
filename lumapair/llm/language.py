"""Multilingual mixture inference for language identification (operator 1).

A text is a bag of character n-grams drawn from a mixture of languages. For a set
of languages, expectation-maximisation estimates the proportions; the set itself
is chosen by penalised likelihood: from the best single language, languages join
as long as the gain exceeds the penalty. The predicted language is the one with the
largest proportion; the score is that proportion times the probability, at equal odds
beforehand, that the best single language is the right one. So a text whose n-grams
tell the languages apart has the proportion as its score, and one without evidence
one part in as many as there are languages.

The models are smoothed n-gram distributions over hashed buckets, learned from
labelled rows. Their sample is bounded by the parameters `most_docs` per language,
drawn by a hash of the id, and whole texts of it are counted. The shares of each language
(256 KB) pass through the driver one language at a time into a file of the shared folder,
which Spark hands to every executor once and tasks map into memory; a text meets
`BLOCK` languages at a time. So neither the driver nor a task holds all languages,
and their number has no bound. The file stays as long as the application, since executors that
start later need it.

Defined results for odd input: text that is null or has no letter is `und` with
score 0, like every text if nothing can be learned (letters are what Unicode calls so);
texts of any length are read whole, one at a time; ties go to the language first
by code point; repeated rows are predicted each for itself; an empty table gives an
empty result; other columns are ignored. Rows without a language or with a null id
train nothing, and a language whose rows have no n-gram is not learned.
"""

from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumapair.session import ship_file

UND = "und"
N, BUCKET_BITS = 3, 15
#: Labelled documents that a language is learned from, about.
MOST_DOCS = 4000
#: Languages whose shares a task holds at a time.
BLOCK = 64
#: Added to every bucket's share.
SMOOTHING = 0.02
#: Log-likelihood that a further language must gain: PENALTY x log(n-grams) / 2 + a share of all n-grams.
PENALTY, PENALTY_SHARE = 8.0, 0.01
ROUNDS = 30


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngram_buckets(text: str) -> np.ndarray:
    """The bucket of each character n-gram of the lower-cased text; runs of characters that are no letters count as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return buckets(points)


def buckets(points: np.ndarray) -> np.ndarray:
    letter = _letters()[points]
    x = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.concatenate(([np.uint64(32)], x[keep], [np.uint64(32)]))
    if len(x) < N:
        return np.empty(0, np.int64)
    mixed = np.zeros(len(x) - N + 1, np.uint64)
    for i in range(N):
        mixed = (mixed + x[i : len(x) - N + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@cache
def _mapped(name: str) -> np.ndarray:
    """The shares in a file that Spark has handed to this machine, mapped, not read."""
    return np.memmap(SparkFiles.get(name), np.float64, "r").reshape(-1, 1 << BUCKET_BITS)


@dataclass
class Model:
    #: By code point.
    languages: list[str]
    #: A row of bucket shares per language, or the name of the shipped file that has them.
    shares: np.ndarray | str
    #: The mean of all rows, never 0. Every language is smoothed by it, so that unseen n-grams favour none of them.
    common: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: The row of each language.
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def p(self, which: np.ndarray | list[int], ids: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams in some of the languages."""
        table = _mapped(self.shares) if isinstance(self.shares, str) else self.shares
        return (1 - SMOOTHING) * table[np.ix_(self.rows[which], ids)] + SMOOTHING * self.common[ids]

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, score, proportions of the chosen set)"""
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return UND, 0.0, {}
        ids, counts = np.unique(ngram_buckets(text), return_counts=True)
        c = counts.astype(np.float64)
        n = float(c.sum())
        parts = np.array_split(np.arange(len(self.languages)), -(-len(self.languages) // BLOCK))
        held = [self.p(parts[0], ids)] if len(parts) == 1 else None
        logs, ceiling = [], np.zeros(len(ids))
        for p in held or (self.p(part, ids) for part in parts):
            logs.append(np.log(p) @ c)
            ceiling = np.maximum(ceiling, p.max(axis=0))
        logs = np.concatenate(logs)
        chosen = [int(logs.argmax())]
        best, shares = float(logs[chosen[0]]), np.ones(1)
        toll = PENALTY * np.log(n + 1) / 2 + PENALTY_SHARE * n
        # No set gains more than the best language of every single n-gram does.
        most = float(c @ np.log(ceiling))
        while len(chosen) < len(self.languages) and most - best > toll:
            # The derivative of the likelihood along each language's share, by which it would grow at first.
            ratio = c / (shares @ self.p(chosen, ids))
            slope = np.concatenate([p @ ratio for p in held or (self.p(part, ids) for part in parts)])
            slope[chosen] = -1.0
            new = int(slope.argmax())
            if slope[new] <= n:
                break
            trial = [*chosen, new]
            found, ll = _expectation_maximisation(self.p(trial, ids), c)
            if ll - best <= toll:
                break
            chosen, shares, best = trial, found, ll
        top = min(range(len(chosen)), key=lambda i: (-shares[i], self.languages[chosen[i]]))
        sure = 1.0 / float(np.exp(np.clip(logs - logs.max(), -700, 0)).sum())
        return self.languages[chosen[top]], float(shares[top]) * sure, {self.languages[k]: float(s) for k, s in zip(chosen, shares)}


def _expectation_maximisation(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the rows of p that make counts c likeliest, and that log-likelihood."""
    k, n = len(p), c.sum()
    shares = np.full(k, 1.0 / k)
    for _ in range(ROUNDS):
        new = shares * (p @ (c / (shares @ p))) / n
        done = np.abs(new - shares).max() < 1e-4
        shares = new
        if done:
            break
    return shares, float(c @ np.log(shares @ p))


_COUNTS = "lang string, bucket int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of as many languages as a task may hold, so that few rows leave it."""
    sums: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])
        sums.clear()

    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), (t.as_py() for t in b["text"])):
            if lang not in sums and len(sums) == BLOCK:
                yield from rows()
            own = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            own += np.bincount(ngram_buckets(text), minlength=1 << BUCKET_BITS)
    yield from rows()


def _packed_counts(rows: pa.Table) -> pa.Table:
    own = np.zeros(1 << BUCKET_BITS, np.int64)
    own[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return pa.table({"lang": [rows["lang"][0].as_py()], "counts": [own.tobytes()]})


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS) -> Model:
    """A model of the labelled rows for which `usable` is true."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    # One row per language comes to the driver, here and below.
    per = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    limits = json.dumps({r["lang"]: most_docs / r["n"] for r in per.toLocalIterator()})
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    limit = F.try_element_at(F.from_json(F.lit(limits), "map<string,double>"), F.col(lang_col))
    sample = rows.where(drawn < limit).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = sample.mapInArrow(_count, _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language, its counts packed in the task.
    packed = got.groupBy("lang").applyInArrow(_packed_counts, "lang string, counts binary")
    languages: list[str] = []
    common = np.zeros(1 << BUCKET_BITS)

    def shares() -> Iterator[bytes]:
        for r in packed.toLocalIterator():
            own = np.frombuffer(r["counts"], np.int64).astype(np.float64)
            own /= max(own.sum(), 1)
            languages.append(r["lang"])
            common[:] += own
            yield own.tobytes()

    name = ship_file(docs.sparkSession, "languages", shares())
    if not languages:
        return Model([], np.zeros((0, 1 << BUCKET_BITS)))
    common = common / len(languages) + 1.0 / (1 << BUCKET_BITS)
    rows_of = np.argsort(np.array(languages, object), kind="stable")
    return Model([languages[k] for k in rows_of], name, common / common.sum(), rows_of)


def _predict(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for b in batches:
            found = [model.infer(t.as_py()) for t in b["_text"]]  # one text at a time
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            shares = pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b["_id"], langs, scores, shares], ["_id", "lang_pred", "score", "proportions"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score (0 to 1), proportions of the chosen languages."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = rows.mapInArrow(_predict(pickle.dumps(model)), f"_id {kind}, lang_pred string, score double, proportions map<string,double>")
    return found.withColumnRenamed("_id", id_col)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language can be told; text that is null or has no letter is rejected."""
    packed, names = pickle.dumps(model), [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        for b in batches:
            yield b.filter(pa.array([own.infer(t.as_py())[0] != UND for t in b.column(at)], pa.bool_()))

    rows = docs.toDF(*names)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
