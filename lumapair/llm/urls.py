"""URL filter by host rules and a weighted vocabulary (operator 11).

The host is what stands behind the first `://` up to `/`, `?`, `#` or the end, with A-Z
lower-cased; the path follows up to `?`, `#` or the end. A rule names a host and the start
of a path; it fits its host and all subdomains. Of the rules that fit, the longest decides.

Where none fits, the vocabulary does: an Aho-Corasick automaton enumerates its terms in
host and path (A-Z lower-cased; queries and fragments carry what the site adds), and a hit counts if no ASCII letter or digit touches it.
A term's weight counts once, however often it is hit: a strict term weighs as much as the limit,
a soft one 1, so that one strict or `limit` distinct soft terms block.

Nothing is shuffled while the rules are a list, as long as a driver would write down. A
list of any size goes in as a table instead: each URL looks up the ends of its host, with as
many characters of its path as rules of that host have, by equality joins, whose hot keys
adaptive execution can split. Both ways give the same rows.

Defined results for odd input: a null URL, or one without `://`, has an empty host and an
empty path, which no rule fits and which holds no term, and is allowed. URLs of any length count whole; repeated
rows and null ids are judged each for itself; an empty table gives an empty result; without rules or without
terms the other half decides; of rules of equal length that with the longer host decides, and a rule given with both verdicts blocks; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import cache
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumapair.session import materialize

#: (verdict, host, start of the path)
Rule = tuple[str, str, str]
LIMIT = 2
STRICT = ["casino", "cialis", "escorts", "hentai", "porn", "spam", "viagra", "warez", "xxx"]
SOFT = [
    "adult", "ads", "bet", "bets", "betting", "bonus", "cam", "cams", "cheap", "click", "crack", "discount", "free", "jackpot", "keygen", "nude", "pharmacy",
    "pill", "pills", "poker", "popup", "sex", "slots", "torrent", "track", "tracker", "win", "winner", "x",
]
VOCABULARY: dict[str, int] = dict.fromkeys(SOFT, 1) | dict.fromkeys(STRICT, LIMIT)

_WORD = frozenset(ascii_lowercase + "0123456789")


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Terms:
    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            if term:
                self.automaton.add_word(term, (term, weight))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> dict[str, int]:
        """Distinct terms that stand free in a lower-cased text, with their weights."""
        found: dict[str, int] = {}
        if not text or self.empty:
            return found
        for end, (term, weight) in self.automaton.iter(text):
            begin = end + 1 - len(term)
            if (begin == 0 or text[begin - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found[term] = weight
        return found


class Rules:
    """Per host the lengths of its rules' paths, longest first, and their verdicts."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.of: dict[str, tuple[list[int], dict[str, str]]] = {}
        for verdict, host, path in rules:
            paths = self.of.setdefault(host, ([], {}))[1]
            paths[path] = max(verdict, paths.get(path, verdict))
        for lengths, paths in self.of.values():
            lengths.extend(sorted({len(p) for p in paths}, reverse=True))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best: tuple[int, int, str, str] | None = None
        while True:
            lengths, paths = self.of.get(host, ((), {}))
            n = next((n for n in lengths if n <= len(path) and path[:n] in paths), None)
            if n is not None:
                own = (len(host) + n, len(host), host + path[:n], paths[path[:n]])
                best = own if best is None else max(best, own)
            _, dot, host = host.partition(".")
            if not dot:
                return best and best[2:]


@cache
def _prepared(packed: bytes) -> tuple[Terms, Rules]:
    vocabulary, rules = pickle.loads(packed)
    return Terms(vocabulary), Rules(rules)


def _scanned(rows: DataFrame, id_type: str, rules: Sequence[Rule], vocabulary: dict[str, int]) -> DataFrame:
    """_id, host, path, rule, rule_verdict, hits, weight of rows with _id, host, path and low."""
    packed = pickle.dumps((vocabulary, list(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, known = _prepared(packed)
        for b in batches:
            found = [known.find(h, p) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist())]
            hits = [terms.hits(t) for t in b["low"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b["_id"], b["host"], b["path"], pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.string()),
                    pa.array([sorted(h) for h in hits], pa.list_(pa.string())), pa.array([sum(h.values()) for h in hits], pa.int64()),
                ],
                ["_id", "host", "path", "rule", "rule_verdict", "hits", "weight"],
            )

    return rows.mapInArrow(run, f"_id {id_type}, host string, path string, rule string, rule_verdict string, hits array<string>, weight long")


def _ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """_row, rule and rule_verdict of rows (with _row, host, path) that a rule of the table (verdict, host, path) fits."""
    own = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict").where("r_host IS NOT NULL AND r_path IS NOT NULL")
    once = materialize(own.groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict")), "rules")
    # At most as many lengths as the longest path has characters.
    lengths = once.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = rows.select("_row", "path", F.explode(ends).alias("end")).join(lengths, F.col("end") == F.col("r_host"))
    keys = met.select("_row", "path", F.col("end").alias("k_host"), F.explode("lengths").alias("n")).where("n <= length(path)")
    keys = keys.select("_row", "k_host", F.expr("substring(path, 1, n)").alias("k_path"))
    fitting = keys.join(once, (F.col("k_host") == F.col("r_host")) & (F.col("k_path") == F.col("r_path")))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    return fitting.groupBy("_row").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), order).alias("r")).select("_row", "r.rule", F.col("r.verdict").alias("rule_verdict"))


def judge(urls: DataFrame, rules: Sequence[Rule] | DataFrame, vocabulary: dict[str, int] | None = None, limit: int = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of urls: id_col, host, path, rule (null if none fits), verdict (block or allow), hits (distinct terms), weight (of the hits).

    rules: a list of (verdict, host, path), sent with the job; or a table with these columns, of any size.
    """
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    url = F.col(f"`{url_col}`")
    id_type = urls.schema[id_col].dataType.simpleString()
    rows = urls.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("low", lowered(F.concat("host", "path")))
    if isinstance(rules, DataFrame):
        numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
        key = f"struct<i:{id_type},r:bigint>"
        scanned = _scanned(numbered.withColumn("_id", F.struct(F.col("_id").alias("i"), F.col("_row").alias("r"))), key, [], vocabulary)
        scanned = scanned.drop("rule", "rule_verdict").withColumn("_row", F.col("_id.r")).withColumn("_id", F.col("_id.i"))
        judged = scanned.join(_ruled(numbered, rules), "_row", "left")
    else:
        judged = _scanned(rows, id_type, rules, vocabulary)
    verdict = F.coalesce("rule_verdict", F.when(F.col("weight") >= limit, "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "hits", "weight")
