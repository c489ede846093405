"""Mixing sources to target weights by systematic sampling (operator 10, native).

Sources in code-point order, null last, have the weights 1, 2, 3, repeating. They
share all words by weight; a target stops at `most` times its source's words and
the excess is shared again by weight, which ends at one common level: the target
of a source is the smaller of level x weight and its limit. Within a source, each
document is expected to come target / source words times. Documents are ordered by
size, so that equal sizes stand together and what is taken stays near the target;
the expected copies are summed along this order, one random offset per source is
added, and a document is emitted once for each integer boundary its interval crosses.

Equal sizes are ordered by id, null last, and then by the text's hash.

Defined results for odd input: texts of any length count whole; null text has no words, and a document without
words takes none; a source without words has target 0 and is taken 0 times; rows
that repeat an id are sampled each for itself (in `mixed_documents` they share the
copies of their id as evenly as whole numbers allow); null ids are ordered last;
an empty table gives an empty result; other columns are ignored by `mix` and kept
by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lumapair.llm.ranks import numbered
from lumapair.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A source is taken at most so many times.
MOST = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target) of a table with source and size; one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # The windows without a partition run over one row per source, not over documents.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("w", (F.pmod(F.row_number().over(named) - 1, F.lit(3)) + 1).cast("double"))
    everything = Window.partitionBy()
    fullest = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    up_to = fullest.rowsBetween(Window.unboundedPreceding, -1)
    limits = weighed.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("k", F.row_number().over(fullest))
    # Level if this source and all fuller ones share what the sources before it leave.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0))
    )
    levels = limits.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    common = F.min(F.when(F.col("open"), F.struct("k", "level"))).over(everything)["level"]
    return levels.withColumn("common", common).select(
        "source", "source_size", "docs", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap"))).alias("target"),
    )


def offset(source: Column, seed: str = SEED) -> Column:
    """A random number in [0, 1) for each source, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, most: int, seed: str) -> DataFrame:
    """id, source, text_hash, size, source_size, target, copies: one row per row of docs."""
    text = F.col(f"`{text_col}`")
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(text).alias("text_hash"), n_words(text).alias("size"))
    sizes = materialize(sizes, "sizes")
    targets = materialize(source_targets(sizes, most), "targets")
    rows = targets.agg(F.sum("docs")).first()[0] or 0
    placed = numbered(sizes, F.col("source"), [F.col("size"), F.col("id").asc_nulls_last(), F.col("text_hash")], "place", rows)
    t = targets.select(F.col("source").alias("named"), "source_size", "target")
    # One row per source: Spark broadcasts it under its own size threshold, and else joins with skew handling.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    copies = F.floor((F.col("place") + 1) * rate + u) - F.floor(F.col("place") * rate + u)
    return placed.join(t, F.col("source").eqNullSafe(F.col("named"))).withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, copies, taken (copies x size)."""
    joined = _mixed(docs, id_col, text_col, source_col, most, seed)
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: str = SEED) -> DataFrame:
    """Rows of docs, each as often as the mix takes it.

    Rows find their copies by a key over id, source and text, so texts move once and null
    ids are spread. Rows that share the key share its copies; only they are numbered.
    """
    taken = _mixed(docs, id_col, text_col, source_col, most, seed)
    times = taken.groupBy(F.xxhash64("id", "source", "text_hash").alias("k")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, t, s = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col, source_col))
    keyed = docs.toDF(*names).withColumn("k", F.xxhash64(i, s, F.xxhash64(t)))
    joined = keyed.join(times, "k")
    values = [F.col(f.name) if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(f.name)) for f in joined.select(names).schema]
    alone = joined.where("rows = 1").select(*names, F.col("copies").alias("n"))
    # Rows that repeat are numbered by ranges, as one of them may be very many.
    repeated = materialize(joined.where("rows > 1").withColumn("order", F.xxhash64(*values)).withColumn("row", F.monotonically_increasing_id()), "repeated")
    placed = numbered(repeated, F.col("k"), [F.col("order"), F.col("row")], "place", repeated.count())
    share = F.floor((F.col("place") + 1) * F.col("copies") / F.col("rows")) - F.floor(F.col("place") * F.col("copies") / F.col("rows"))
    shared = placed.select(*names, share.cast("long").alias("n")).where("n > 0")
    again = alone.union(shared).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return again.select(names).toDF(*docs.columns)
