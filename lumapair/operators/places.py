"""Places of rows in an order, over all rows or within groups of any size.

Rows are dealt by ranges of the order, each range is numbered by itself, and the counts of the ranges
before it are added. No task meets more than a range, however large a group is, and only
one count per range and group is summed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lumapair.session import materialize

#: Rows of a range, about.
RANGE_ROWS = 200_000


def placed(df: DataFrame, order: list[Column], name: str, group: list[Column] | None = None, range_rows: int | None = None) -> DataFrame:
    """df with `name`: a long from 0, gapless over all rows or within each group (null is a group).

    Rows equal in group and order are placed by the hash of their values, so that the places of
    different rows do not depend on how the table is partitioned; equal rows are dealt over ranges like others.
    """
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(df.columns))]
    keys = [f"g{i}" for i in range(len(group or []))]
    values = [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // (range_rows or RANGE_ROWS) + 1)
    own = df.select("*", *[g.alias(f"_place_{k}") for g, k in zip(group or [], keys)], F.xxhash64(*values).alias("_place_h"), F.monotonically_increasing_id().alias("_place_m"))
    full = [*[F.col(f"_place_{k}").asc_nulls_first() for k in keys], *order, F.col("_place_h"), F.col("_place_m")]
    dealt = own.repartitionByRange(ranges, *full).sortWithinPartitions(*full)
    # The rows of a range are in order; their numbers follow each other.
    dealt = dealt.withColumn("_place_r", F.spark_partition_id()).withColumn("_place_n", F.monotonically_increasing_id())
    written = materialize(dealt.toDF(*names, *keys, "h", "m", "r", "n"), "places")
    counts = written.groupBy(*keys, "r").agg(F.count("*").alias("rows"), F.min("n").alias("first"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("r").alias("at"), *[F.col(k).alias(f"k_{k}") for k in keys], (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    same = F.col("r") == F.col("at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    found = written.join(base, same)
    return found.select(*[F.col(c) for c in names], (F.col("n") + F.col("shift")).cast("long").alias("place")).toDF(*df.columns, name)


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], name: str = "place") -> DataFrame:
    """Rows of two lists by their place: columns of both (which must differ) and the place; the longer list is cut."""
    a, b = placed(left, left_order, name), placed(right, right_order, name)
    return a.join(b, name)


def batches(df: DataFrame, key: str, size: int, seed: int, epochs: int = 1, drop_last: bool = False) -> DataFrame:
    """df once per epoch, with epoch, place and batch: an order that seed and epoch decide, cut into batches of one size. The last, smaller batch stays unless drop_last."""
    if size < 1 or epochs < 1:
        raise ValueError("size and epochs must be 1 or more")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")))
    found = placed(each, [at, F.col(key)], "place", [F.col("epoch")]).withColumn("batch", F.floor(F.col("place") / size))
    return found.where(F.col("batch") < df.count() // size) if drop_last else found


def collated(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per epoch and batch of `batches`: n, and for each column the values in order of place, stacked. A batch has the size that was asked for, so that a row stays small."""
    per = df.groupBy("epoch", "batch").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias("rows"))
    return per.select("epoch", "batch", F.size("rows").alias("n"), *[F.col(f"rows.{c}").alias(c) for c in columns])
