"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumapair.session import materialize

#: Rows that one range of the order holds, about.
RANGE_ROWS = 100_000


def numbered(df: DataFrame, group: Column, order: list[Column], name: str, rows: int) -> DataFrame:
    """df with `name`: a long from 0, gapless within each group, in the given order.

    The rows are dealt by ranges of (group, order), so a group with a third of all
    rows spans many tasks. Each range is numbered by itself; the counts of the
    earlier ranges of a group (a small table: ranges times groups that meet) are
    added. `rows` is the number of rows of df. Rows equal in group and order are
    numbered in any order.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, rows // RANGE_ROWS + 1)
    keyed = df.withColumn("_g", group).repartitionByRange(ranges, F.col("_g").asc_nulls_last(), *order)
    dealt = materialize(keyed.withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range", "_g").orderBy(*order)
    counts = dealt.groupBy("_g", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_g").alias("_bg"), F.col("_range").alias("_br"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    placed = dealt.withColumn("_own", F.row_number().over(own) - 1)
    joined = placed.join(base, (F.col("_range") == F.col("_br")) & F.col("_g").eqNullSafe(F.col("_bg")))
    return joined.withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_g", "_bg", "_br", "_base", "_own", "_range")
