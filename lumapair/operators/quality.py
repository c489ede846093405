"""Data-quality aggregates, step rules and checkpoint retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tensor_diagnostics(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Root mean square and largest absolute value of an array column's elements, per keys. Sums are per row first, so elements are never exploded."""
    v = F.transform(values, lambda x: x.cast("double"))
    row = df.select(*keys, F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("_s"), F.size(values).alias("_n"), F.array_max(F.transform(v, lambda x: F.abs(x))).alias("_m"))
    return row.groupBy(*keys).agg(F.sqrt(F.sum("_s") / F.sum("_n")).alias("rms"), F.max("_m").alias("abs_max"))


def ratio(delta: Column, main: Column, floor: float = 1e-8) -> Column:
    return delta / F.greatest(main, F.lit(floor))


def nonfinite_guard(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of null, NaN and infinite values, and the extremes of the finite ones."""
    x = F.col(value).cast("double")
    infinite = F.abs(x) == F.lit(float("inf"))
    finite = F.when(~F.isnan(x) & ~infinite, x)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(infinite).alias("n_inf"),
        F.min(finite).alias("finite_min"), F.max(finite).alias("finite_max"),
    )


def first_offenders(df: DataFrame, group: str, name: str, value: str, most: int = 20) -> DataFrame:
    """The first names of each group with a value that is not finite."""
    x = F.col(value).cast("double")
    bad = df.where(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return bad.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(name))).where(F.col("_n") <= most).select(group, name)


def magnitude_buckets(df: DataFrame, keys: list[str], value: str, small: float = 1e-6, large: float = 1e-2) -> DataFrame:
    a = F.abs(F.col(value))
    return df.groupBy(*keys).agg(F.count_if(a < small).alias("tiny"), F.count_if((a >= small) & (a < large)).alias("small"), F.count_if(a >= large).alias("large"))


def step_triggers(steps: DataFrame, every: dict[str, int], step: str = "step", start: int = 0) -> DataFrame:
    """steps with a boolean per rule: the step is a multiple of the rule's interval, counted from `start` (0 and below: never)."""
    cols = {name: (F.col(step) > start) & ((F.col(step) - start) % n == 0) if n > 0 else F.lit(False) for name, n in every.items()}
    return steps.withColumns(cols)


def resume_point(steps: DataFrame, updates_per_epoch: int, accumulation: int, step: str = "step") -> DataFrame:
    """Epoch and micro-batches to skip when resuming at a step."""
    return steps.withColumn("epoch", F.floor(F.col(step) / updates_per_epoch).cast("long")).withColumn("skip", (F.col(step) % updates_per_epoch) * accumulation)


def retention(checkpoints: DataFrame, keep: int, step: str = "step") -> DataFrame:
    """checkpoints with `kept`: before a save, the newest keep - 1 stay. The list of checkpoints is small."""
    newest = F.row_number().over(Window.orderBy(F.desc(step)))
    return checkpoints.withColumn("kept", newest <= max(keep - 1, 0))


def batch_times(df: DataFrame, group: str, position: str, seconds: str, size: int) -> DataFrame:
    """df with `batch` and the batch's mean seconds per row."""
    batched = df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))
    return batched.withColumn("batch_mean", F.avg(seconds).over(Window.partitionBy(group, "batch")))
