"""Pairing of ground truth and degraded files, limits and samples per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumapair.operators.places import placed


def one_per_key(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Of files that share the keys, the lowest path."""
    return files.groupBy(*keys).agg(F.min(path).alias(path))


def pair(gt: DataFrame, lq: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """keys, gt_path, lq_path of files on both sides; one to one."""
    left = one_per_key(gt, keys, path).withColumnRenamed(path, "gt_path")
    right = one_per_key(lq, keys, path).withColumnRenamed(path, "lq_path")
    return left.join(right, keys)


def pair_sides(files: DataFrame, gt: Column, lq: Column, keys: list[str], path: str = "path") -> DataFrame:
    """keys, gt_path, lq_path as `pair` gives them, of one listing that holds both sides: one scan and one shuffle."""
    lowest = lambda side: F.min(F.when(side, F.col(path)))
    both = files.groupBy(*keys).agg(lowest(gt).alias("gt_path"), lowest(lq).alias("lq_path"))
    return both.where("gt_path IS NOT NULL AND lq_path IS NOT NULL")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys on one side only, with the side: `missing` (not right) or `unexpected` (not left)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def _limited(df: DataFrame, group: str, order: list[Column], limit: int | None) -> DataFrame:
    if limit is None or limit <= 0:
        return df
    # Spark prunes to the first rows of each group before the shuffle (window group limit).
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def head_per_group(df: DataFrame, group: str, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of each group; all, if the limit is None or not above 0."""
    return _limited(df, group, order, limit)


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_per_group(df: DataFrame, group: str, key: str, limit: int | None, seed: int) -> DataFrame:
    """`limit` rows of each group without replacement, the same for a seed."""
    return _limited(df, group, [hash_order(F.col(key), seed), F.col(key)], limit)


def group_seed(name: Column) -> Column:
    """A seed below 2^31 for a group's name."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % (1 << 31)


def prompt_dictionary(df: DataFrame, prompt: str = "prompt", position: str = "position") -> DataFrame:
    """Distinct prompts in the order they come first, with their number and share of rows."""
    per = df.groupBy(prompt).agg(F.min(position).alias("first"), F.count("*").alias("n"))
    order = Window.orderBy("first")  # over distinct prompts, not over rows
    return per.select(prompt, "first", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), (F.row_number().over(order) - 1).alias("prompt_id"))


def head(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows overall; all, if the limit is None or not above 0."""
    return df if limit is None or limit <= 0 else df.orderBy(*order).limit(limit)


def sample(df: DataFrame, key: str, limit: int | None, seed: int) -> DataFrame:
    """`limit` rows overall without replacement, the same for a seed."""
    return head(df, [hash_order(F.col(key), seed), F.col(key)], limit)


def seeded_sample_per_group(df: DataFrame, group: str, key: str, limit: int | None) -> DataFrame:
    """`limit` rows of each group without replacement, by a seed that follows from the group's name."""
    order = F.md5(F.concat(group_seed(F.col(group).cast("string")).cast("string"), F.lit(":"), F.col(key).cast("string")))
    return _limited(df, group, [order, F.col(key)], limit)


def numbered_in_group(df: DataFrame, group: str, order: list[Column], name: str = "image_index") -> DataFrame:
    """df with the place of each row in its group, from 0; a group may be of any size."""
    return placed(df, order, name, [F.col(group)])


def save_counts(sizes: DataFrame, config: dict, sub: str = "sub_name", group: str = "weather", n: str = "n") -> DataFrame:
    """sizes (one row per sub-dataset) with `k`: how many images to save. <weather>_<sub>_num counts before <weather>_num; none set or below 0: all; nothing if save_predictions is off."""
    if not config.get("save_predictions", True):
        return sizes.withColumn("k", F.lit(0).cast("long"))
    set_ = [x for name, v in config.items() if name.endswith("_num") and v is not None for x in (F.lit(name), F.lit(int(v)))]
    table = F.create_map(*set_) if set_ else F.create_map(F.lit(""), F.lit(-1))
    own = F.concat(F.col(group), F.lit("_"), F.regexp_replace(F.col(sub), r"^[^_]*_", ""), F.lit("_num"))
    k = F.coalesce(F.try_element_at(table, own), F.try_element_at(table, F.concat(F.col(group), F.lit("_num"))), F.lit(-1))
    return sizes.withColumn("k", F.when(k < 0, F.col(n)).otherwise(F.least(k.cast("long"), F.col(n))))


def saved_images(images: DataFrame, counts: DataFrame, sub: str = "sub_name", at: str = "image_index", stem: str = "stem") -> DataFrame:
    """The first k images of each sub-dataset with the names of their three files."""
    kept = images.join(counts.select(sub, "k"), sub).where(F.col(at) < F.col("k")).drop("k")
    base = F.concat(F.lpad(F.col(at).cast("string"), 3, "0"), F.lit("_"), F.col(stem).cast("string"))
    return kept.withColumns({side: F.concat(base, F.lit(f"_{side}.png")) for side in ("pred", "lq", "gt")})


def with_lookup(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df with what `known` has for its key (embeddings of prompts, say); a key that is not there once is an error."""
    once = known.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    found = df.join(once, key, "left")
    fault = F.concat(F.lit("not one row for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = found.withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(fault)))
    return checked.where("_n = 1").drop("_n")


def matched(images: DataFrame, prompts: DataFrame, at: str = "at") -> DataFrame:
    """Images with prompts: by place if there are as many, or one of one side with all of the other; the lists are given by hand and short."""
    n, m = images.count(), prompts.count()
    if n == m:
        return images.join(prompts, at)
    if n == 1:
        return prompts.crossJoin(F.broadcast(images.drop(at)))
    if m == 1:
        return images.crossJoin(F.broadcast(prompts.drop(at)))
    raise ValueError(f"{n} images and {m} prompts: one of either, or as many of both, are needed")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that a seed decides."""
    return df.orderBy(hash_order(F.col(key), seed), key)
