"""Reports over per-image metrics and over repeated seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def nan_mean(x: Column) -> Column:
    """Mean of what is not NaN; NaN if nothing is."""
    return F.coalesce(F.avg(no_nan(x)), F.lit(float("nan")))


def rollup_report(per_image: DataFrame, group: str, sub: str, metrics: dict[str, Column]) -> DataFrame:
    """Number of images and pooled means per sub-dataset, per group and overall; level is sub, group or all."""
    out = per_image.groupingSets([(F.col(group), F.col(sub)), (F.col(group),), ()], F.col(group), F.col(sub)).agg(
        F.count("*").alias("n"), *[m.alias(k) for k, m in metrics.items()], F.grouping_id().alias("_level")
    )
    level = F.when(F.col("_level") == 0, "sub").when(F.col("_level") == 1, "group").otherwise("all")
    return out.withColumn("level", level).drop("_level")


def macro_and_micro(per_image: DataFrame, group: str, metric: str) -> DataFrame:
    """One row: the mean over groups of their means, and the mean over all images."""
    per = per_image.groupBy(group).agg(F.avg(metric).alias("m"), F.sum(metric).alias("s"), F.count(metric).alias("n"))
    return per.agg(F.avg("m").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def seed_means(runs: DataFrame, group: str, score: str) -> DataFrame:
    """Per group and seed: number of images and mean score."""
    return runs.groupBy(group, "seed").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def best_and_worst(score: str, position: str = "seed_pos") -> list[Column]:
    """Seeds of the best and the worst score; of equal ones, the first in the list of seeds. NaN scores are left out."""
    s, p = no_nan(F.col(score)), F.col(position)
    return [
        F.min_by("seed", F.when(s.isNotNull(), F.struct((-s).alias("s"), p.alias("p")))).alias("best_seed"),
        F.min_by("seed", F.when(s.isNotNull(), F.struct(s.alias("s"), p.alias("p")))).alias("worst_seed"),
    ]


def image_stability(runs: DataFrame, keys: list[str], score: str, position: str = "seed_pos") -> DataFrame:
    """Per image over its seeds: mean, population deviation, range, best and worst seed, gain of the best over the mean."""
    s = no_nan(F.col(score))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_seeds"), F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"), (F.max(s) - F.min(s)).alias("score_range"),
        *best_and_worst(score, position), F.max(s).alias("best_score"), F.min(s).alias("worst_score"), (F.max(s) - F.avg(s)).alias("oracle_gain"),
    )


def seed_summary(runs: DataFrame, stability: DataFrame, group: str, score: str, wide: float) -> DataFrame:
    """Per group: mean and population deviation of the seeds' means, mean range and gain, percentage of images whose range is `wide` or more."""
    means = seed_means(runs, group, score).groupBy(group).agg(F.avg("mean_score").alias("score_mean"), F.stddev_pop("mean_score").alias("score_std"), F.count("*").alias("n_seeds"))
    images = stability.groupBy(group).agg(
        F.count("*").alias("n_images"), F.avg("score_range").alias("range_mean"), F.avg("oracle_gain").alias("gain_mean"),
        (F.avg(F.when(F.col("score_range") >= wide, 1.0).otherwise(0.0)) * 100).alias("wide_pct"),
    )
    return means.join(images, group)


def against_first(runs: DataFrame, keys: list[str], score: str, position: str = "seed_pos") -> DataFrame:
    """Mean and largest absolute difference from the run at position 0, over the other runs of the same image."""
    first = runs.where(F.col(position) == 0).select(*keys, F.col(score).alias("_first"))
    others = runs.where(F.col(position) > 0).join(first, keys)
    return others.groupBy(*keys).agg(F.avg(F.abs(F.col(score) - F.col("_first"))).alias("difference_mean"), F.max(F.abs(F.col(score) - F.col("_first"))).alias("difference_max"))


def sweep_stats(runs: DataFrame, score: str, position: str) -> DataFrame:
    """One row over all candidates: mean, population deviation, extremes and their positions (the first of equal ones)."""
    return runs.agg(
        F.count("*").alias("n"), F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"), F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.min_by(position, F.struct((-F.col(score)).alias("s"), F.col(position).alias("p"))).alias("best_at"), F.min_by(position, F.struct(F.col(score).alias("s"), F.col(position).alias("p"))).alias("worst_at"),
    )


def metrics_report(per_image: DataFrame, group: str = "weather", sub: str = "sub_name") -> DataFrame:
    """psnr, ssim, lpips (NaN skipped) and avg_time of per-image rows, pooled per sub-dataset, per group and overall; the overall row has no time."""
    metrics = {"psnr": F.avg("psnr"), "ssim": F.avg("ssim"), "lpips": nan_mean(F.col("lpips")), "avg_time": F.when(F.grouping_id() < 3, F.avg("infer_time"))}
    return rollup_report(per_image, group, sub, metrics)


def pair_means(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of means; 0 where there is no pair."""
    return pairs.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def seed_table(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """The per-seed table (11 columns) of runs over images and of the degraded inputs' own scores.

    runs: subdataset, weather, image_index, seed, seed_pos, elapsed_sec (of the seed), psnr,
    ssim, lpips, diversity (distance from the first seed's image). baseline: subdataset,
    image_index, lq_psnr, lq_ssim, lq_lpips. NaN is skipped in lpips and diversity.
    """
    per = runs.groupBy("subdataset", "weather", "seed").agg(
        F.max("elapsed_sec").alias("elapsed_sec"), F.avg("psnr").alias("mean_psnr"), F.avg("ssim").alias("mean_ssim"), nan_mean(F.col("lpips")).alias("mean_lpips"),
        F.when(F.min("seed_pos") == 0, 0.0).otherwise(nan_mean(F.col("diversity"))).alias("mean_diversity_lpips_vs_seed0"),
    )
    lq = baseline.groupBy("subdataset").agg(F.avg("lq_psnr").alias("lq_mean_psnr"), F.avg("lq_ssim").alias("lq_mean_ssim"), nan_mean(F.col("lq_lpips")).alias("lq_mean_lpips"))
    return per.join(lq, "subdataset")


def image_spread(runs: DataFrame) -> DataFrame:
    """Stability of each image over its seeds: the per-image table without paths."""
    lpips = no_nan(F.col("lpips"))
    return runs.groupBy("subdataset", "weather", "image_index").agg(
        F.avg("psnr").alias("psnr_mean"), F.stddev_pop("psnr").alias("psnr_std"), (F.max("psnr") - F.min("psnr")).alias("psnr_range"),
        F.stddev_pop("ssim").alias("ssim_std"), (F.max("ssim") - F.min("ssim")).alias("ssim_range"),
        F.coalesce(F.stddev_pop(lpips), F.lit(float("nan"))).alias("lpips_std"), F.coalesce(F.max(lpips) - F.min(lpips), F.lit(float("nan"))).alias("lpips_range"),
        *[c.alias(a) for c, a in zip(best_and_worst("psnr"), ("best_psnr_seed", "worst_psnr_seed"))],
        F.max(no_nan(F.col("psnr"))).alias("best_psnr"), F.min(no_nan(F.col("psnr"))).alias("worst_psnr"), (F.max(no_nan(F.col("psnr"))) - F.avg("psnr")).alias("oracle_psnr_gain"),
    )


def image_table(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """The per-image table (17 columns). paths: subdataset, image_index, lq_path, gt_path."""
    return image_spread(runs).join(paths, ["subdataset", "image_index"])


def summary_table(seeds: DataFrame, images: DataFrame, first_seed: int, wide: float = 0.5) -> DataFrame:
    """The per-subdataset table (17 columns) of a seed table and the stability of images; a NaN mean of a seed stays in the lpips columns."""
    other = F.when(F.col("seed") != first_seed, F.col("mean_diversity_lpips_vs_seed0"))
    per = seeds.groupBy("subdataset", "weather").agg(
        *[f(f"mean_{m}").alias(f"{m}_{a}") for m in ("psnr", "ssim", "lpips") for f, a in ((F.avg, "mean"), (F.stddev_pop, "std"))],
        F.avg(other).alias("diversity_lpips_mean"), F.max(other).alias("diversity_lpips_max"), *[F.avg(c).alias(c) for c in ("lq_mean_psnr", "lq_mean_ssim", "lq_mean_lpips")],
    )
    over = images.groupBy("subdataset").agg(
        F.count("*").alias("n_samples"), F.avg("psnr_range").alias("per_image_psnr_range_mean"), F.avg("oracle_psnr_gain").alias("per_image_oracle_psnr_gain_mean"),
        (F.avg(F.when(F.col("psnr_range") >= wide, 1.0).otherwise(0.0)) * 100).alias("images_with_psnr_range_ge_0_5_pct"),
    )
    return per.join(over, "subdataset")


def step_scalars(report: DataFrame, step: int, group: str = "weather", metrics: tuple[str, ...] = ("psnr", "ssim")) -> DataFrame:
    """(step, key, value) for a step log: val/<group>/<metric> per group, and val/avg_<metric>, the mean over groups."""
    long = report.select(F.col(group).alias("g"), F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m) for m in metrics]))).alias("m", "value"))
    each = long.select(F.concat_ws("/", F.lit("val"), "g", "m").alias("key"), "value")
    mean = long.groupBy("m").agg(F.avg("value").alias("value")).select(F.concat(F.lit("val/avg_"), "m").alias("key"), "value")
    return each.union(mean).select(F.lit(step).cast("long").alias("step"), "key", "value")
