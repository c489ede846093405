"""Noise schedules and the residual-strength correction, as expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flow_start(strength: float, shift: float) -> float:
    """Where a shifted schedule starts for a strength in (0, 1]."""
    if not 0 < strength <= 1:
        raise ValueError("strength must be in (0, 1]")
    return strength / (shift - strength * (shift - 1))


def flow_start_of(strength: Column, shift: float) -> Column:
    """`flow_start` of a column of strengths."""
    fault = F.concat(F.lit("strength must be in (0, 1], not "), strength.cast("string"))
    start = strength / (shift - strength * (shift - 1))
    return F.when((strength > 0) & (strength <= 1), start).when(strength.isNotNull(), F.raise_error(fault).cast("double"))


def flow_schedule(start: Column, steps: Column, train_steps: int = 1000) -> Column:
    """`steps` evenly spaced noise levels from start to 1 / train_steps."""
    end = F.lit(1.0 / train_steps)
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.when(steps == 1, start).otherwise(start + (end - start) * i / (steps - 1)))


def rss_weight(sigmas: Column, step: Column, weight: float, threshold: float) -> Column:
    """Correction weight after a step: 0 below the threshold of the normalised noise level."""
    if weight < 0 or not 0 <= threshold < 1:
        raise ValueError("weight must be >= 0 and threshold in [0, 1)")
    nxt = F.get(sigmas, F.least(step + 1, F.size(sigmas) - 1))
    low, high = F.array_min(sigmas), F.array_max(sigmas)
    level = F.least(F.greatest((nxt - low) / F.greatest(high - low, F.lit(1e-8)), F.lit(0.0)), F.lit(1.0))
    return F.lit(weight) * F.greatest((level - threshold) / (1 - threshold), F.lit(0.0))


def toward(values: Column, target: Column, weight: Column) -> Column:
    """Linear step toward target where weight is above 0; arrays of different sizes are an error."""
    fault = F.concat(F.lit("sizes differ: "), F.size(values).cast("string"), F.lit(" and "), F.size(target).cast("string"))
    step = F.when(F.size(values) == F.size(target), F.zip_with(values, target, lambda x, y: x + weight * (y - x))).otherwise(F.raise_error(fault))
    return F.when(weight > 0, step).otherwise(values)


def image_loss_weight(sigma: Column) -> Column:
    return 1 - F.least(F.greatest(sigma, F.lit(0.0)), F.lit(1.0))


def timestep_index(u: Column, train_steps: int = 1000) -> Column:
    return (u * train_steps).cast("int")


def stage_indices(layers: Column, interval: int) -> Column:
    """Layers that end a stage: every interval-th, but not the last layer."""
    return F.filter(F.sequence(F.lit(0), layers - 1), lambda i: (i < layers - 1) & ((i + 1) % interval == 0))


def total_loss(mse: Column, terms: list[tuple[float, Column]]) -> Column:
    """mse plus weighted terms; a null term (not computed at a step) adds nothing."""
    out = mse
    for weight, term in terms:
        out = out + F.lit(weight) * F.coalesce(term, F.lit(0.0))
    return out


def residual_index(block: Column, layers: int | Column, residuals: int | Column) -> Column:
    """Which of `residuals` control outputs a block of `layers` takes."""
    per = layers / residuals
    return F.floor(block / (per if isinstance(per, Column) else F.lit(per))).cast("int")


#: The published rational approximation of the inverse normal distribution (relative error below 1.2e-9), for the middle and for the tails.
MIDDLE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
MIDDLE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL = 0.02425


def _polynomial(factors: list[float], x: Column) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + F.lit(f)
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal value below which a share p (between 0 and 1) lies."""
    r = p - 0.5
    middle = _polynomial(MIDDLE_TOP, r * r) * r / _polynomial(MIDDLE_BOTTOM, r * r)
    low, high = (F.sqrt(-2 * F.log(x)) for x in (p, 1 - p))
    tail = lambda q: _polynomial(TAIL_TOP, q) / _polynomial(TAIL_BOTTOM, q)
    return F.when(p < TAIL, tail(low)).when(p > 1 - TAIL, -tail(high)).otherwise(middle)


def uniform_draw(key: Column, seed: int) -> Column:
    """A number between 0 and 1, neither included, that key and seed decide."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def timestep_density(u: Column, scheme: str, logit_mean: float = 0.0, logit_std: float = 1.0, mode_scale: float = 1.29) -> Column:
    """A uniform draw u as a time in [0, 1) of the scheme's density.

    logit_normal: the logistic function of a normal value. mode: heavier towards the ends or
    the middle, as mode_scale says. cosine: the cosine map's density. sigma_sqrt and
    cosmap weigh losses, and draw evenly.
    """
    if scheme == "logit_normal":
        return 1 / (1 + F.exp(-(inverse_normal(u) * logit_std + logit_mean)))
    if scheme == "mode":
        c = F.cos(F.lit(pi / 2) * u)
        return 1 - u - F.lit(mode_scale) * (c * c - 1 + u)
    if scheme == "cosine":
        return 1 - 1 / (F.tan(F.lit(pi / 2) * u) + 1)
    if scheme in ("sigma_sqrt", "cosmap"):
        return u
    raise ValueError(f"unknown scheme {scheme}")


def with_sigma(df: DataFrame, schedule: DataFrame, timestep: str = "timestep", sigma: str = "sigma") -> DataFrame:
    """df with the noise level of its timestep; a timestep that the schedule has not just once is an error."""
    known = schedule.groupBy(timestep).agg(F.min(sigma).alias("_sigma"), F.count("*").alias("_n"))
    found = df.join(known, timestep, "left")
    fault = F.concat(F.lit("not one noise level for timestep "), F.col(timestep).cast("string"))
    return found.withColumn(sigma, F.when(F.col("_n") == 1, F.col("_sigma")).otherwise(F.raise_error(fault))).drop("_sigma", "_n")
