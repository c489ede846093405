"""Per-image errors as expressions over two arrays of values in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAME = 1e-12


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def unit_range(values: Column) -> Column:
    """From [-1, 1] to [0, 1], clamped."""
    return F.transform(values, lambda v: F.least(F.greatest((v.cast("double") + 1) / 2, F.lit(0.0)), F.lit(1.0)))


def signed_range(values: Column) -> Column:
    return F.transform(values, lambda v: v * 2 - 1)


def quantised(values: Column) -> Column:
    """0 to 255, half to even."""
    return F.transform(values, lambda v: F.rint(v * 255).cast("int"))


def mse(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def psnr_of(error: Column, peak: float = 1.0) -> Column:
    """From a mean squared error; 100 if that is next to nothing."""
    return F.when(error <= SAME, F.lit(100.0)).otherwise(20 * F.log10(F.lit(peak)) - 10 * F.log10(error))


def psnr(a: Column, b: Column, peak: float = 1.0) -> Column:
    return psnr_of(mse(a, b), peak)


def l1(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def charbonnier(a: Column, b: Column, eps: float = 1e-3) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.sqrt((x - y) * (x - y) + F.lit(eps * eps))))


def blend(image: Column, noise: Column, sigma: Column) -> Column:
    """(1 - sigma) image + sigma noise"""
    return F.zip_with(image, noise, lambda x, n: (1 - sigma) * x + sigma * n)


def velocity(image: Column, noise: Column) -> Column:
    return F.zip_with(image, noise, lambda x, n: n - x)


def clean(blended: Column, v: Column, sigma: Column) -> Column:
    """The image that a blend and its velocity stand for."""
    return F.zip_with(blended, v, lambda z, d: z - sigma * d)
