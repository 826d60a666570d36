"""Column expressions: seasonal distance and kernels, guarded statistics, buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seasonloom.config import DOYS


def known(c: Column) -> Column:
    """A number, NaN and null alike being null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def number(c: Column, kind: str = "long") -> Column:
    """A value as a number; null where it is none."""
    return c.try_cast(kind)


def circular_distance(a: Column, b: Column) -> Column:
    """Days between two days of year on the circle of 366."""
    d = F.abs(a - b)
    return F.least(d, DOYS - d)


def shifted_doy(doy: Column, by: Column) -> Column:
    """The day of year by days later, around the circle."""
    return (F.pmod(doy - 1 + by, F.lit(DOYS)) + 1).cast("int")


def kernel_weight(distance: float, h: int, kernel: str) -> float:
    """Weight of a row at a distance of at most h days."""
    if kernel == "Gaussian":
        return math.exp(-(distance**2) / (2 * h * h))
    return (1 - min(distance / h, 1.0) ** 3) ** 3


def kernel_rows(h: int, kernel: str) -> Column:
    """array<struct<delta, w>> of the whole window, as literals."""
    return F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(kernel_weight(abs(d), h, kernel)).alias("w")) for d in range(-h, h + 1)])


def bucket_of(c: Column, buckets: int) -> Column:
    """A location's bucket, 0 to buckets - 1 for negative numbers too."""
    if buckets <= 0:
        raise ValueError("buckets must be positive")
    return F.pmod(c, F.lit(buckets))


def bucket_name(c: Column, buckets: int) -> Column:
    """A bucket with four digits at least, as folder names have it; null for null."""
    return F.when(c.isNotNull(), F.format_string("%04d", bucket_of(c, buckets)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the group's pairs without nulls; null below two pairs or without variance."""
    n = F.sum((x.isNotNull() & y.isNotNull()).cast("double"))
    mean_x, mean_y = F.avg(F.when(y.isNotNull(), x)), F.avg(F.when(x.isNotNull(), y))
    cov = F.avg(x * y) - mean_x * mean_y
    var_x = F.avg(F.when(y.isNotNull(), x * x)) - mean_x * mean_x
    var_y = F.avg(F.when(x.isNotNull(), y * y)) - mean_y * mean_y
    flat = (n < 2) | (var_x <= 1e-12 * F.abs(F.avg(F.when(y.isNotNull(), x * x)))) | (var_y <= 1e-12 * F.abs(F.avg(F.when(x.isNotNull(), y * y))))
    return F.when(~flat, F.try_divide(cov, F.sqrt(var_x * var_y)))


def cosine(x: Column, y: Column) -> Column:
    """Uncentred cosine over the group's pairs without nulls; null if a vector is zero."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.sum(x * y), F.sqrt(F.sum(F.when(both, x * x)) * F.sum(F.when(both, y * y))))
