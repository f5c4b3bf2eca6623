"""Complementary error function and two-sided normal p-values as plain column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F


def erfc(x: Column) -> Column:
    """erfc for x >= 0: an all-positive power series below 3, a continued fraction above.

    Built from the ``aggregate`` higher-order function, so it needs no Python worker.
    """
    square = x * x
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * square / (2.0 * n + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda acc: acc["total"])
    small = 1.0 - 2.0 / math.sqrt(math.pi) * x * F.exp(-square) * series
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / 2.0 / acc)
    large = F.exp(-square) / math.sqrt(math.pi) / fraction
    return F.when(x < 3.0, small).otherwise(large)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def z_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
