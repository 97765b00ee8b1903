"""Relative-error bins: an ordered integer code for every double.

A positive value v falls in the bin i with gamma^(i-1) < v <= gamma^i, and
the middle of the bin is within alpha of every value inside it.  Codes are
shifted so that negative values, zero and positive values sort as numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 0.01
# Larger than any bin index of a double for alpha >= 0.001.
SHIFT = 1 << 20


def gamma(alpha: float) -> float:
    if not 0.001 <= alpha < 1:
        raise ValueError("alpha must be at least 0.001 and below 1")
    return (1 + alpha) / (1 - alpha)


def finite(value: Column) -> Column:
    """Whether a number is neither null nor infinite nor NaN, which sorts above infinity."""
    return F.coalesce(F.abs(value) < F.lit(math.inf), F.lit(False))


def bin_code(value: Column, alpha: float = ALPHA) -> Column:
    """Code of a finite value; the callers leave out all others."""
    index = F.ceil(F.log(F.abs(value)) / F.lit(math.log(gamma(alpha)))).cast("int")
    return (
        F.when(value > 0, index + F.lit(SHIFT))
        .when(value < 0, -(index + F.lit(SHIFT)))
        .when(value == 0, F.lit(0))
    )


def bin_value(code: Column, alpha: float = ALPHA) -> Column:
    g = gamma(alpha)
    middle = F.pow(F.lit(g), (F.abs(code) - F.lit(SHIFT)).cast("double")) * F.lit(2 / (g + 1))
    return F.when(code == 0, F.lit(0.0)).otherwise(F.signum(code.cast("double")) * middle)


def sketch_quantile(sketch: Column, q: float, alpha: float = ALPHA) -> Column:
    """Quantile of a map from bin to count: the first bin that passes the rank.

    The map holds one entry for each non-empty bin, so its size is bounded by
    the value range and alpha, not by the number of samples.
    """
    bins = F.array_sort(F.map_entries(sketch))
    total = F.aggregate(F.map_values(sketch), F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    rank = F.floor((total - 1).cast("double") * F.lit(float(q)))
    found = F.aggregate(
        bins,
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bin")),
        lambda acc, e: F.struct(
            (acc["seen"] + e["value"]).alias("seen"),
            F.when(acc["bin"].isNotNull(), acc["bin"])
            .when(acc["seen"] + e["value"] > rank, e["key"])
            .alias("bin"),
        ),
        lambda acc: acc["bin"],
    )
    return bin_value(found, alpha)
