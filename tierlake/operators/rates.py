"""Counters to per-second rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.operators import chunks
from tierlake.operators.rollup import rollup_values, valid_only
from tierlake.schemas import COUNTER_TYPE, SERIES

# A 100 Gbit/s link counted in bytes: a faster wrap is taken for a reset.
MAX_RATE = 12_500_000_000.0


def counter_rate(
    samples: DataFrame, wrap_bits: int = 64, max_rate: float = MAX_RATE, chunk_ms: int = chunks.CHUNK_MS
) -> DataFrame:
    """Rate of each counter sample against the one before it in its series.

    A decrease counts as a wrap when the wrapped rate stays within max_rate,
    else as a reset without a rate.  The first sample of a series has none.
    """
    if wrap_bits not in (32, 64):
        raise ValueError("wrap_bits must be 32 or 64")
    counters = valid_only(samples).where((F.col("value_type") == "counter") & F.col("value_counter").isNotNull())
    points = counters.select(*SERIES, "timestamp_ms", "seq", "value_counter")
    rows = chunks.with_chunk(points, "timestamp_ms", chunk_ms)
    point = F.struct("timestamp_ms", "seq", "value_counter")
    within = chunks.inside(SERIES, "timestamp_ms", "seq")
    before = F.lag(point).over(within)
    last = rows.groupBy(*SERIES, chunks.CHUNK).agg(F.max(point).alias("_last"))
    carry = last.select(
        *SERIES,
        chunks.CHUNK,
        F.last("_last").over(chunks.earlier_chunks(SERIES)).alias("_carry"),
    )
    joined = chunks.with_carry(rows.withColumn("_before", before), carry, SERIES).withColumn(
        "_prev", F.coalesce("_before", "_carry")
    )
    change = F.col("value_counter") - F.col("_prev.value_counter")
    elapsed = F.col("timestamp_ms") - F.col("_prev.timestamp_ms")
    modulus = F.lit(str(2**wrap_bits)).cast("decimal(21,0)")
    stepped = joined.select(
        *SERIES,
        "timestamp_ms",
        "seq",
        "value_counter",
        elapsed.alias("elapsed_ms"),
        change.alias("_change"),
        (change + modulus).alias("_wrapped"),
    )
    seconds = F.col("elapsed_ms") / F.lit(1000.0)
    moving = F.col("elapsed_ms") > 0
    wrapped_rate = F.when(moving, F.col("_wrapped").cast("double") / seconds)
    kind = (
        F.when(F.col("elapsed_ms").isNull(), "first")
        .when(~moving, "same_time")
        .when(F.col("_change") >= 0, "step")
        .when(wrapped_rate <= max_rate, "wrap")
        .otherwise("reset")
    )
    delta = F.when(F.col("kind") == "step", F.col("_change")).when(F.col("kind") == "wrap", F.col("_wrapped"))
    return (
        stepped.withColumn("kind", kind)
        .withColumn("delta", delta.cast(COUNTER_TYPE))
        .withColumn("rate", F.when(moving, F.col("delta").cast("double") / seconds))
        .drop("_change", "_wrapped")
    )


def rate_rollup(
    samples: DataFrame,
    tier: str = "5min",
    wrap_bits: int = 64,
    max_rate: float = MAX_RATE,
    percentiles: bool | str = False,
    chunk_ms: int = chunks.CHUNK_MS,
) -> DataFrame:
    """Aggregates of counter rates per tier bucket."""
    rates = counter_rate(samples, wrap_bits, max_rate, chunk_ms)
    return rollup_values(rates.where(F.col("rate").isNotNull()).withColumn("value", F.col("rate")), tier, percentiles)
