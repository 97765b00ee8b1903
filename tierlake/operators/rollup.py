"""Rollups: samples to aggregates, finer aggregates to coarser ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.functions.buckets import tier_bucket
from tierlake.functions.sketch import ALPHA, bin_code, finite
from tierlake.operators.quantiles import QUANTILES, Measure, finish_bins, percentiles_exact
from tierlake.schemas import AGGREGATES, DAY_MS, FIRST_MONDAY_MS, SERIES, TIER_ORDER, TIERS, WEEK_MS
from tierlake.session import passing
from tierlake.sources.polls import sample_value
from tierlake.sources.tiers import read_if_there, retention_edge, scan_samples, scan_tier, write_tier

BUCKET = ["bucket_start", "bucket_end"]


def valid_only(samples: DataFrame) -> DataFrame:
    return samples.where("valid")


def numeric(samples: DataFrame) -> DataFrame:
    """Valid samples with a finite number, as a column value; text does not aggregate."""
    return valid_only(samples).withColumn("value", sample_value()).where(finite(F.col("value")))


def measures() -> list:
    return [
        F.count("*").alias("count"),
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum("value") / F.count("*")).alias("avg"),
        F.min("timestamp_ms").alias("first_ts"),
        F.max("timestamp_ms").alias("last_ts"),
    ]


def rollup_values(rows: DataFrame, tier: str, percentiles: bool | str = False, alpha: float = ALPHA) -> DataFrame:
    """Aggregates of rows that already carry a numeric column value."""
    start, end = tier_bucket("timestamp_ms", tier)
    keys = [*SERIES, *BUCKET]
    bucketed = rows.withColumns({"bucket_start": start, "bucket_end": end})
    if not percentiles:
        return bucketed.groupBy(*keys).agg(*measures())
    if percentiles == "exact":
        return _with_exact_percentiles(bucketed, keys)
    # Aggregate by bin first: a hot bucket is spread over its bins, and the
    # second step sees one row per bin.
    bins = bucketed.groupBy(*keys, bin_code(F.col("value"), alpha).alias("_bin")).agg(*measures())
    return finish_bins(bins.withColumn("_n", F.col("count")), keys, merged_measures(), alpha=alpha)


def _with_exact_percentiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    riding = [
        Measure("count", F.count("*"), F.sum),
        Measure("sum", F.sum("value"), F.sum, ("value",)),
        Measure("min", F.min("value"), F.min, ("value",)),
        Measure("max", F.max("value"), F.max, ("value",)),
        Measure("first_ts", F.min("timestamp_ms"), F.min, ("timestamp_ms",)),
        Measure("last_ts", F.max("timestamp_ms"), F.max, ("timestamp_ms",)),
    ]
    return percentiles_exact(rows, keys, "value", QUANTILES, riding).withColumn("avg", F.col("sum") / F.col("count"))


def rollup_samples(samples: DataFrame, tier: str = "5min", percentiles: bool | str = False, alpha: float = ALPHA) -> DataFrame:
    """Aggregates per series and tier bucket over valid numeric samples.

    percentiles: False for none, True for the mergeable relative-error sketch
    and the p columns derived from it, "exact" for interpolated percentiles.
    """
    return rollup_values(numeric(samples), tier, percentiles, alpha)


def merged_measures() -> list:
    return [
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        (F.sum("sum") / F.sum("count")).alias("avg"),
        # Zero means that no first timestamp is known.
        F.min(F.nullif(F.col("first_ts"), F.lit(0))).alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    ]


def merge_aggregates(aggs: DataFrame, tier: str, percentiles: bool = False, alpha: float = ALPHA) -> DataFrame:
    """Aggregates of a coarser tier from a finer one; sketches merge bin by bin."""
    start, end = tier_bucket("bucket_start", tier)
    keys = [*SERIES, *BUCKET]
    moved = aggs.withColumns({"bucket_start": start, "bucket_end": end})
    if not percentiles:
        return moved.groupBy(*keys).agg(*merged_measures())
    # One row per bin of the sketch; the measures ride on the first of them.
    numbers = ["count", "sum", "min", "max", "first_ts", "last_ts"]
    spread = moved.select(*keys, *numbers, F.posexplode_outer("sketch").alias("_pos", "_bin", "_n"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    spread = spread.withColumns({c: F.when(first, F.col(c)) for c in numbers})
    bins = spread.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"), *merged_measures())
    return finish_bins(bins, keys, merged_measures(), alpha=alpha)


def aggregate_span(samples: DataFrame, start_ms: int, end_ms: int, percentiles: bool = False) -> DataFrame:
    """One row per series over a whole span, both ends included."""
    rows = numeric(samples).where(F.col("timestamp_ms").between(start_ms, end_ms))
    out = _with_exact_percentiles(rows, SERIES) if percentiles else rows.groupBy(*SERIES).agg(*measures())
    return out.withColumns(
        {"bucket_start": F.lit(start_ms).cast("bigint"), "bucket_end": F.lit(end_ms).cast("bigint")}
    )


def _whole_partitions(tier: str, start_ms: int, end_ms: int) -> tuple[int, int]:
    """Widen [start, end) to whole buckets and whole dates, as a write replaces dates."""
    width = max(TIERS[tier].width_ms, DAY_MS)
    offset = FIRST_MONDAY_MS if width == WEEK_MS else 0
    low = (start_ms - offset) // width * width + offset
    high = -((offset - end_ms) // width) * width + offset
    return low, high


def compact(spark: SparkSession, root: str, src: str, dst: str, start_ms: int, end_ms: int) -> tuple[int, int]:
    """Recompute one tier from the tier below for [start_ms, end_ms); running it twice changes nothing.

    Buckets that no longer have a sample go.  Buckets that begin before the
    source's retention edge stay as they are, since their source may be gone.
    Returns the range that was asked for, in whole dates and buckets.
    """
    if TIER_ORDER.index(src) >= TIER_ORDER.index(dst):
        raise ValueError("the target tier must be coarser than the source tier")
    low, high = _whole_partitions(dst, start_ms, end_ms)
    if read_if_there(spark, f"{root}/{src}", AGGREGATES) is not None:
        edge = retention_edge(spark, root, src)
        _rebuild(
            spark, root, dst, low, high, edge,
            lambda first: merge_aggregates(scan_tier(spark, root, src, first, high - 1), dst, percentiles=True),
        )
    return low, high


def _rebuild(
    spark: SparkSession, root: str, tier: str, low: int, high: int, edge: int | None, compute: Callable[[int], DataFrame]
) -> None:
    """Replace the buckets of [low, high) by what compute makes of the source from a time on.

    The source is complete from edge on; buckets before it are kept, on the
    date of the edge beside the computed ones.
    """
    if edge is None or edge <= low:
        write_tier(compute(low), root, tier, replaces=(low, high))
        return
    if edge >= high:
        return
    first, _ = _whole_partitions(tier, edge, edge + 1)
    kept = scan_tier(spark, root, tier, first, edge - 1).drop("bucket_date")
    with passing(spark, kept, "kept") as earlier:
        later = compute(edge).where(F.col("bucket_start") >= edge)
        write_tier(later.unionByName(earlier, allowMissingColumns=True), root, tier, replaces=(first, high))


def ingest_range(spark: SparkSession, root: str, start_ms: int, end_ms: int, tiers=("raw", "5min")) -> None:
    """Roll the raw samples of [start_ms, end_ms) up into the finest tiers."""
    for tier in tiers:
        low, high = _whole_partitions(tier, start_ms, end_ms)
        edge = retention_edge(spark, root, "samples")
        _rebuild(
            spark, root, tier, low, high, edge,
            lambda first: rollup_samples(scan_samples(spark, root, first, high - 1), tier, percentiles=True),
        )


def run_cascade(spark: SparkSession, root: str, start_ms: int, end_ms: int) -> None:
    """Raw samples to every tier for [start_ms, end_ms), each tier from the one below."""
    ingest_range(spark, root, start_ms, end_ms)
    for src, dst in zip(TIER_ORDER[1:], TIER_ORDER[2:]):
        # A week that reaches over the range is read whole from the tier below.
        start_ms, end_ms = compact(spark, root, src, dst, start_ms, end_ms)
