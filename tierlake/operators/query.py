"""Range queries over samples and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlake.functions.buckets import bucket_start, floor_to, select_tier, tier_for_span
from tierlake.operators.rollup import aggregate_span
from tierlake.schemas import DAY_MS, SERIES, TIERS
from tierlake.sources.tiers import scan_tier


def filter_samples(
    df: DataFrame,
    ns: str | None = None,
    target: str | None = None,
    poller: str | None = None,
    since_ms: int | None = None,
    until_ms: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Conjunctive filter; an empty or zero argument means any, both time ends are included."""
    for name, value in (("namespace", ns), ("target", target), ("poller", poller)):
        if value:
            df = df.where(F.col(name) == value)
    if since_ms:
        df = df.where(F.col("timestamp_ms") >= since_ms)
    if until_ms:
        df = df.where(F.col("timestamp_ms") <= until_ms)
    return df.orderBy("timestamp_ms", "seq").limit(limit) if limit else df


def display_value() -> Column:
    """Text if set, else the number; the error of an invalid sample."""
    number = F.coalesce(F.col("value_counter").cast("string"), F.col("value_gauge").cast("string"))
    return F.when(~F.col("valid"), F.concat(F.lit("ERROR: "), F.coalesce("error", F.lit("")))).otherwise(
        F.coalesce(F.nullif(F.col("value_text"), F.lit("")), number)
    )


def history(
    samples: DataFrame, ns: str, target: str, poller: str, limit: int | None = None, since_ms: int = 0, until_ms: int = 0
) -> DataFrame:
    """Samples of one series, newest first; all of them unless a limit is given."""
    rows = filter_samples(samples, ns, target, poller, since_ms, until_ms)
    ordered = rows.withColumn("display", display_value()).orderBy(F.desc("timestamp_ms"), F.desc("seq"))
    return ordered.limit(limit) if limit else ordered


def history_all(samples: DataFrame, limit: int, newest_first: bool = True, salts: int = 32) -> DataFrame:
    """The first rows of every series, with their place.

    Each series is cut to its first rows in several salted parts before the
    parts meet, so a hot series never reaches one task whole.
    """
    direction = F.desc if newest_first else F.asc
    order = [direction("timestamp_ms"), direction("seq")]
    salted = samples.withColumn("_salt", F.pmod(F.xxhash64("timestamp_ms", "seq"), F.lit(salts)))
    part = Window.partitionBy(*SERIES, "_salt").orderBy(*order)
    whole = Window.partitionBy(*SERIES).orderBy(*order)
    return (
        salted.withColumn("_place", F.row_number().over(part))
        .where(F.col("_place") <= limit)
        .withColumn("place", F.row_number().over(whole))
        .where(F.col("place") <= limit)
        .withColumn("display", display_value())
        .drop("_salt", "_place")
    )


def _contained(start_ms: int, end_ms: int) -> Column:
    return (F.col("bucket_start") >= start_ms) & (F.col("bucket_end") <= end_ms)


def query_series(
    spark: SparkSession,
    root: str,
    ns: str,
    target: str,
    poller: str,
    start_ms: int,
    end_ms: int,
    limit: int = 0,
    hot: DataFrame | None = None,
    tier: str | None = None,
) -> DataFrame:
    """Buckets of one series fully inside a span, in order, then the hot samples as one row.

    The tier follows from the span unless it is given.  Hot samples that one
    of the buckets holds already are left out.
    """
    tier = tier or tier_for_span(end_ms - start_ms)
    cold = scan_tier(spark, root, tier, start_ms, end_ms).where(_contained(start_ms, end_ms))
    cold = cold.where((F.col("namespace") == ns) & (F.col("target") == target) & (F.col("poller") == poller))
    out = cold.drop("bucket_date", "sketch").withColumn("_part", F.lit(0))
    if hot is not None:
        newer = uncovered(filter_samples(hot, ns, target, poller), cold, tier)
        live = aggregate_span(newer, start_ms, end_ms)
        out = out.unionByName(live.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    out = out.withColumn("tier", F.lit(tier)).orderBy("_part", "bucket_start")
    return (out.limit(limit) if limit else out).drop("_part")


def query_target(
    spark: SparkSession,
    root: str,
    ns: str,
    target: str,
    start_ms: int,
    end_ms: int,
    limit: int = 0,
    tier: str | None = None,
) -> DataFrame:
    """Buckets of all series of a target fully inside a span, by bucket and poller."""
    tier = tier or tier_for_span(end_ms - start_ms)
    rows = scan_tier(spark, root, tier, start_ms, end_ms).where(_contained(start_ms, end_ms))
    rows = rows.where((F.col("namespace") == ns) & (F.col("target") == target)).drop("bucket_date", "sketch")
    out = rows.withColumn("tier", F.lit(tier)).orderBy("bucket_start", "poller")
    return out.limit(limit) if limit else out


# Slot width by tier: a request covers at most about a hundred slots.
_SLOT_MS = {"raw": DAY_MS, "5min": DAY_MS, "hourly": DAY_MS, "daily": 30 * DAY_MS, "weekly": 365 * DAY_MS}


def _day(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("int")


def query_many(tiers: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Answer many span requests (request_id, series, start_ms, end_ms) at once, each from its own tier.

    Requests are spread over the time slots they cover and joined on series
    and slot, which keeps the work of a hot series in many tasks.  Of each tier
    only the dates that a request covers are read.  An empty poller asks for
    all pollers of the target; a request that ends before it starts for nothing.
    """
    routed = requests.withColumn("tier", select_tier("start_ms", "end_ms"))
    answers = []
    for tier, aggs in tiers.items():
        slot_ms = _SLOT_MS[tier]
        covering = routed.where((F.col("tier") == tier) & (F.col("start_ms") <= F.col("end_ms")))
        wanted = covering.withColumn(
            "_slot",
            F.explode(
                F.sequence(
                    floor_to("start_ms", slot_ms), floor_to("end_ms", slot_ms), F.lit(slot_ms).cast("bigint")
                )
            ),
        )
        wanted = wanted.withColumnRenamed("poller", "_poller")
        # The dates that any request covers reach the scan as a filter on its partitions; gaps between requests are not read.
        days = F.sequence(_day(bucket_start("start_ms", tier)), _day(F.col("end_ms")), F.lit(TIERS[tier].width_ms // DAY_MS or 1))
        dates = covering.select(F.explode(days).alias("day")).agg(F.collect_set(F.date_from_unix_date("day")).alias("dates"))
        rows = aggs.where(F.array_contains(dates.scalar(), F.col("bucket_date")))
        rows = rows.withColumn("_slot", floor_to("bucket_start", slot_ms))
        joined = rows.join(wanted, ["namespace", "target", "_slot"]).where(
            (F.col("bucket_start") >= F.col("start_ms"))
            & (F.col("bucket_end") <= F.col("end_ms"))
            & ((F.coalesce("_poller", F.lit("")) == "") | (F.col("_poller") == F.col("poller")))
        )
        answers.append(
            joined.select(
                "request_id", "tier", *SERIES, "bucket_start", "bucket_end", "count", "sum", "min", "max", "avg"
            )
        )
    return reduce(DataFrame.unionByName, answers)


def uncovered(samples: DataFrame, buckets: DataFrame, tier: str) -> DataFrame:
    """Samples whose tier bucket is not among the given buckets of their series."""
    held = buckets.select(*SERIES, F.col("bucket_start").alias("_bucket")).distinct()
    placed = samples.withColumn("_bucket", bucket_start("timestamp_ms", tier))
    return placed.join(held, [*SERIES, "_bucket"], "left_anti").drop("_bucket").select(samples.columns)


def merge_hot(
    cold: DataFrame, hot_samples: DataFrame, start_ms: int, end_ms: int, tier: str, dedupe: bool = True
) -> DataFrame:
    """Cold buckets of a tier and one hot row per series.

    With dedupe, hot samples that a cold bucket of the series already holds
    are left out, bucket by bucket; plain concatenation would count them twice.
    """
    inside_span = cold.where(_contained(start_ms, end_ms))
    hot = uncovered(hot_samples, inside_span, tier) if dedupe else hot_samples
    live = aggregate_span(hot, start_ms, end_ms)
    return inside_span.withColumn("part", F.lit("cold")).unionByName(
        live.withColumn("part", F.lit("hot")), allowMissingColumns=True
    )


def query_preferred(
    spark: SparkSession,
    root: str,
    ns: str,
    target: str,
    start_ms: int,
    end_ms: int,
    poller: str = "",
    tier: str | None = None,
    limit: int = 100,
    cursor: tuple[int, str] | None = None,
) -> DataFrame:
    """One page of a target's buckets, with has_more and the cursor of the next page.

    The cursor is the (bucket_start, poller) of the last row of the page.
    """
    if tier is not None and tier not in TIERS:
        raise ValueError(f"tier must be one of {list(TIERS)}")
    rows = query_target(spark, root, ns, target, start_ms, end_ms, tier=tier)
    if poller:
        rows = rows.where(F.col("poller") == poller)
    if cursor is not None:
        after_ms, after_poller = cursor
        rows = rows.where(
            (F.col("bucket_start") > after_ms)
            | ((F.col("bucket_start") == after_ms) & (F.col("poller") > after_poller))
        )
    # One row more than the page tells whether another page follows; the
    # window sees only these few rows.
    head = rows.orderBy("bucket_start", "poller").limit(limit + 1).withColumn("_all", F.lit(1))
    page = Window.partitionBy("_all").orderBy("bucket_start", "poller")
    numbered = head.withColumns(
        {"place": F.row_number().over(page), "has_more": F.count("*").over(Window.partitionBy("_all")) > limit}
    )
    return (
        numbered.where(F.col("place") <= limit)
        .withColumn(
            "cursor",
            F.when(
                F.col("has_more") & (F.col("place") == limit),
                F.concat_ws("/", F.col("bucket_start").cast("string"), F.col("poller")),
            ),
        )
        .drop("_all")
    )
