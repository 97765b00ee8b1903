"""Counting, trimming and retention of samples and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlake.schemas import DAY_MS, SERIES, TIER_ORDER, TIERS
from tierlake.sources.tiers import (
    drop_dates,
    record_edges,
    rewrite_dates,
    scan_samples,
    scan_tier,
    stored_dates,
    utc_day,
)


def count_samples(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SERIES).agg(F.count("*").alias("samples"))


def sample_range(samples: DataFrame) -> DataFrame:
    """Oldest and newest timestamp and the time covered, per series."""
    return samples.groupBy(*SERIES).agg(
        F.min("timestamp_ms").alias("oldest_ms"),
        F.max("timestamp_ms").alias("newest_ms"),
        (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("covered_ms"),
    )


def latest_sample(samples: DataFrame) -> DataFrame:
    """Newest sample per series; the sequence number decides between equal times."""
    rest = [c for c in samples.columns if c not in SERIES]
    newest = F.max_by(F.struct(*rest), F.struct("timestamp_ms", "seq")).alias("s")
    return samples.groupBy(*SERIES).agg(newest).select(*SERIES, "s.*")


def hot_window(samples: DataFrame, duration_ms: int = 300_000) -> DataFrame:
    """Samples newer than a duration before the newest one."""
    newest = samples.agg((F.max("timestamp_ms") - F.lit(duration_ms)).alias("cutoff"))
    return samples.where(F.col("timestamp_ms") >= newest.scalar())


def trim_latest(samples: DataFrame, keep: int, salts: int = 32) -> DataFrame:
    """Keep the newest samples of each series; rows tied with the last kept time stay.

    Each series is first cut to the newest rows of several salted parts, ties
    included, which also happens before the shuffle.  The time to keep from is
    then found among these few rows.
    """
    salted = samples.withColumn("_salt", F.pmod(F.xxhash64("timestamp_ms", "seq"), F.lit(salts)))
    part = Window.partitionBy(*SERIES, "_salt").orderBy(F.desc("timestamp_ms"))
    whole = Window.partitionBy(*SERIES).orderBy(F.desc("timestamp_ms"))
    newest = salted.withColumn("_place", F.rank().over(part)).where(F.col("_place") <= keep).drop("_place", "_salt")
    cutoff = (
        salted.select(*SERIES, "timestamp_ms", "_salt", F.row_number().over(part).alias("_place"))
        .where(F.col("_place") <= keep)
        .select(*SERIES, "timestamp_ms", F.row_number().over(whole).alias("_place"))
        .where(F.col("_place") <= keep)
        .groupBy(*SERIES)
        .agg(F.min("timestamp_ms").alias("_cutoff"))
    )
    return newest.join(cutoff, SERIES).where(F.col("timestamp_ms") >= F.col("_cutoff")).drop("_cutoff")


def retain_samples(samples: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """Drop samples older than an age; stored samples are also pruned by date."""
    cutoff = now_ms - max_age_ms
    kept = samples.where(F.col("timestamp_ms") >= cutoff)
    if "sample_date" in samples.columns:
        kept = kept.where(F.col("sample_date") >= F.date_from_unix_date(F.lit(cutoff // DAY_MS).cast("int")))
    return kept


def delete_series(samples: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop all samples of the given series."""
    return samples.join(gone.select(*SERIES).distinct(), SERIES, "left_anti")


def retain_stored_samples(spark: SparkSession, root: str, now_ms: int, max_age_ms: int) -> None:
    """Drop stored raw samples older than an age: whole dates by their folder, the date on the edge row by row."""
    cutoff = now_ms - max_age_ms
    record_edges(spark, root, {"samples": cutoff})
    days = stored_dates(spark, f"{root}/samples")
    drop_dates(spark, f"{root}/samples", "sample_date", [d for d in days if d < utc_day(cutoff)])
    if cutoff % DAY_MS and utc_day(cutoff) in days:
        edge = cutoff // DAY_MS * DAY_MS
        rewrite_dates(spark, root, "samples", scan_samples(spark, root, cutoff, edge + DAY_MS - 1), [utc_day(cutoff)])


def delete_series_stored(spark: SparkSession, root: str, gone: DataFrame) -> None:
    """Drop the given series from the stored raw samples and from every tier; only dates that hold them are rewritten."""
    gone = gone.select(*SERIES).distinct()
    for name, date in [("samples", "sample_date"), *((tier, "bucket_date") for tier in TIER_ORDER)]:
        stored = scan_samples(spark, root) if name == "samples" else scan_tier(spark, root, name)
        # One row per date: a listing, not data.
        held = stored.join(gone, SERIES, "left_semi").select(F.unix_date(date).alias("day")).distinct().collect()
        if held:
            days = [utc_day(r["day"] * DAY_MS) for r in held]
            kept = stored.where(F.col(date).isin([F.lit(d) for d in days])).join(gone, SERIES, "left_anti")
            rewrite_dates(spark, root, name, kept.select(stored.columns), days)


def _cutoffs(now_ms: int, policy: dict[str, int] | None) -> dict[str, int]:
    given = policy or {}
    unknown = set(given) - set(TIERS)
    if unknown:
        raise ValueError(f"unknown tiers {sorted(unknown)}")
    return {name: now_ms - given.get(name, tier.retention_ms) for name, tier in TIERS.items()}


def retention_report(
    tiers: dict[str, DataFrame], now_ms: int, policy: dict[str, int] | None = None
) -> DataFrame:
    """Dates and rows each tier would drop and keep; a bucket goes when its end lies before the cutoff."""
    cutoffs = _cutoffs(now_ms, policy)
    out = None
    for tier, df in tiers.items():
        # After the date of the cutoff every bucket stays; these rows are counted without reading a column.
        edge, old = F.lit(utc_day(cutoffs[tier])), F.col("bucket_end") < cutoffs[tier]
        counts = F.count_if(old).alias("drop"), F.count_if(~old).alias("keep")
        early = df.where(F.col("bucket_date") <= edge).groupBy("bucket_date").agg(*counts)
        late = df.where(F.col("bucket_date") > edge).groupBy("bucket_date").agg(F.lit(0).cast("bigint").alias("drop"), F.count("*").alias("keep"))
        # Per date first: the totals are then sums over few rows.
        part = early.unionByName(late).agg(
            F.count_if((F.col("drop") > 0) & (F.col("keep") == 0)).alias("dates_to_drop"),
            F.count_if((F.col("drop") > 0) & (F.col("keep") > 0)).alias("dates_to_cut"),
            F.count_if(F.col("drop") == 0).alias("dates_to_keep"),
            F.coalesce(F.sum("drop"), F.lit(0)).alias("rows_to_drop"),
            F.coalesce(F.sum("keep"), F.lit(0)).alias("rows_to_keep"),
        ).withColumns({"tier": F.lit(tier), "cutoff_ms": F.lit(cutoffs[tier]).cast("bigint")})
        out = part if out is None else out.unionByName(part)
    return out


def retention_apply(
    spark: SparkSession,
    root: str,
    now_ms: int,
    policy: dict[str, int] | None = None,
    dry_run: bool = False,
    exact: bool = False,
    samples_age_ms: int | None = None,
) -> DataFrame:
    """Apply retention to stored tiers and return the report made before it.

    Dates whose buckets have all expired are dropped whole, most of them by
    their folder alone.  With exact, the date on the edge is rewritten with
    the rows that stay.  The cutoffs are recorded, so that later compactions
    know from when on a tier is complete.  samples_age_ms drops raw samples.
    """
    made = retention_report({tier: scan_tier(spark, root, tier) for tier in TIER_ORDER}, now_ms, policy)
    report = spark.createDataFrame(made.collect(), made.schema)  # one row for each tier
    if dry_run:
        return report
    cutoffs = _cutoffs(now_ms, policy)
    record_edges(spark, root, cutoffs)
    for tier, cutoff in cutoffs.items():
        width, path = TIERS[tier].width_ms, f"{root}/{tier}"
        gone, edge = [], []
        for day in stored_dates(spark, path):
            begin = (day - utc_day(0)).days * DAY_MS
            if begin + max(width, DAY_MS) < cutoff:
                gone.append(day)
            elif begin + width < cutoff:
                edge.append(day)
        drop_dates(spark, path, "bucket_date", gone)
        if not edge:
            continue
        rows = scan_tier(spark, root, tier).where(F.col("bucket_date").isin([F.lit(d) for d in edge]))
        stays = rows.where(F.col("bucket_end") >= cutoff)
        if exact or stays.isEmpty():
            rewrite_dates(spark, root, tier, stays, edge)
    if samples_age_ms is not None:
        retain_stored_samples(spark, root, now_ms, samples_age_ms)
    return report
