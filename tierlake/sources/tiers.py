"""Tier tables: one Parquet dataset per tier, partitioned by UTC bucket date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlake.functions.buckets import utc_date
from tierlake.schemas import AGGREGATES, DAY_MS, SAMPLES, SERIES, TIER_ORDER
from tierlake.session import remove_path

# Codecs a tier may be written with.
CODECS = ["none", "snappy", "zstd", "lz4", "gzip"]

SAMPLE_FILES = T.StructType(SAMPLES.fields + [T.StructField("sample_date", T.DateType())])


def utc_day(ms: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(days=ms // DAY_MS)


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet dataset; only a missing path reads as no rows."""
    df = read_if_there(spark, path, schema)
    return spark.createDataFrame([], schema) if df is None else df


def scan_tier(
    spark: SparkSession, root: str, tier: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """Aggregates of a tier whose bucket starts in [start_ms, end_ms]; each bound is optional.

    The date bounds prune partitions, the millisecond bounds reach the file reader.
    """
    df = read_or_empty(spark, f"{root}/{tier}", AGGREGATES)
    if start_ms is not None:
        df = df.where(F.col("bucket_date") >= F.lit(utc_day(start_ms))).where(F.col("bucket_start") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("bucket_date") <= F.lit(utc_day(end_ms))).where(F.col("bucket_start") <= end_ms)
    return df


def stored_dates(spark: SparkSession, path: str) -> dict[dt.date, set[str]]:
    """Names of the files of each date of a dataset, from a listing of its folders."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*_date=*/*.parquet")
    listed = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    found: dict[dt.date, set[str]] = {}
    for status in listed or []:
        file = status.getPath()
        day = file.getParent().getName().partition("=")[2]
        found.setdefault(dt.date.fromisoformat(day), set()).add(file.getName())
    return found


def drop_dates(spark: SparkSession, path: str, column: str, days: Iterable[dt.date]) -> None:
    for day in days:
        remove_path(spark, f"{path}/{column}={day.isoformat()}")


def _replace(rows: DataFrame, path: str, column: str, order: list[str], codec: str, cleared: Iterable[dt.date] | None) -> None:
    """Replace the dates that occur in the rows, and remove those of `cleared` that don't.

    Rebalancing by date keeps files few for small dates, and the adaptive plan
    splits a date that is too large for one task.  A date of `cleared` that
    keeps one of its files was not written: nothing is left of it.
    """
    spark = rows.sparkSession
    wanted = None if cleared is None else set(cleared)
    before = {} if wanted is None else {d: files for d, files in stored_dates(spark, path).items() if d in wanted}
    (
        rows.hint("rebalance", column)
        .sortWithinPartitions(column, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec)
        .partitionBy(column)
        .parquet(path)
    )
    if before:
        after = stored_dates(spark, path)
        drop_dates(spark, path, column, [d for d, files in before.items() if files & after.get(d, set())])


def days_between(start_ms: int, end_ms: int) -> list[dt.date]:
    """The dates that begin in [start_ms, end_ms)."""
    return [utc_day(ms) for ms in range(-(-start_ms // DAY_MS) * DAY_MS, end_ms, DAY_MS)]


def write_tier(
    df: DataFrame, root: str, tier: str, codec: str = "zstd", replaces: tuple[int, int] | None = None
) -> str:
    """Write aggregates, replacing the bucket dates that occur in the input.

    replaces is the range [start, end) that the input is all of: its dates
    without a row are removed.  Without it only dates with rows change.
    """
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    path = f"{root}/{tier}"
    missing = [f for f in AGGREGATES.fields if f.name not in df.columns and f.name != "bucket_date"]
    full = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).withColumn(
        "bucket_date", utc_date("bucket_start")
    )
    cleared = None if replaces is None else days_between(*replaces)
    _replace(full.select(AGGREGATES.fieldNames()), path, "bucket_date", [*SERIES, "bucket_start"], codec, cleared)
    return path


def rewrite_dates(spark: SparkSession, root: str, name: str, rows: DataFrame, days: Iterable[dt.date], codec: str = "zstd") -> None:
    """Put rows of a tier, or of the raw samples, in place of all rows of some of its dates.

    The rows may come from these dates themselves: a dynamic overwrite stages its files and takes away those of before
    only once all rows are written, so they move once and need no copy aside.
    """
    column, order = ("sample_date", "timestamp_ms") if name == "samples" else ("bucket_date", "bucket_start")
    _replace(rows, f"{root}/{name}", column, [*SERIES, order], codec, days)


EDGES = "name string, edge_ms bigint"


def record_edges(spark: SparkSession, root: str, edges: dict[str, int]) -> None:
    """Note up to when data has been dropped, by tier, or samples for the raw samples."""
    spark.createDataFrame(list(edges.items()), EDGES).coalesce(1).write.mode("append").parquet(f"{root}/retention_edges")


def retention_edge(spark: SparkSession, root: str, name: str) -> int | None:
    """Before this time a tier, or the raw samples, may be incomplete; None if nothing was ever dropped."""
    edges = read_or_empty(spark, f"{root}/retention_edges", EDGES)
    return edges.where(F.col("name") == name).agg(F.max("edge_ms")).first()[0]


def write_samples(df: DataFrame, root: str, codec: str = "zstd") -> str:
    """Append raw samples below their UTC date."""
    path = f"{root}/samples"
    (
        df.select(SAMPLES.fieldNames())
        .withColumn("sample_date", utc_date("timestamp_ms"))
        .hint("rebalance", "sample_date")
        .sortWithinPartitions("sample_date", *SERIES, "timestamp_ms")
        .write.mode("append")
        .option("compression", codec)
        .partitionBy("sample_date")
        .parquet(path)
    )
    return path


def scan_samples(
    spark: SparkSession, root: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """Raw samples with a timestamp in [start_ms, end_ms]."""
    df = read_or_empty(spark, f"{root}/samples", SAMPLE_FILES)
    if start_ms is not None:
        df = df.where(F.col("sample_date") >= F.lit(utc_day(start_ms))).where(F.col("timestamp_ms") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("sample_date") <= F.lit(utc_day(end_ms))).where(F.col("timestamp_ms") <= end_ms)
    return df


def sample_span(spark: SparkSession, root: str) -> tuple[int | None, int | None]:
    """First and last millisecond of the stored raw samples; reads their times only."""
    row = scan_samples(spark, root).agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b")).first()
    return row["a"], row["b"]


def tier_stats(spark: SparkSession, root: str) -> DataFrame:
    """Rows, series, oldest and newest bucket, files and bytes per tier and date."""
    parts = []
    for tier in TIER_ORDER:
        rows = read_if_there(spark, f"{root}/{tier}", AGGREGATES)
        if rows is None:
            continue
        # First per file and series, then per date: both distinct counts become sums.
        per_file = rows.groupBy("bucket_date", "_metadata.file_path", *SERIES).agg(
            F.count("*").alias("rows"),
            F.min("bucket_start").alias("oldest"),
            F.max("bucket_end").alias("newest"),
            F.max("_metadata.file_size").alias("file_size"),
        )
        by_series = per_file.groupBy("bucket_date", *SERIES).agg(
            F.sum("rows").alias("rows"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest")
        )
        by_file = per_file.groupBy("bucket_date", "file_path").agg(F.max("file_size").alias("file_size"))
        dates = by_series.groupBy("bucket_date").agg(
            F.sum("rows").alias("rows"),
            F.count("*").alias("series"),
            F.min("oldest").alias("oldest"),
            F.max("newest").alias("newest"),
        )
        files = by_file.groupBy("bucket_date").agg(
            F.count("*").alias("files"), F.sum("file_size").alias("bytes")
        )
        parts.append(dates.join(files, "bucket_date").select(F.lit(tier).alias("tier"), "*"))
    if not parts:
        return spark.createDataFrame(
            [],
            "tier string, bucket_date date, rows bigint, series bigint, oldest bigint, newest bigint, "
            "files bigint, bytes bigint",
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adhoc_sql(spark: SparkSession, root: str, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over the tiers (agg_raw, agg_5min, ...), the raw samples (agg_samples) and given tables."""
    for tier in TIER_ORDER:
        scan_tier(spark, root, tier).createOrReplaceTempView(f"agg_{tier}")
    scan_samples(spark, root).createOrReplaceTempView("agg_samples")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
