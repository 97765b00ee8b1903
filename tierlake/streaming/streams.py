"""Streaming forms of rollup, statistics, health, levels, late audit and delivery.

Windowed and running aggregates use the state of Structured Streaming.  The
operators that need the order of a series run their batch form on every
micro-batch, which cuts a hot series into chunks here as well, and find the
state that a series had before the batch in a keyed state store (see
keyed.py).  A batch that runs again after a failure reads and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierlake.functions.buckets import utc_date
from tierlake.operators.health import health_of, health_timeline
from tierlake.operators.levels import LevelRule, level_hysteresis
from tierlake.operators.live import arrival_lateness, fanout, is_late
from tierlake.operators.rollup import measures, numeric
from tierlake.operators.stats import counted, average_poll_ms
from tierlake.schemas import SAMPLES, SERIES, TIERS
from tierlake.session import remove_path
from tierlake.streaming.keyed import AllowedState, HealthState, Keyed, LevelState, NewestState

WATERMARK = "10 minutes"


def read_samples(spark: SparkSession, path: str, schema=SAMPLES, max_files: int | None = None) -> DataFrame:
    """Sample files as a stream, in order of arrival."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Start with a trigger interval, or drain what is there and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def rollup_stream(samples: DataFrame, tier: str = "5min", watermark: str = WATERMARK) -> DataFrame:
    """Tumbling aggregates per series; a bucket comes out once the watermark has passed its end."""
    width = f"{TIERS[tier].width_ms} milliseconds"
    offset = "4 days" if tier == "weekly" else "0 seconds"
    timed = numeric(samples).withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", watermark)
    grouped = timed.groupBy(F.window("ts", width, startTime=offset), *SERIES).agg(*measures())
    start, end = F.unix_millis("window.start"), F.unix_millis("window.end")
    return grouped.select(
        *SERIES,
        start.alias("bucket_start"),
        end.alias("bucket_end"),
        "count",
        "sum",
        "min",
        "max",
        "avg",
        "first_ts",
        "last_ts",
    )


def stream_rollup(
    samples: DataFrame, path: str, checkpoint: str, tier: str = "5min", watermark: str = WATERMARK, interval: str | None = None
) -> StreamingQuery:
    """Write completed buckets to Parquet, partitioned by date."""
    out = rollup_stream(samples, tier, watermark).withColumn("bucket_date", utc_date("bucket_start"))
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).partitionBy("bucket_date")
    return _start(writer, checkpoint, interval)


# Folders of changes that are merged into one.
MERGED = 8


class Changes:
    """The newest row of each key, kept as the rows that batches changed.

    A batch writes its changed rows only. Eight folders of batches are merged into one, eight of these into one again, and
    so on: a row is written once for each of these levels, however many keys there are that do not change. What a merge
    read is removed by the batch after it, so that a batch can run again.
    """

    def __init__(self, root: str, schema: str, keys: list[str] = SERIES):
        self.root, self.schema, self.keys = root, schema, keys

    def _folder(self, level: int, at: int) -> str:
        return f"{self.root}/{level}/{at:012d}"

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(f"{self.schema}, batch bigint").parquet(*folders)

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch").alias("_row")).select(*self.keys, "_row.*")

    def _merges(self, batch_id: int):
        """Level and place of the folders that are complete with this batch, each from the MERGED before it."""
        level, count = 1, batch_id + 1
        while count % MERGED == 0:
            count //= MERGED
            yield level, count - 1
            level += 1

    def write(self, changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        for level, at in self._merges(batch_id - 1) if batch_id else ():
            for k in range(at * MERGED, (at + 1) * MERGED):
                remove_path(spark, self._folder(level - 1, k))
        rows = changed.withColumn("batch", F.lit(batch_id).cast("bigint"))
        rows.select(*self.columns(), "batch").write.mode("overwrite").parquet(self._folder(0, batch_id))
        for level, at in self._merges(batch_id):
            merged = self._newest(self._read(spark, [self._folder(level - 1, k) for k in range(at * MERGED, (at + 1) * MERGED)]))
            merged.write.mode("overwrite").parquet(self._folder(level, at))

    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]

    def folders(self, last_batch_id: int) -> list[str]:
        """The folders that hold the rows of all batches up to this one: the digits of their number."""
        out, level, count = [], 0, last_batch_id + 1
        while count:
            out += [self._folder(level, k) for k in range(count - count % MERGED, count)]
            level, count = level + 1, count // MERGED
        return out

    def newest(self, spark: SparkSession, last_batch_id: int) -> DataFrame:
        """The newest row of every key."""
        return self._newest(self._read(spark, self.folders(last_batch_id))).select(self.columns())


def _each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None, mode: str = "append") -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            work(batch, batch_id)
        finally:
            batch.unpersist()

    return _start(stream.writeStream.outputMode(mode).foreachBatch(run), checkpoint, interval)


def _append(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the output of a batch to its own folder, replacing an earlier try."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


HEALTH_ROW = "_n bigint, _m bigint, _s bigint, _f bigint, polled bigint, error string"


def stream_health(
    samples: DataFrame, path: str, checkpoint: str, down_after: int = 3, interval: str | None = None
) -> StreamingQuery:
    """Health after every poll, to path/timeline, with the state of each series below path/state."""
    state = Keyed(f"{path}/state", HealthState, HEALTH_ROW)

    def work(batch: DataFrame, batch_id: int) -> None:
        timeline = health_timeline(batch, down_after, enter=lambda summary: state.enter(summary, batch_id))
        _append(timeline, f"{path}/timeline", batch_id)

    return _each_batch(samples, work, checkpoint, interval)


def streamed_health(spark: SparkSession, path: str, down_after: int = 3) -> DataFrame:
    """The state of every series that stream_health has seen, as health_current gives it."""
    found = Keyed(f"{path}/state", HealthState, HEALTH_ROW).states(spark)
    return found.select(
        *SERIES,
        health_of(F.col("failures"), down_after).alias("health"),
        F.col("failures").alias("consecutive_failures"),
        F.col("error").alias("last_error"),
        F.col("polled").alias("last_poll_at"),
        F.col("success").alias("last_success_at"),
        F.col("failure").alias("last_failure_at"),
    )


def stream_levels(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    rule: LevelRule = LevelRule(),
    cooldown_ms: int = 0,
    interval: str | None = None,
) -> StreamingQuery:
    """Level after every sample of (series, timestamp_ms, seq, ratio), to path/levels.

    The level of each series is kept below path/state, and under a cooldown the time of its next evaluation below
    path/cooldown.
    """
    level = Keyed(f"{path}/state", LevelState, "_exits array<int>")
    allowed = Keyed(f"{path}/cooldown", AllowedState, "starts array<bigint>, after array<bigint>")

    def work(batch: DataFrame, batch_id: int) -> None:
        steps = f"{path}/steps"
        levels = level_hysteresis(
            batch,
            rule=rule,
            cooldown_ms=cooldown_ms,
            enter_allowed=lambda runs: allowed.enter(runs, batch_id, "place"),
            enter_level=lambda exits: level.enter(exits, batch_id),
            steps_path=steps,
        )
        _append(levels, f"{path}/levels", batch_id)
        remove_path(batch.sparkSession, steps)

    return _each_batch(rows, work, checkpoint, interval)


def stream_late(
    arrivals: DataFrame, path: str, checkpoint: str, tier: str = "5min", interval: str | None = None
) -> StreamingQuery:
    """Split samples by lateness: path/on_time, and path/late with the lateness; newest buckets below path/state."""
    state = Keyed(f"{path}/state", NewestState, "_newest bigint")

    def work(batch: DataFrame, batch_id: int) -> None:
        judged = arrival_lateness(batch, tier, enter=lambda summary: state.enter(summary, batch_id))
        late = judged.where(is_late()).withColumn("late_by_ms", F.col("newest_before") - F.col("bucket_start"))
        _append(late, f"{path}/late", batch_id)
        _append(judged.where(~is_late()).drop("newest_before"), f"{path}/on_time", batch_id)

    return _each_batch(arrivals, work, checkpoint, interval)


STATS_STATE = (
    "namespace string, target string, poller string, polls_total bigint, polls_success bigint, polls_failed bigint, "
    "polls_timeout bigint, poll_ms_sum bigint, poll_ms_min int, poll_ms_max int, poll_ms_count bigint, poll_ms_avg bigint"
)


def stream_poller_stats(samples: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Running statistics: only the series that a batch changed leave it, as the newest rows of path/snapshot."""
    running = samples.groupBy(*SERIES).agg(*counted()).withColumn("poll_ms_avg", average_poll_ms())
    kept = Changes(f"{path}/snapshot", STATS_STATE)
    return _each_batch(running, kept.write, checkpoint, interval, mode="update")


def stream_fanout(
    samples: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Deliver every sample to its subscribers as rows under path."""
    out = fanout(samples, subscriptions)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, interval)


def stream_ingest_summary(samples: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Counts per micro-batch, one row each under path."""

    def work(batch: DataFrame, batch_id: int) -> None:
        per_series = batch.groupBy(*SERIES).agg(
            F.count("*").alias("received"),
            F.count_if("valid").alias("ingested"),
            F.count_if(~F.col("valid")).alias("invalid"),
            F.count_if(F.col("value_type") == "text").alias("text"),
        )
        _append(
            per_series.agg(
                *[F.sum(c).alias(c) for c in ("received", "ingested", "invalid", "text")],
                F.count("*").alias("series"),
            ),
            path,
            batch_id,
        )

    return _each_batch(samples, work, checkpoint, interval)
