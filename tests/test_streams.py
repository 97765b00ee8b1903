"""Each stream against its batch twin, over several micro-batches and restarts."""

import os

import pytest
from data import rows
from pyspark.sql import functions as F

from tierlake.operators.levels import level_hysteresis
from tierlake.operators import health, levels, live, rollup, stats
from tierlake.plans import store, streams as plans
from tierlake.schemas import SERIES
from tierlake.session import scratch_path
from tierlake.sources import demo
from tierlake.streaming import keyed, streams


def test_rollup_emits_closed_buckets_only(spark, sf):
    def drained(kind, slices):
        return plans.drain(spark, sf, kind, lambda s, o, c: streams.stream_rollup(s, o, c, "hourly"), slices)

    whole = rollup.rollup_samples(demo.samples(spark, sf, "nation"), "hourly")
    columns = [*SERIES, "bucket_start", "bucket_end", "count", "min", "max", "first_ts", "last_ts"]
    every, done = rows(whole, *columns), rows(spark.read.parquet(drained("nation", store.SLICES)), *columns)
    assert 0 < len(done) < len(every) and set(done) <= set(every)
    # Markers move the watermark past the last bucket: the sink alone then holds every bucket.
    closed = spark.read.parquet(drained("marked", store.SLICES + 2)).where(F.col("namespace") != store.MARKER)
    assert rows(closed, *columns) == every


def test_markers_close_the_last_bucket(spark, sf):
    """The sink alone holds every bucket; a sink that a stream never wrote to fails the comparison."""
    columns = [*SERIES, "bucket_start", "count"]
    want = rows(rollup.rollup_samples(demo.samples(spark, sf, "nation")), *columns)
    got = plans.stream_rollup_5min(spark, sf)
    assert rows(got, *columns) == want
    assert rows(got.limit(0), *columns) != want


def test_weekly_windows_begin_on_monday(spark, sf):
    out = plans.drain(spark, sf, "nation", lambda s, o, c: streams.stream_rollup(s, o, c, "weekly"))
    whole = rollup.rollup_samples(demo.samples(spark, sf, "nation"), "weekly")
    columns = [*SERIES, "bucket_start", "bucket_end", "count"]
    done = set(rows(spark.read.parquet(out), *columns))
    assert done and done <= set(rows(whole, *columns))


def test_health_state_is_the_batch_state(spark, sf):
    out = plans.drain(spark, sf, "health", lambda s, o, c: streams.stream_health(s, o, c))
    batch = health.health_timeline(demo.health_samples(spark, sf))
    assert rows(spark.read.parquet(f"{out}/timeline"), *batch.columns) == rows(batch, *batch.columns)
    state, final = streams.streamed_health(spark, out), health.final_state(batch)
    assert rows(state, *final.columns) == rows(final, *final.columns)


@pytest.mark.parametrize("cooldown", [0, 5 * 3_600_000])
def test_levels(spark, sf, cooldown):
    def start(source, out, checkpoint):
        return streams.stream_levels(source.withColumn("ratio", F.col("poll_ms") / 100), out, checkpoint, cooldown_ms=cooldown)

    out = plans.drain(spark, sf, "health", start)
    ratios = demo.health_samples(spark, sf).withColumn("ratio", F.col("poll_ms") / 100)
    batch = levels.level_hysteresis(ratios, cooldown_ms=cooldown)
    assert rows(spark.read.parquet(f"{out}/levels"), *batch.columns) == rows(batch, *batch.columns)


def test_statistics_snapshot(spark, sf):
    out = plans.drain(spark, sf, "customer", lambda s, o, c: streams.stream_poller_stats(s, o, c))
    state = streams.Changes(f"{out}/snapshot", streams.STATS_STATE).newest(spark, store.SLICES - 1)
    batch = stats.poller_stats(demo.samples(spark, sf, "customer"))
    assert rows(state, *batch.columns) == rows(batch, *batch.columns)


def test_late_and_on_time_make_the_whole(spark, sf):
    out = plans.drain(spark, sf, "arrivals", lambda s, o, c: streams.stream_late(s, o, c))
    late, good = spark.read.parquet(f"{out}/late"), spark.read.parquet(f"{out}/on_time")
    batch = live.late_audit(demo.arrivals(spark, sf))
    assert rows(late, "seq", "late_by_ms") == rows(batch, "seq", "late_by_ms")
    assert late.count() + good.count() == demo.arrivals(spark, sf).count()


def chunk_rows(spark, *found):
    columns = "namespace string, target string, poller string, _chunk bigint, _newest bigint"
    return spark.createDataFrame([("n", t, "p", c, v) for t, c, v in found], columns)


def newest_state(spark):
    return keyed.Keyed(scratch_path(spark, "keyed"), keyed.NewestState, "_newest bigint")


def entered(df):
    return sorted((r["target"], r["_chunk"], r["_carry"]) for r in df.collect())


def test_keyed_state_over_batches(spark):
    """Chunks of a series are taken in order, each with the state before it; a repeated batch is not taken twice."""
    state = newest_state(spark)
    first = state.enter(chunk_rows(spark, ("a", 2, 50), ("a", 1, 70), ("b", 1, None)), 0)
    assert entered(first) == [("a", 1, None), ("a", 2, 70), ("b", 1, None)]
    again = chunk_rows(spark, ("a", 9, 60), ("c", 9, 5))
    assert entered(state.enter(again, 1)) == entered(state.enter(again, 1)) == [("a", 9, 70), ("c", 9, None)]
    assert entered(state.enter(chunk_rows(spark, ("c", 10, 1), ("b", 10, 2)), 2)) == [("b", 10, None), ("c", 10, 5)]
    assert sorted((r["target"], r["newest"]) for r in state.states(spark).collect()) == [("a", 70), ("b", 2), ("c", 5)]
    # Another process that goes on from the same folders.
    other = keyed.Keyed(state.root, keyed.NewestState, "_newest bigint")
    assert entered(other.enter(chunk_rows(spark, ("a", 11, 1)), 3)) == [("a", 11, 70)]


def test_a_batch_that_failed_before_its_state(spark):
    """The rows of a batch were written, and nothing more: the repeated batch goes on from there."""
    state = newest_state(spark)
    state.enter(chunk_rows(spark, ("a", 1, 7)), 0)
    rows_of_batch = spark.createDataFrame([("n", "a", "p", 1, 2, 9)], "namespace string, target string, poller string, batch bigint, place bigint, newest bigint")
    rows_of_batch.write.parquet(f"{state.root}/chunks/{1:012d}")
    assert entered(state.enter(chunk_rows(spark, ("a", 2, 9)), 1)) == [("a", 2, 7)]
    assert entered(state.enter(chunk_rows(spark, ("a", 3, 1)), 2)) == [("a", 3, 9)]


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_a_batch_writes_what_it_changes(spark):
    """A batch of two series among 4 000 writes little, in the keyed state as in the statistics."""
    many = spark.range(4_000).select(
        F.lit("n").alias("namespace"), F.concat(F.lit("t"), "id").alias("target"), F.lit("p").alias("poller"),
        F.lit(1).cast("bigint").alias("_chunk"), F.col("id").alias("_newest"),
    )
    state = newest_state(spark)
    state.enter(many, 0)
    whole = size_of(state.root)
    state.enter(chunk_rows(spark, ("t7", 2, 90_000), ("x", 2, 1)), 1)
    assert size_of(state.root) - whole < whole / 5
    kept = streams.Changes(scratch_path(spark, "changes"), "target string, total bigint", ["target"])
    kept.write(many.select("target", F.col("_newest").alias("total")), 0)
    whole = size_of(kept.root)
    kept.write(spark.createDataFrame([("t7", -1)], "target string, total bigint"), 1)
    assert size_of(kept.root) - whole < whole / 5
    found = {r["target"]: r["total"] for r in kept.newest(spark, 1).collect()}
    assert len(found) == 4_000 and found["t7"] == -1 and found["t8"] == 8


def test_changes_are_merged(spark, monkeypatch):
    """Over many batches the newest rows stay right, few folders are left, and a batch can run again."""
    kept = streams.Changes(scratch_path(spark, "changes"), "target string, total bigint", ["target"])
    want = {}
    monkeypatch.setattr(streams, "MERGED", 3)
    for batch in range(20):
        changed = {f"t{batch % 9}": batch, f"t{batch % 4}": batch}
        df = spark.createDataFrame(list(changed.items()), "target string, total bigint").coalesce(1)
        for _ in range(1 + (batch in (2, 3, 8, 9))):
            kept.write(df, batch)
        want |= changed
        if batch in (0, 1, 2, 3, 8, 9, 19):
            assert {r["target"]: r["total"] for r in kept.newest(spark, batch).collect()} == want
    left = sum(len(os.listdir(f"{kept.root}/{level}")) for level in os.listdir(kept.root))
    # 20 batches are two times nine, none of three, and two.
    assert left == len(kept.folders(19)) == 4


def test_levels_from_kept_steps(spark):
    """Rows that are kept while the state is asked for give the levels of rows that are not, and the level before each."""
    ratios = [0.6, 0.45, 0.3, None, 0.99, 0.9, 0.6, 0.1, 0.1, 0.1, 0.82]
    df = spark.createDataFrame([(*"abc", i, i, r) for i, r in enumerate(ratios)], "namespace string, target string, poller string, timestamp_ms bigint, seq bigint, ratio double")
    want = [tuple(r) for r in level_hysteresis(df).orderBy("seq").collect()]
    path = scratch_path(spark, "test-steps")
    kept = level_hysteresis(df, enter_level=lambda exits: exits.select(*df.columns[:3], "_chunk", F.lit(0).alias("_entry_level")), steps_path=path)
    assert [tuple(r) for r in kept.orderBy("seq").collect()] == want
    assert spark.read.parquet(path).count() == len(ratios)
