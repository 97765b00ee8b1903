"""Health of each series after every poll."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.operators import chunks
from tierlake.schemas import SERIES

STATE = "namespace string, target string, poller string, consecutive_failures bigint, last_error string, " \
    "last_poll_at bigint, last_success_at bigint, last_failure_at bigint"


def health_of(failures: Column, down_after: int = 3) -> Column:
    return (
        F.when(failures.isNull(), "unknown")
        .when(failures == 0, "up")
        .when(failures < down_after, "degraded")
        .otherwise("down")
    )


def health_timeline(
    samples: DataFrame,
    down_after: int = 3,
    carry: DataFrame | None = None,
    chunk_ms: int = chunks.CHUNK_MS,
    enter: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """State of each series after every poll, and before it.

    A good poll gives up and ends the run of failures; a failure gives
    degraded, and down from the down_after-th in a row.  carry holds the
    state of earlier days or batches as health_current returns it.  In its
    place, enter may hold the state of a series: it gets what its chunks do
    (series, _chunk, _n failures, _m failures up to the latest success, _s and
    _f latest success and failure, polled and error of the latest poll), and
    returns the state before each (_open failures, _cs, _cf).
    """
    polls = samples.select(*SERIES, "timestamp_ms", "seq", "valid", "error")
    rows = chunks.with_chunk(polls, "timestamp_ms", chunk_ms)
    ordered = chunks.inside(SERIES, "timestamp_ms", "seq")
    so_far = chunks.running(ordered)
    before = ordered.rowsBetween(chunks.Window.unboundedPreceding, -1)
    good = F.col("valid")
    local = rows.withColumns(
        {
            "_fails": F.sum(F.when(good, 0).otherwise(1)).over(so_far),
            "_first": F.row_number().over(ordered) == 1,
        }
    ).withColumns(
        {
            # Failures counted when the latest success before this poll came; NULL if there was none.
            "_prev_mark": F.max(F.when(good, F.col("_fails"))).over(before),
            "_success": F.max(F.when(good, F.col("timestamp_ms"))).over(so_far),
            "_failure": F.max(F.when(~good, F.col("timestamp_ms"))).over(so_far),
        }
    )
    local = local.withColumns(
        {
            "_mark": F.when(good, F.col("_fails")).otherwise(F.col("_prev_mark")),
            "_prev_fails": F.when(~F.col("_first"), F.col("_fails") - F.when(good, 0).otherwise(1)),
        }
    )
    done = [F.max(c).alias(n) for c, n in (("_fails", "_n"), ("_mark", "_m"), ("_success", "_s"), ("_failure", "_f"))]
    if enter is not None:
        text = F.when(good, "").otherwise(F.coalesce("error", F.lit("")))
        newest = [F.max("timestamp_ms").alias("polled"), F.max_by(text, F.struct("timestamp_ms", "seq")).alias("error")]
        carried = enter(local.groupBy(*SERIES, chunks.CHUNK).agg(*done, *newest))
    else:
        carried = _carried(local.groupBy(*SERIES, chunks.CHUNK).agg(*done), carry)
    joined = chunks.with_carry(local, carried, SERIES)
    open_run = F.coalesce("_open", F.lit(0))
    run = F.when(F.col("_mark").isNotNull(), F.col("_fails") - F.col("_mark")).otherwise(F.col("_fails") + open_run)
    run_before = (
        F.when(F.col("_prev_mark").isNotNull(), F.col("_prev_fails") - F.col("_prev_mark"))
        .when(F.col("_prev_fails").isNotNull(), F.col("_prev_fails") + open_run)
        .otherwise(F.col("_open"))
    )
    return joined.select(
        *SERIES,
        "timestamp_ms",
        "seq",
        "valid",
        health_of(run_before, down_after).alias("previous"),
        health_of(run, down_after).alias("health"),
        run.alias("consecutive_failures"),
        F.when(F.col("valid"), "").otherwise(F.coalesce("error", F.lit(""))).alias("last_error"),
        F.coalesce("_success", "_cs").alias("last_success_at"),
        F.coalesce("_failure", "_cf").alias("last_failure_at"),
    )


def _carried(summary: DataFrame, carry: DataFrame | None) -> DataFrame:
    """The state of each series before each of its chunks."""
    if carry is not None:
        earlier = carry.where(F.col("last_poll_at").isNotNull()).select(
            *SERIES,
            F.lit(-1).cast("bigint").alias(chunks.CHUNK),
            F.col("consecutive_failures").alias("_n"),
            F.when(F.col("last_success_at").isNotNull(), F.lit(0)).cast("bigint").alias("_m"),
            F.col("last_success_at").alias("_s"),
            F.col("last_failure_at").alias("_f"),
        )
        summary = summary.unionByName(earlier)
    past = chunks.earlier_chunks(SERIES)
    return (
        summary.withColumn("_total", F.sum("_n").over(past))
        .withColumn("_abs", F.coalesce("_total", F.lit(0)) + F.col("_m"))
        .select(
            *SERIES,
            chunks.CHUNK,
            # Failures since the last success before the chunk; NULL if it is the first chunk.
            (F.col("_total") - F.coalesce(F.max("_abs").over(past), F.lit(0))).alias("_open"),
            F.max("_s").over(past).alias("_cs"),
            F.max("_f").over(past).alias("_cf"),
        )
    )


def final_state(timeline: DataFrame) -> DataFrame:
    """State after the newest poll of each series that was polled."""
    state = F.struct(
        "health",
        "consecutive_failures",
        "last_error",
        F.col("timestamp_ms").alias("last_poll_at"),
        "last_success_at",
        "last_failure_at",
    )
    newest = F.max_by(state, F.struct("timestamp_ms", "seq")).alias("s")
    return timeline.groupBy(*SERIES).agg(newest).select(*SERIES, "s.*")


def health_current(
    samples: DataFrame,
    pollers: DataFrame | None = None,
    down_after: int = 3,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Final state per series; listed pollers that were never polled are unknown.

    The end of a series needs no order: its newest poll, success and failure
    are aggregates, and the failures after the newest success are counted in
    a second one.
    """
    state = _end_state(samples, down_after, carry)
    if carry is not None:
        state = keep_unseen(state, carry, down_after)
    if pollers is None:
        return state
    names = pollers.select("namespace", "target", F.col("name").alias("poller"))
    return names.join(state, SERIES, "left").withColumns(
        {
            "health": F.coalesce("health", F.lit("unknown")),
            "consecutive_failures": F.coalesce("consecutive_failures", F.lit(0)),
            "last_error": F.coalesce("last_error", F.lit("")),
        }
    )


def _end_state(samples: DataFrame, down_after: int, carry: DataFrame | None) -> DataFrame:
    at, good = F.struct("timestamp_ms", "seq"), F.col("valid")
    text = F.when(good, "").otherwise(F.coalesce("error", F.lit("")))
    newest = samples.groupBy(*SERIES).agg(
        F.max_by(text, at).alias("last_error"),
        F.max("timestamp_ms").alias("last_poll_at"),
        F.max(F.when(good, at)).alias("_success"),
        F.max(F.when(~good, F.col("timestamp_ms"))).alias("_failure"),
    )
    ends = newest.select(*SERIES, "_success")
    run = (
        samples.where(~good)
        .select(*SERIES, at.alias("_at"))
        .join(ends, SERIES)
        .where(F.col("_success").isNull() | (F.col("_at") > F.col("_success")))
        .groupBy(*SERIES)
        .agg(F.count("*").alias("_run"))
    )
    joined = newest.join(run, SERIES, "left")
    before = {"_open": "bigint", "_last_success": "bigint", "_last_failure": "bigint"}
    if carry is None:
        joined = joined.withColumns({c: F.lit(None).cast(t) for c, t in before.items()})
    else:
        known = carry.where(F.col("last_poll_at").isNotNull())
        joined = joined.join(
            known.select(
                *SERIES,
                F.col("consecutive_failures").alias("_open"),
                F.col("last_success_at").alias("_last_success"),
                F.col("last_failure_at").alias("_last_failure"),
            ),
            SERIES,
            "left",
        )
    # A run without a success in it goes on from the one before.
    failures = F.coalesce("_run", F.lit(0)) + F.when(F.col("_success").isNull(), F.coalesce("_open", F.lit(0))).otherwise(0)
    return joined.select(
        *SERIES,
        health_of(failures, down_after).alias("health"),
        failures.alias("consecutive_failures"),
        "last_error",
        "last_poll_at",
        F.coalesce("_success.timestamp_ms", "_last_success").alias("last_success_at"),
        F.coalesce("_failure", "_last_failure").alias("last_failure_at"),
    )


def keep_unseen(state: DataFrame, carry: DataFrame, down_after: int) -> DataFrame:
    """The states of a batch, and those carried of series that it had no poll of."""
    unseen = carry.join(state.select(*SERIES), SERIES, "left_anti")
    if "health" not in carry.columns:
        unseen = unseen.withColumn("health", health_of(F.col("consecutive_failures"), down_after))
    return state.unionByName(unseen.select(state.columns))


def health_transitions(timeline: DataFrame) -> DataFrame:
    """Polls that changed the state, with the old and the new one."""
    return timeline.where(F.col("previous") != F.col("health")).select(
        *SERIES, "timestamp_ms", "seq", F.col("previous").alias("old_state"), F.col("health").alias("new_state")
    )


def reachability_sticky(timeline: DataFrame, unreachable_after: int = 3) -> DataFrame:
    """polling after a good poll, unreachable from the third error in a row, unchanged before that.

    The first errors of a run follow a good poll or the start, both polling,
    so the state follows from the length of the run.
    """
    state = F.when(F.col("consecutive_failures") >= unreachable_after, "unreachable").otherwise("polling")
    return timeline.select(*SERIES, "timestamp_ms", "seq", "valid", state.alias("state"))
