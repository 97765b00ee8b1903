"""Late samples, subscriptions and delivery, in batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.functions.buckets import bucket_start
from tierlake.operators import chunks
from tierlake.operators.tree import path_resolve
from tierlake.schemas import SERIES


def arrival_lateness(
    arrivals: DataFrame,
    tier: str = "5min",
    carry: DataFrame | None = None,
    chunk_ms: int = chunks.CHUNK_MS,
    enter: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """For every sample, the newest bucket its series had reached when it arrived.

    arrivals carries arrival_ms; samples are taken in order of arrival_ms and
    seq.  carry holds newest_bucket per series of earlier batches.  In its
    place, enter may hold the state of a series: it gets the _newest bucket of
    each chunk, and returns that of all chunks before it as _carry.
    """
    rows = chunks.with_chunk(arrivals, "arrival_ms", chunk_ms)
    rows = rows.withColumn("bucket_start", bucket_start("timestamp_ms", tier))
    before = chunks.inside(SERIES, "arrival_ms", "seq").rowsBetween(chunks.Window.unboundedPreceding, -1)
    summary = rows.groupBy(*SERIES, chunks.CHUNK).agg(F.max("bucket_start").alias("_newest"))
    if carry is not None:
        summary = summary.unionByName(
            carry.select(
                *SERIES, F.lit(-1).cast("bigint").alias(chunks.CHUNK), F.col("newest_bucket").alias("_newest")
            )
        )
    newest_before = F.max("_newest").over(chunks.earlier_chunks(SERIES)).alias("_carry")
    carried = summary.select(*SERIES, chunks.CHUNK, newest_before) if enter is None else enter(summary)
    joined = chunks.with_carry(rows.withColumn("_here", F.max("bucket_start").over(before)), carried, SERIES)
    newest = F.greatest("_here", "_carry")
    return joined.withColumn("newest_before", newest).drop("_here", "_carry", chunks.CHUNK)


def is_late():
    return F.coalesce(F.col("bucket_start") < F.col("newest_before"), F.lit(False))


def late_audit(arrivals: DataFrame, tier: str = "5min", chunk_ms: int = chunks.CHUNK_MS) -> DataFrame:
    """Samples that arrived for a bucket older than the newest one seen of their series."""
    return (
        arrival_lateness(arrivals, tier, chunk_ms=chunk_ms)
        .where(is_late())
        .withColumn("late_by_ms", F.col("newest_before") - F.col("bucket_start"))
    )


def without_repeats(subscriptions: DataFrame) -> DataFrame:
    """Each wish once; a subscription to a whole target covers those to its pollers."""
    wishes = subscriptions.select("subscriber", "namespace", "target", F.nullif("poller", F.lit("")).alias("poller"))
    wishes = wishes.distinct()
    keys = ["subscriber", "namespace", "target"]
    whole = wishes.where(F.col("poller").isNull())
    single = wishes.where(F.col("poller").isNotNull())
    return whole.unionByName(single.join(whole.select(keys), keys, "left_anti"))


def fanout(samples: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each sample once for every subscriber of its poller or of its whole target.

    Works on batch samples and on a stream alike; the subscriptions are static.
    """
    wishes = without_repeats(subscriptions).withColumnRenamed("poller", "_poller")
    joined = samples.join(wishes, ["namespace", "target"])
    return joined.where(F.col("_poller").isNull() | (F.col("_poller") == F.col("poller"))).drop("_poller")


def subscriptions_resolve(requests: DataFrame, pollers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Concrete series of requests (subscriber, namespace, target, poller, path).

    A request names a poller, a target with all its pollers, or a path to
    either.  What resolves to nothing comes out once with valid false.
    """
    by_path = F.coalesce("path", F.lit("")) != ""
    asked = requests.select("subscriber", "namespace", "target", F.nullif("poller", F.lit("")).alias("poller"), "path")
    named = asked.where(~by_path).withColumn("request", F.concat_ws("/", "target", F.coalesce("poller", F.lit("*"))))
    walked = path_resolve(asked.where(by_path).drop("target", "poller"), nodes).withColumn("request", F.col("path"))
    columns = ["subscriber", "namespace", "request", "target", "poller"]
    wishes = named.select(columns).unionByName(walked.select(columns)).distinct()
    known = pollers.select("namespace", "target", F.col("name").alias("_poller"))
    match = [
        wishes["namespace"] == known["namespace"],
        wishes["target"] == known["target"],
        wishes["poller"].isNull() | (wishes["poller"] == known["_poller"]),
    ]
    joined = wishes.join(known, match, "left")
    valid = F.col("_poller").isNotNull()
    return joined.select(
        "subscriber",
        wishes["namespace"],
        "request",
        wishes["target"],
        F.coalesce("_poller", wishes["poller"]).alias("poller"),
        valid.alias("valid"),
    )
