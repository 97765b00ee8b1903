"""Streaming queries, each run to its end on the samples of the test tables.

Every stream finds the samples in three steps and is restarted from its
checkpoint for each, so state passes from one micro-batch to the next.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlake.operators import live
from tierlake.plans import store
from tierlake.plans.registry import query, rounded
from tierlake.plans.status import COOLDOWN_MS, level_query_sql
from tierlake.plans.timeseries import AGG, AGG_COLUMNS, SAMPLE_SQL, plain
from tierlake.plans.twin import bucket, rollup_sql, sql, timeline_sql
from tierlake.schemas import SERIES
from tierlake.session import scratch_path
from tierlake.sources import demo
from tierlake.streaming import streams


def drain(spark, sf, kind, start, slices=store.SLICES):
    """Run a stream over the slices; start(source, path, checkpoint) starts it.  Returns its output path."""
    root = store.slices(spark, sf, kind)
    schema = spark.read.parquet(f"{root}/slice-0").schema
    path = scratch_path(spark, f"stream-{kind}")
    for i in range(slices):
        source = streams.read_samples(spark, store.slice_glob(root, i), schema)
        start(source, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


# Late samples and delivery in batch form ----------------------------------

LATE_SQL = f"""
  SELECT namespace, target, poller, timestamp_ms, seq, arrival_ms, bucket_start, newest_before, newest_before - bucket_start AS late_by_ms
  FROM (SELECT *, max(bucket_start) OVER (PARTITION BY namespace, target, poller ORDER BY arrival_ms, seq
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before
        FROM (SELECT *, {bucket('timestamp_ms', '5min')} AS bucket_start FROM arrivals))
  WHERE bucket_start < newest_before"""
LATE_COLUMNS = [*SERIES, "timestamp_ms", "seq", "arrival_ms", "bucket_start", "newest_before", "late_by_ms"]


@query("late_audit", sql(LATE_SQL, "arrivals"))
def late_audit(spark, sf):
    return live.late_audit(demo.arrivals(spark, sf)).select(LATE_COLUMNS)


@query("late_audit_chunked", sql(LATE_SQL, "arrivals"))
def late_audit_chunked(spark, sf):
    return live.late_audit(demo.arrivals(spark, sf), chunk_ms=3 * 3_600_000).select(LATE_COLUMNS)


FANOUT_SQL = f"""SELECT subscriber, {SAMPLE_SQL} FROM csamples JOIN
    (SELECT DISTINCT subscriber, namespace AS n, target AS t, poller AS p FROM subs) ON n = namespace AND t = target AND (p IS NULL OR p = poller)"""


@query("fanout", sql(FANOUT_SQL, "csamples", "subs"))
def fanout(spark, sf):
    return plain(live.fanout(demo.samples(spark, sf, "customer"), demo.subscriptions(spark, sf)))


def subscription_requests(spark, sf):
    """Requests by target, by poller and by path, some of them for nothing."""
    c = demo.customers(spark, sf)
    key = F.col("c_custkey")
    return c.where(key % 3 == 0).select(
        F.concat(F.lit("session-"), (key % 7).cast("string")).alias("subscriber"),
        F.col("r_name").alias("namespace"),
        F.when(key % 4 == 0, F.col("c_name")).when(key % 4 == 1, F.concat(F.lit("lost-"), F.col("c_name")))
        .when(key % 4 == 2, F.col("c_name")).alias("target"),
        F.when(key % 4 == 2, F.when(key % 8 == 2, "signup").otherwise("reboot")).alias("poller"),
        F.when(
            key % 4 == 3,
            F.when(key % 5 == 0, F.concat(F.lit("/targets/"), F.col("c_name")))
            .when(key % 5 == 1, F.concat(F.lit("/targets/"), F.col("c_name"), F.lit("/view")))
            .when(key % 5 == 2, F.concat_ws("/", F.lit("/tree/geo"), F.col("r_name"), F.col("n_name"), F.col("c_name")))
            .otherwise(F.concat(F.lit("/tree/geo/"), F.col("r_name"))),
        ).alias("path"),
    )


@query(
    "subscriptions_resolve",
    sql(
        """SELECT DISTINCT w.subscriber, w.namespace, w.request, w.target, coalesce(p.name, w.poller) AS poller, p.name IS NOT NULL AS valid
           FROM (SELECT 'session-' || (c_custkey % 7) AS subscriber, r_name AS namespace,
                        CASE c_custkey % 4 WHEN 0 THEN c_name || '/*' WHEN 1 THEN 'lost-' || c_name || '/*'
                             WHEN 2 THEN c_name || CASE WHEN c_custkey % 8 = 2 THEN '/signup' ELSE '/reboot' END
                             ELSE CASE c_custkey % 5 WHEN 0 THEN '/targets/' || c_name WHEN 1 THEN '/targets/' || c_name || '/view'
                                  WHEN 2 THEN '/tree/geo/' || r_name || '/' || n_name || '/' || c_name ELSE '/tree/geo/' || r_name END END AS request,
                        CASE WHEN c_custkey % 4 IN (0, 2) THEN c_name WHEN c_custkey % 4 = 1 THEN 'lost-' || c_name
                             WHEN c_custkey % 5 IN (0, 1, 2) THEN c_name END AS target,
                        CASE WHEN c_custkey % 4 = 2 THEN CASE WHEN c_custkey % 8 = 2 THEN 'signup' ELSE 'reboot' END
                             WHEN c_custkey % 4 = 3 AND c_custkey % 5 = 1 THEN 'view' END AS poller
                 FROM cust WHERE c_custkey % 3 = 0) w
                LEFT JOIN pollers p ON p.namespace = w.namespace AND p.target = w.target AND (w.poller IS NULL OR w.poller = p.name)""",
        "cust",
        "pollers",
    ),
)
def subscriptions_resolve(spark, sf):
    return live.subscriptions_resolve(
        subscription_requests(spark, sf), demo.pollers(spark, sf), demo.tree_nodes(spark, sf)
    )


# Streams -------------------------------------------------------------------


@query("stream_rollup_5min", sql(rollup_sql("5min"), "numeric"))
def stream_rollup_5min(spark, sf):
    # Two markers after the samples move the watermark past the last bucket; the sink alone is compared.
    path = drain(
        spark, sf, "marked", lambda s, out, checkpoint: streams.stream_rollup(s, out, checkpoint), store.SLICES + 2
    )
    emitted = spark.read.parquet(path).where(F.col("namespace") != store.MARKER)
    return rounded(emitted.select(AGG_COLUMNS), *AGG)


@query("stream_health", sql(timeline_sql("hsamples"), "hsamples"))
def stream_health(spark, sf):
    path = drain(spark, sf, "health", lambda s, out, checkpoint: streams.stream_health(s, out, checkpoint))
    return spark.read.parquet(f"{path}/timeline").drop("batch")


@query("stream_poller_stats", sql("SELECT * FROM stats", "stats"))
def stream_poller_stats(spark, sf):
    path = drain(spark, sf, "customer", lambda s, out, checkpoint: streams.stream_poller_stats(s, out, checkpoint))
    return streams.Changes(f"{path}/snapshot", streams.STATS_STATE).newest(spark, store.SLICES - 1)


@query("stream_fanout", sql(FANOUT_SQL, "csamples", "subs"))
def stream_fanout(spark, sf):
    wishes = demo.subscriptions(spark, sf)
    path = drain(spark, sf, "customer", lambda s, out, checkpoint: streams.stream_fanout(s, wishes, out, checkpoint))
    return plain(spark.read.parquet(path))


def _levels(cooldown_ms):
    def start(source, out, checkpoint):
        rows = source.withColumn("ratio", F.col("poll_ms") / 100)
        return streams.stream_levels(rows, out, checkpoint, cooldown_ms=cooldown_ms)

    return start


@query("stream_levels", level_query_sql(0))
def stream_levels(spark, sf):
    path = drain(spark, sf, "health", _levels(0))
    return spark.read.parquet(f"{path}/levels").drop("batch")


@query("stream_levels_cooldown", level_query_sql(COOLDOWN_MS))
def stream_levels_cooldown(spark, sf):
    path = drain(spark, sf, "health", _levels(COOLDOWN_MS))
    return spark.read.parquet(f"{path}/levels").drop("batch")


@query("stream_late", sql(LATE_SQL, "arrivals"))
def stream_late(spark, sf):
    path = drain(spark, sf, "arrivals", lambda s, out, checkpoint: streams.stream_late(s, out, checkpoint))
    return spark.read.parquet(f"{path}/late").select(LATE_COLUMNS)


@query(
    "stream_ingest_summary",
    sql(
        """SELECT CAST(least(2, (timestamp_ms - first) // ((last - first) // 3 + 1)) AS INTEGER) AS batch, count(*) AS received,
                  count(*) FILTER (valid) AS ingested, count(*) FILTER (NOT valid) AS invalid,
                  count(*) FILTER (value_type = 'text') AS text, count(DISTINCT (namespace, target, poller)) AS series
           FROM samples, (SELECT min(timestamp_ms) AS first, max(timestamp_ms) AS last FROM samples) GROUP BY 1""",
        "samples",
    ),
)
def stream_ingest_summary(spark, sf):
    path = drain(spark, sf, "nation", lambda s, out, checkpoint: streams.stream_ingest_summary(s, out, checkpoint))
    return spark.read.parquet(path)
