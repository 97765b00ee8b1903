"""Queries over poll statistics, health and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlake.operators import health, levels, stats
from tierlake.operators.config import effective_config
from tierlake.plans.registry import query, rounded
from tierlake.plans.twin import current_sql, sql, timeline_sql
from tierlake.schemas import HEALTH_STATES, OPER_STATES, SERIES
from tierlake.sources import demo, polls

STAT_COLUMNS = [*SERIES, *stats.COUNTS, *stats.TIMES, "poll_ms_avg"]


def customer(spark, sf):
    return demo.samples(spark, sf, "customer")


def info(spark, sf):
    """Full information of all pollers."""
    samples, pollers = customer(spark, sf), demo.pollers(spark, sf)
    return stats.poller_full_info(pollers, health.health_current(samples), stats.poller_stats(samples))


@query(
    "poll_outcome",
    sql(
        """SELECT seq, CASE WHEN valid THEN 'success'
                  WHEN error IN ('get: request timeout', 'get: context deadline exceeded', 'context cancelled') THEN 'timeout'
                  ELSE 'failed' END AS outcome FROM csamples""",
        "csamples",
    ),
)
def poll_outcome(spark, sf):
    return customer(spark, sf).select("seq", polls.poll_outcome().alias("outcome"))


@query("poller_stats", sql("SELECT * FROM stats", "stats"))
def poller_stats(spark, sf):
    return stats.poller_stats(customer(spark, sf))


@query(
    "poller_stats_merge",
    sql(
        """SELECT * REPLACE (CAST(poll_ms_sum // poll_ms_count AS BIGINT) AS poll_ms_avg) FROM stats""", "stats"
    ),
)
def poller_stats_merge(spark, sf):
    # The statistics of two halves of the samples make those of the whole.
    samples = customer(spark, sf)
    first = stats.poller_stats(samples.where(F.col("seq") % 3 == 0))
    second = stats.poller_stats(samples.where(F.col("seq") % 3 != 0))
    return stats.poller_stats_merge(first, second)


TOTALS = """count(*) AS pollers, CAST(sum(polls_total) AS BIGINT) AS polls_total, CAST(sum(polls_success) AS BIGINT) AS polls_success,
            CAST(sum(polls_failed) AS BIGINT) AS polls_failed, CAST(sum(polls_timeout) AS BIGINT) AS polls_timeout,
            round(sum(poll_ms_sum) / sum(poll_ms_count)::DOUBLE, 6) AS avg_poll_ms"""


@query("stats_global", sql(f"SELECT {TOTALS} FROM stats", "stats"))
def stats_global(spark, sf):
    return rounded(stats.stats_global(stats.poller_stats(customer(spark, sf))), "avg_poll_ms")


@query("stats_by_namespace", sql(f"SELECT namespace, {TOTALS} FROM stats GROUP BY ALL", "stats"))
def stats_by_namespace(spark, sf):
    return rounded(stats.stats_by_namespace(stats.poller_stats(customer(spark, sf))), "avg_poll_ms")


@query("stats_by_target", sql(f"SELECT namespace, target, {TOTALS} FROM stats GROUP BY ALL", "stats"))
def stats_by_target(spark, sf):
    return rounded(stats.stats_by_target(stats.poller_stats(customer(spark, sf))), "avg_poll_ms")


@query(
    "success_rate",
    sql(
        """SELECT namespace, target, poller, CASE WHEN polls_total > 0
                  THEN format('{:.2f}%', polls_success::DOUBLE / polls_total * 100) ELSE 'N/A' END AS success_rate FROM info""",
        "info",
    ),
)
def success_rate(spark, sf):
    return stats.success_rate(info(spark, sf)).select(*SERIES, "success_rate")


@query(
    "p95_poll_ms",
    sql(
        """SELECT namespace, target, poller, round(quantile_cont(CAST(poll_ms AS DOUBLE), 0.95), 6) AS p95_poll_ms
           FROM csamples GROUP BY ALL""",
        "csamples",
    ),
)
def p95_poll_ms(spark, sf):
    return rounded(stats.p95_poll_ms(customer(spark, sf)), "p95_poll_ms")


STATE_SQL = """count(*) FILTER (oper_state = 'running') AS pollers_running, count(*) FILTER (health = 'up') AS pollers_up,
               count(*) FILTER (health = 'down') AS pollers_down"""
POLLS_SQL = """CAST(sum(polls_total) AS BIGINT) AS polls_total, CAST(sum(polls_success) AS BIGINT) AS polls_success,
               CAST(sum(polls_failed) AS BIGINT) AS polls_failed"""


@query(
    "fleet_status",
    sql(
        f"""SELECT (SELECT count(*) FROM ns) AS namespaces, (SELECT count(*) FROM targets) AS targets, count(*) AS pollers,
                   {STATE_SQL}, count(*) FILTER (health = 'degraded') AS pollers_degraded, {POLLS_SQL} FROM info""",
        "ns",
        "info",
    ),
)
def fleet_status(spark, sf):
    return stats.fleet_status(demo.namespaces(spark, sf), demo.targets(spark, sf), info(spark, sf))


ENABLED_SQL = """count(*) FILTER (admin_state = 'enabled') AS pollers_enabled"""


@query(
    "namespace_status",
    sql(
        f"""SELECT name AS namespace, coalesce(targets, 0) AS targets, coalesce(pollers, 0) AS pollers,
                   coalesce(pollers_enabled, 0) AS pollers_enabled, coalesce(pollers_disabled, 0) AS pollers_disabled,
                   coalesce(pollers_running, 0) AS pollers_running, coalesce(pollers_up, 0) AS pollers_up,
                   coalesce(pollers_down, 0) AS pollers_down, coalesce(polls_total, 0) AS polls_total,
                   coalesce(polls_success, 0) AS polls_success, coalesce(polls_failed, 0) AS polls_failed
            FROM ns LEFT JOIN (SELECT namespace, count(*) AS targets FROM targets GROUP BY ALL) t ON t.namespace = ns.name
                 LEFT JOIN (SELECT namespace, count(*) AS pollers, {ENABLED_SQL},
                                   count(*) FILTER (admin_state <> 'enabled') AS pollers_disabled, {STATE_SQL}, {POLLS_SQL}
                            FROM info GROUP BY namespace) i ON i.namespace = ns.name""",
        "ns",
        "info",
    ),
)
def namespace_status(spark, sf):
    return stats.namespace_status(demo.namespaces(spark, sf), demo.targets(spark, sf), info(spark, sf))


@query(
    "namespace_counts",
    sql(
        f"""SELECT name AS namespace, coalesce(targets, 0) AS targets, coalesce(pollers, 0) AS pollers,
                   coalesce(pollers_enabled, 0) AS pollers_enabled
            FROM ns LEFT JOIN (SELECT namespace, count(*) AS targets FROM targets GROUP BY ALL) t ON t.namespace = ns.name
                 LEFT JOIN (SELECT namespace, count(*) AS pollers, {ENABLED_SQL} FROM pollers GROUP BY namespace) p
                      ON p.namespace = ns.name""",
        "ns",
        "pollers",
    ),
)
def namespace_counts(spark, sf):
    return stats.namespace_counts(demo.namespaces(spark, sf), demo.targets(spark, sf), demo.pollers(spark, sf))


@query(
    "target_counts",
    sql(
        f"""SELECT t.namespace, t.name AS target, coalesce(pollers, 0) AS pollers, coalesce(pollers_enabled, 0) AS pollers_enabled
            FROM targets t LEFT JOIN (SELECT namespace, target, count(*) AS pollers, {ENABLED_SQL} FROM owned
                                      GROUP BY namespace, target) p
                 ON p.namespace = t.namespace AND p.target = t.name""",
        "owned",
    ),
)
def target_counts(spark, sf):
    # Some targets own no poller and must still show, with zeros.
    return stats.target_counts(demo.targets(spark, sf), demo.owned_pollers(spark, sf))


@query(
    "target_detail",
    sql(
        f"""SELECT t.namespace, t.name AS target, t.host, d.pollers, d.pollers_running, d.pollers_up, d.pollers_down,
                   i.poller, i.admin_state, i.oper_state, i.health, i.polls_total, i.polls_failed
            FROM targets t LEFT JOIN (SELECT namespace, target, count(*) AS pollers, {STATE_SQL} FROM info GROUP BY namespace, target) d
                      ON d.namespace = t.namespace AND d.target = t.name
                 LEFT JOIN info i ON i.namespace = t.namespace AND i.target = t.name""",
        "info",
    ),
)
def target_detail(spark, sf):
    return stats.target_detail(demo.targets(spark, sf), info(spark, sf))


@query(
    "poller_full_info",
    sql(
        """SELECT i.*, coalesce(p_interval, t.interval_ms, n.interval_ms, 60000)::BIGINT AS interval_ms
           FROM info i JOIN (SELECT namespace, target, name, nullif(p_interval_ms, 0) AS p_interval FROM pollers) p
                ON p.namespace = i.namespace AND p.target = i.target AND p.name = i.poller
                JOIN (SELECT namespace, name, NULL::INTEGER AS interval_ms FROM targets) t
                ON t.namespace = i.namespace AND t.name = i.target
                JOIN ns n ON n.name = i.namespace""",
        "info",
        "ns",
    ),
)
def poller_full_info(spark, sf):


    samples, pollers = customer(spark, sf), demo.pollers(spark, sf)
    config = effective_config(demo.namespaces(spark, sf), demo.targets(spark, sf), pollers)
    return stats.poller_full_info(
        pollers, health.health_current(samples), stats.poller_stats(samples), config.select(*SERIES, "interval_ms")
    )


def states_sql(column: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS state, count(*) FILTER ({column} = '{n}') AS pollers FROM info" for n in names
    )


@query("health_counts", sql(states_sql("health", HEALTH_STATES), "info"))
def health_counts(spark, sf):
    return stats.health_counts(info(spark, sf))


@query("oper_counts", sql(states_sql("oper_state", OPER_STATES), "info"))
def oper_counts(spark, sf):
    return stats.oper_counts(info(spark, sf))


@query(
    "metric_alerts",
    sql(
        """SELECT namespace, target, metric, round(value, 6) AS value,
                  CASE metric WHEN 'poll_success_rate' THEN CASE WHEN value < 80 THEN 'critical' WHEN value < 95 THEN 'warning' ELSE 'ok' END
                       ELSE CASE WHEN value > 200 THEN 'critical' WHEN value > 50 THEN 'warning' ELSE 'ok' END END AS level
           FROM (SELECT namespace, target, 'poll_success_rate' AS metric, sum(polls_success)::DOUBLE / sum(polls_total) * 100 AS value
                 FROM stats GROUP BY ALL
                 UNION ALL
                 SELECT namespace, target, 'write_latency_ms', sum(poll_ms_sum)::DOUBLE / sum(poll_ms_count) FROM stats GROUP BY ALL)""",
        "stats",
    ),
)
def metric_alerts(spark, sf):
    totals = stats.stats_by_target(stats.poller_stats(customer(spark, sf)))
    measured = totals.select(
        "namespace",
        "target",
        F.inline(
            F.array(
                F.struct(
                    F.lit("poll_success_rate").alias("metric"),
                    (F.col("polls_success") / F.col("polls_total") * 100).alias("value"),
                ),
                F.struct(F.lit("write_latency_ms").alias("metric"), F.col("avg_poll_ms").alias("value")),
            )
        ),
    )
    return rounded(stats.metric_alerts(measured), "value")


# Health ------------------------------------------------------------------


@query("health_timeline", sql(timeline_sql("hsamples"), "hsamples"))
def health_timeline(spark, sf):
    return health.health_timeline(demo.health_samples(spark, sf))


@query("health_timeline_chunked", sql(timeline_sql("csamples"), "csamples"))
def health_timeline_chunked(spark, sf):
    # Chunks of one day, as a fleet too large for wider ones would get.
    return health.health_timeline(customer(spark, sf), chunk_ms=86_400_000)


@query(
    "health_current",
    sql(
        f"""SELECT p.namespace, p.target, p.name AS poller, coalesce(health, 'unknown') AS health,
                   coalesce(consecutive_failures, 0) AS consecutive_failures, coalesce(last_error, '') AS last_error,
                   last_poll_at, last_success_at, last_failure_at
            FROM pollers p LEFT JOIN ({current_sql('csamples')}) h
                 ON h.namespace = p.namespace AND h.target = p.target AND h.poller = p.name""",
        "csamples",
        "pollers",
    ),
)
def health_current(spark, sf):
    return health.health_current(customer(spark, sf), demo.pollers(spark, sf))


@query("health_incremental", sql(current_sql("hsamples"), "hsamples"))
def health_incremental(spark, sf):
    # One half after the other: the state of the first is carried into the second.
    samples = demo.health_samples(spark, sf)
    middle = demo.NOW_MS - 15 * 86_400_000
    first = health.health_current(samples.where(F.col("timestamp_ms") < middle))
    return health.health_current(samples.where(F.col("timestamp_ms") >= middle), carry=first)


@query(
    "health_transitions",
    sql(
        f"""SELECT namespace, target, poller, timestamp_ms, seq, previous AS old_state, health AS new_state
            FROM ({timeline_sql('hsamples')}) WHERE previous <> health""",
        "hsamples",
    ),
)
def health_transitions(spark, sf):
    return health.health_transitions(health.health_timeline(demo.health_samples(spark, sf)))


@query(
    "reachability_sticky",
    sql(
        """SELECT namespace, target, poller, timestamp_ms, seq, valid, last_value(change IGNORE NULLS) OVER w AS state
           FROM (SELECT *, CASE WHEN valid THEN 'polling' WHEN run >= 3 THEN 'unreachable' WHEN first THEN 'polling' END AS change
                 FROM (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY namespace, target, poller, grp ORDER BY timestamp_ms, seq) AS run,
                              row_number() OVER (PARTITION BY namespace, target, poller ORDER BY timestamp_ms, seq) = 1 AS first
                       FROM (SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY namespace, target, poller ORDER BY timestamp_ms, seq) AS grp
                             FROM hsamples)))
           WINDOW w AS (PARTITION BY namespace, target, poller ORDER BY timestamp_ms, seq)""",
        "hsamples",
    ),
)
def reachability_sticky(spark, sf):
    return health.reachability_sticky(health.health_timeline(demo.health_samples(spark, sf)))


# Levels ------------------------------------------------------------------


def ratios(spark, sf):
    """Poll time as a share of 100 ms, one series per nation."""
    return demo.health_samples(spark, sf).withColumn("ratio", F.col("poll_ms") / 100)


def levels_sql(cooldown_ms: int = 0) -> str:
    """The level machine as a recursion over the samples of each series in order."""
    taken = "true" if not cooldown_ms else f"(l.last_check IS NULL OR r.timestamp_ms - l.last_check >= {cooldown_ms})"
    return f"""
      SELECT namespace, target, poller, timestamp_ms, seq, ratio, evaluated,
             list_extract(['normal', 'warning', 'critical', 'emergency'], previous + 1) AS previous,
             list_extract(['normal', 'warning', 'critical', 'emergency'], level + 1) AS level
      FROM steps WHERE n > 0""", f"""
      SELECT namespace, target, poller, 0::BIGINT AS n, 0::BIGINT AS timestamp_ms, 0::BIGINT AS seq, 0::DOUBLE AS ratio,
             true AS evaluated, 0 AS previous, 0 AS level, NULL::BIGINT AS last_check FROM ordered WHERE n = 1
      UNION ALL
      SELECT r.namespace, r.target, r.poller, r.n, r.timestamp_ms, r.seq, r.ratio, {taken}, l.level,
             CASE WHEN NOT {taken} THEN l.level WHEN r.ratio >= 0.95 THEN 3 WHEN r.ratio >= 0.80 THEN 2 WHEN r.ratio >= 0.50 THEN 1
                  WHEN l.level = 3 THEN CASE WHEN r.ratio < 0.95::DOUBLE - 0.10::DOUBLE THEN 2 ELSE 3 END
                  WHEN l.level = 2 THEN CASE WHEN r.ratio < 0.80::DOUBLE - 0.10::DOUBLE THEN 1 ELSE 2 END
                  WHEN l.level = 1 THEN CASE WHEN r.ratio < 0.50::DOUBLE - 0.10::DOUBLE THEN 0 ELSE 1 END ELSE 0 END,
             CASE WHEN {taken} THEN r.timestamp_ms ELSE l.last_check END
      FROM steps l JOIN ordered r ON r.n = l.n + 1 AND r.namespace = l.namespace AND r.target = l.target AND r.poller = l.poller"""


ORDERED = """SELECT namespace, target, poller, timestamp_ms, seq, poll_ms / 100.0::DOUBLE AS ratio,
    row_number() OVER (PARTITION BY namespace, target, poller ORDER BY timestamp_ms, seq) AS n FROM hsamples"""


def level_query_sql(cooldown_ms: int, wrap: str = "{}") -> str:
    body, steps = levels_sql(cooldown_ms)
    return sql(wrap.format(body), "hsamples", recursive=True, ordered=ORDERED, steps=steps)


COOLDOWN_MS = 3 * 3_600_000


@query("level_hysteresis", level_query_sql(0))
def level_hysteresis(spark, sf):
    return levels.level_hysteresis(ratios(spark, sf))


@query("level_hysteresis_chunked", level_query_sql(0))
def level_hysteresis_chunked(spark, sf):
    return levels.level_hysteresis(ratios(spark, sf), chunk_ms=6 * 3_600_000)


@query("level_hysteresis_cooldown", level_query_sql(COOLDOWN_MS))
def level_hysteresis_cooldown(spark, sf):
    return levels.level_hysteresis(ratios(spark, sf), cooldown_ms=COOLDOWN_MS, chunk_ms=86_400_000)


@query(
    "level_change_counts",
    level_query_sql(
        0,
        """SELECT namespace, target, poller, count(*) FILTER (level <> previous) AS level_changes,
                  count(*) FILTER (level <> previous AND level = 'warning') AS warning_count,
                  count(*) FILTER (level <> previous AND level = 'critical') AS critical_count,
                  count(*) FILTER (level <> previous AND level = 'emergency') AS emergency_count
           FROM ({}) GROUP BY ALL""",
    ),
)
def level_change_counts(spark, sf):
    return levels.level_change_counts(levels.level_hysteresis(ratios(spark, sf)))


# Planned views over the fleet ---------------------------------------------


@query(
    "hierarchy_rollup",
    sql(
        """SELECT namespace, target, CAST(2 - (grouping(namespace) + grouping(target)) AS INTEGER) AS depth, count(*) AS entities,
                  list_extract(['up', 'unknown', 'degraded', 'down'],
                    max(CASE health WHEN 'up' THEN 1 WHEN 'unknown' THEN 2 WHEN 'degraded' THEN 3 ELSE 4 END)) AS status
           FROM info GROUP BY ROLLUP (namespace, target)""",
        "info",
    ),
)
def hierarchy_rollup(spark, sf):
    return stats.hierarchy_rollup(info(spark, sf), ["namespace", "target"])


@query(
    "board_counts",
    sql(
        "SELECT namespace, "
        + ", ".join(f"count(*) FILTER (health = '{h}') AS {h}" for h in HEALTH_STATES)
        + " FROM info GROUP BY namespace",
        "info",
    ),
)
def board_counts(spark, sf):
    return stats.board_counts(info(spark, sf))
