"""Poll statistics and fleet status."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.operators.quantiles import percentiles_exact
from tierlake.schemas import HEALTH_STATES, OPER_STATES, SERIES
from tierlake.sources.polls import poll_outcome

COUNTS = ["polls_total", "polls_success", "polls_failed", "polls_timeout"]
TIMES = ["poll_ms_sum", "poll_ms_min", "poll_ms_max", "poll_ms_count"]


def counted() -> list[Column]:
    outcome = poll_outcome()
    return [
        F.count("*").alias("polls_total"),
        F.count_if("valid").alias("polls_success"),
        F.count_if(~F.col("valid")).alias("polls_failed"),
        F.count_if(outcome == "timeout").alias("polls_timeout"),
        F.sum(F.col("poll_ms").cast("bigint")).alias("poll_ms_sum"),
        F.min("poll_ms").alias("poll_ms_min"),
        F.max("poll_ms").alias("poll_ms_max"),
        F.count("poll_ms").alias("poll_ms_count"),
    ]


def _combined() -> list[Column]:
    return [F.sum(c).alias(c) for c in [*COUNTS, "poll_ms_sum"]] + [
        F.min("poll_ms_min").alias("poll_ms_min"),
        F.max("poll_ms_max").alias("poll_ms_max"),
        F.sum("poll_ms_count").alias("poll_ms_count"),
    ]


def average_poll_ms() -> Column:
    """Whole milliseconds, 0 without polls."""
    return F.coalesce(
        F.expr("poll_ms_sum div nullif(poll_ms_count, 0)"), F.lit(0).cast("bigint")
    )


def poller_stats(samples: DataFrame) -> DataFrame:
    """Counts and poll times per series; timeouts are part of the failures."""
    return samples.groupBy(*SERIES).agg(*counted()).withColumn("poll_ms_avg", average_poll_ms())


def poller_stats_merge(snapshot: DataFrame, new: DataFrame) -> DataFrame:
    """Stored statistics plus those of a new batch."""
    columns = [*SERIES, *COUNTS, *TIMES]
    both = snapshot.select(columns).unionByName(new.select(columns))
    return both.groupBy(*SERIES).agg(*_combined()).withColumn("poll_ms_avg", average_poll_ms())


def _totals(stats: DataFrame, *keys: str) -> DataFrame:
    totals = stats.groupBy(*keys).agg(
        F.count("*").alias("pollers"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
        F.sum("poll_ms_sum").alias("_sum"),
        F.sum("poll_ms_count").alias("_count"),
    )
    mean = F.coalesce(F.col("_sum") / F.nullif(F.col("_count"), F.lit(0)), F.lit(0.0))
    return totals.withColumn("avg_poll_ms", mean).drop("_sum", "_count")


def stats_global(stats: DataFrame) -> DataFrame:
    """Totals over all series with the mean poll time weighted by polls."""
    return _totals(stats)


def stats_by_namespace(stats: DataFrame) -> DataFrame:
    return _totals(stats, "namespace")


def stats_by_target(stats: DataFrame) -> DataFrame:
    return _totals(stats, "namespace", "target")


def success_rate(stats: DataFrame) -> DataFrame:
    """Percent of successful polls as text with two decimals."""
    rate = F.col("polls_success") / F.nullif(F.col("polls_total"), F.lit(0)) * 100
    return stats.withColumn("success_rate", F.when(F.col("polls_total") > 0, _percent_text(rate)).otherwise("N/A"))


def _percent_text(rate: Column) -> Column:
    """A rate that is not negative with two decimals, rounded by the double's exact value, ties to even.

    format_string rounds what the shortest decimal says, and its ties up.  Here the fraction is cut into two parts whose
    products with 100 are exact.
    """
    whole, cut = F.floor(rate), F.lit(float(1 << 26))
    fraction = rate - whole
    high = F.floor(fraction * cut) / cut
    below = F.floor(high * 100)
    missing = F.lit(0.5) - (high * 100 - below)
    rest = (fraction - high) * 100
    up = (rest > missing) | ((rest == missing) & (below % 2 == 1))
    hundredths = (whole * 100 + below + up.cast("int")).cast("bigint")
    return F.format_string("%d.%02d%%", F.floor(hundredths / 100), hundredths % 100)


def p95_poll_ms(samples: DataFrame) -> DataFrame:
    return percentiles_exact(samples, SERIES, "poll_ms", {"p95_poll_ms": 0.95})


def poller_full_info(
    pollers: DataFrame, health: DataFrame, stats: DataFrame, config: DataFrame | None = None
) -> DataFrame:
    """Pollers with state, statistics and effective configuration; unpolled ones show zeros."""
    base = pollers.select(
        "namespace", "target", F.col("name").alias("poller"), "description", "protocol", "admin_state", "oper_state"
    )
    state = health.select(
        *SERIES, "health", "consecutive_failures", "last_error", "last_poll_at", "last_success_at", "last_failure_at"
    )
    numbers = stats.select(*SERIES, *COUNTS, *TIMES, "poll_ms_avg")
    out = base.join(state, SERIES, "left").join(numbers, SERIES, "left")
    if config is not None:
        out = out.join(config, SERIES, "left")
    return out.withColumns(
        {
            "health": F.coalesce("health", F.lit("unknown")),
            "consecutive_failures": F.coalesce("consecutive_failures", F.lit(0).cast("bigint")),
            "last_error": F.coalesce("last_error", F.lit("")),
            **{c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in [*COUNTS, *TIMES, "poll_ms_avg"]},
        }
    )


def _state_counts(info: DataFrame) -> list[Column]:
    def states(column, names):
        return [F.count_if(F.col(column) == n).alias(f"pollers_{n}") for n in names]

    return [
        F.count("*").alias("pollers"),
        F.count_if(F.col("admin_state") == "enabled").alias("pollers_enabled"),
        F.count_if(F.col("admin_state") != "enabled").alias("pollers_disabled"),
        *states("oper_state", ["running"]),
        *states("health", ["up", "down", "degraded"]),
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTS[:3]],
    ]


def fleet_status(namespaces: DataFrame, targets: DataFrame, info: DataFrame) -> DataFrame:
    """One row for the whole fleet, from the full information of all pollers."""
    return info.agg(*_state_counts(info)).select(
        namespaces.agg(F.count("*").alias("n")).scalar().alias("namespaces"),
        targets.agg(F.count("*").alias("n")).scalar().alias("targets"),
        "*",
    ).drop("pollers_enabled", "pollers_disabled")


def namespace_status(namespaces: DataFrame, targets: DataFrame, info: DataFrame) -> DataFrame:
    """One row per namespace; an empty namespace shows zeros."""
    per_target = targets.groupBy("namespace").agg(F.count("*").alias("targets"))
    per_poller = info.groupBy("namespace").agg(*_state_counts(info)).drop("pollers_degraded")
    names = namespaces.select(F.col("name").alias("namespace"))
    joined = names.join(per_target, "namespace", "left").join(per_poller, "namespace", "left")
    return joined.na.fill(0)


def namespace_counts(namespaces: DataFrame, targets: DataFrame, pollers: DataFrame) -> DataFrame:
    per_target = targets.groupBy("namespace").agg(F.count("*").alias("targets"))
    per_poller = pollers.groupBy("namespace").agg(
        F.count("*").alias("pollers"), F.count_if(F.col("admin_state") == "enabled").alias("pollers_enabled")
    )
    names = namespaces.select(F.col("name").alias("namespace"))
    return names.join(per_target, "namespace", "left").join(per_poller, "namespace", "left").na.fill(0)


def target_counts(targets: DataFrame, pollers: DataFrame) -> DataFrame:
    per_target = pollers.groupBy("namespace", "target").agg(
        F.count("*").alias("pollers"), F.count_if(F.col("admin_state") == "enabled").alias("pollers_enabled")
    )
    names = targets.select("namespace", F.col("name").alias("target"))
    return names.join(per_target, ["namespace", "target"], "left").na.fill(0)


def target_detail(targets: DataFrame, info: DataFrame) -> DataFrame:
    """Each target with its totals, one row per poller summary, sorted by poller on reading.

    The summaries stay rows: a target may own any number of pollers.
    """
    keys = ["namespace", "target"]
    totals = info.groupBy(*keys).agg(
        F.count("*").alias("pollers"),
        F.count_if(F.col("oper_state") == "running").alias("pollers_running"),
        F.count_if(F.col("health") == "up").alias("pollers_up"),
        F.count_if(F.col("health") == "down").alias("pollers_down"),
    )
    heads = targets.select("namespace", F.col("name").alias("target"), "host").join(totals, keys, "left")
    heads = heads.na.fill(0)
    summaries = info.select(*SERIES, "admin_state", "oper_state", "health", "polls_total", "polls_failed")
    return heads.join(summaries, keys, "left")


def _counts_by(info: DataFrame, column: str, states: list[str]) -> DataFrame:
    """One row per state, in the fixed list also those that no poller is in."""
    stacked = F.array(*[F.struct(F.lit(s).alias("state"), F.count_if(F.col(column) == s).alias("pollers")) for s in states])
    return info.agg(F.array(F.lit(0)).alias("_"), stacked.alias("s")).select(F.inline("s"))


def health_counts(info: DataFrame) -> DataFrame:
    return _counts_by(info, "health", HEALTH_STATES)


def oper_counts(info: DataFrame) -> DataFrame:
    return _counts_by(info, "oper_state", OPER_STATES)


@dataclass(frozen=True)
class Threshold:
    metric: str
    warning: float
    critical: float
    low_is_bad: bool = False


# Documented alert thresholds that apply to polled data.
THRESHOLDS = [
    Threshold("poll_success_rate", 95.0, 80.0, low_is_bad=True),
    Threshold("write_latency_ms", 50.0, 200.0),
    Threshold("queue_usage_percent", 70.0, 90.0),
    Threshold("session_count", 8000.0, 9500.0),
]


def metric_alerts(metrics: DataFrame, thresholds: list[Threshold] = THRESHOLDS) -> DataFrame:
    """Alert level of each (metric, value): ok, warning or critical; other metrics stay NULL."""
    value = F.col("value")
    levels = []
    for t in thresholds:
        crossed = (lambda limit: value < limit) if t.low_is_bad else (lambda limit: value > limit)
        level = F.when(crossed(t.critical), "critical").when(crossed(t.warning), "warning").otherwise("ok")
        levels.append((F.col("metric") == t.metric, F.when(value.isNotNull(), level)))
    return metrics.withColumn("level", reduce(lambda c, rule: c.when(*rule), levels[1:], F.when(*levels[0])))


def board_counts(info: DataFrame, row: str = "namespace", column: str = "health", values: list[str] = HEALTH_STATES) -> DataFrame:
    """Entities per value of a column, one output column per listed value."""
    return info.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


# Order of badness when a parent takes the state of its worst child.
SEVERITY = ["up", "unknown", "degraded", "down"]


def hierarchy_rollup(info: DataFrame, levels: list[str], state: str = "health") -> DataFrame:
    """Entities grouped by an ordered list of fields, at every depth, with the worst state below."""
    severity = reduce(
        lambda c, s: c.when(F.col(state) == s[1], s[0]), list(enumerate(SEVERITY))[1:], F.when(F.col(state) == SEVERITY[0], 0)
    )
    rolled = info.rollup(*levels).agg(
        F.count("*").alias("entities"),
        F.max(severity).alias("_worst"),
        F.grouping_id().alias("_grouping"),
    )
    depth = F.lit(len(levels)) - F.bit_count("_grouping")
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_worst") + 1)
    return rolled.select(*levels, depth.cast("int").alias("depth"), "entities", worst.alias("status"))
