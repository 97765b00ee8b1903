"""Schemas, the tier table and the enumerations of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SERIES = ["namespace", "target", "poller"]

SECOND_MS = 1_000
MINUTE_MS = 60 * SECOND_MS
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS
WEEK_MS = 7 * DAY_MS
# 1970-01-05, the first Monday after the epoch.
FIRST_MONDAY_MS = 4 * DAY_MS


@dataclass(frozen=True)
class Tier:
    name: str
    width_ms: int
    retention_ms: int
    # Longest query span, both ends included, that this tier answers.
    max_span_ms: int | None


# Widths, retention and routing limits of the five tiers.
TIERS = {
    "raw": Tier("raw", 25 * SECOND_MS, 48 * HOUR_MS, 48 * HOUR_MS),
    "5min": Tier("5min", 5 * MINUTE_MS, 30 * DAY_MS, 30 * DAY_MS),
    "hourly": Tier("hourly", HOUR_MS, 90 * DAY_MS, 90 * DAY_MS),
    "daily": Tier("daily", DAY_MS, 730 * DAY_MS, 730 * DAY_MS),
    "weekly": Tier("weekly", WEEK_MS, 3650 * DAY_MS, None),
}
TIER_ORDER = list(TIERS)

# Built-in polling settings used where no level sets one.
DEFAULT_TIMEOUT_MS = 5000
DEFAULT_RETRIES = 2
DEFAULT_INTERVAL_MS = 60000
DEFAULT_BUFFER_SIZE = 3600

# Health, operational and level names.
HEALTH_STATES = ["unknown", "up", "degraded", "down"]
OPER_STATES = ["stopped", "starting", "running", "stopping"]
LEVELS = ["normal", "warning", "critical", "emergency"]

COUNTER_TYPE = T.DecimalType(20, 0)


def _schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _named(names: str, kind: T.DataType) -> list[tuple[str, T.DataType]]:
    return [(name, kind) for name in names.split()]


_KEY = _named("namespace target poller", T.StringType())

SAMPLES = _schema(
    _KEY
    + [
        ("timestamp_ms", T.LongType()),
        ("value_type", T.StringType()),
        ("value_gauge", T.DoubleType()),
        ("value_counter", COUNTER_TYPE),
        ("value_text", T.StringType()),
        ("valid", T.BooleanType()),
        ("error", T.StringType()),
        ("poll_ms", T.IntegerType()),
        ("seq", T.LongType()),
    ]
)

AGGREGATES = _schema(
    _KEY
    + _named("bucket_start bucket_end count", T.LongType())
    + _named("sum min max avg p50 p90 p95 p99", T.DoubleType())
    + _named("first_ts last_ts", T.LongType())
    + [("sketch", T.MapType(T.IntegerType(), T.LongType())), ("bucket_date", T.DateType())]
)

SUBSCRIPTIONS = _schema(_named("subscriber namespace target poller", T.StringType()))
