"""Bucket arithmetic and tier choice on epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierlake.schemas import DAY_MS, FIRST_MONDAY_MS, TIERS


def _column(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value).cast("bigint")


def floor_to(ms, width_ms: int, offset_ms: int = 0) -> Column:
    """Start of the bucket of the given width; times lie after the epoch."""
    ms = _column(ms)
    shifted = ms - F.lit(offset_ms).cast("bigint") if offset_ms else ms
    start = shifted - F.pmod(shifted, F.lit(width_ms).cast("bigint"))
    return start + F.lit(offset_ms).cast("bigint") if offset_ms else start


def bucket_start(ms, tier: str) -> Column:
    return floor_to(ms, TIERS[tier].width_ms, FIRST_MONDAY_MS if tier == "weekly" else 0)


def tier_bucket(ms, tier: str) -> tuple[Column, Column]:
    """Start and end of the bucket of a tier; weeks begin on Monday, all in UTC."""
    start = bucket_start(ms, tier)
    return start, start + F.lit(TIERS[tier].width_ms).cast("bigint")


def utc_date(ms) -> Column:
    """UTC date of epoch milliseconds, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(_column(ms) / DAY_MS).cast("int"))


def ntz_millis(ts: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC, whatever the session time zone."""
    return F.expr(f"({ts} - timestamp_ntz'1970-01-01 00:00:00') div interval '0.001' second")


def tier_for_span(span_ms: int) -> str:
    """Tier that answers a span known on the driver."""
    for tier in TIERS.values():
        if tier.max_span_ms is None or span_ms <= tier.max_span_ms:
            return tier.name
    raise AssertionError("the last tier has no limit")


def select_tier(start_ms, end_ms) -> Column:
    """Tier that answers each requested span."""
    span = _column(end_ms) - _column(start_ms)
    choice = None
    for tier in TIERS.values():
        if tier.max_span_ms is not None:
            test = span <= F.lit(tier.max_span_ms).cast("bigint")
            choice = F.when(test, tier.name) if choice is None else choice.when(test, tier.name)
        else:
            choice = choice.otherwise(tier.name)
    return choice
