"""Poll results to typed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.functions.buckets import floor_to
from tierlake.functions.sketch import finite
from tierlake.schemas import COUNTER_TYPE, SERIES

# Device value kinds and the sample type each becomes.
COUNTER_KINDS = ["Counter32", "Counter64", "Uinteger32"]
GAUGE_KINDS = ["Integer", "TimeTicks", "Gauge32"]
TEXT_KINDS = ["OctetString"]
MISSING_KINDS = ["NoSuchObject", "NoSuchInstance"]

# Error texts of a poll that ran out of time.
TIMEOUT_ERRORS = ["request timeout", "context deadline exceeded"]
CANCELLED_ERROR = "context cancelled"
GET_PREFIX = "get: "
# Our own reason for a gauge without a finite value.
NOT_FINITE = "value is not finite"


def sample_value() -> Column:
    """The one numeric value of a sample; NULL for text."""
    return F.when(F.col("value_type") == "counter", F.col("value_counter").cast("double")).when(
        F.col("value_type") == "gauge", F.col("value_gauge")
    )


def normalise_poll_results(raw: DataFrame) -> DataFrame:
    """Typed samples from poll results of (series, timestamp_ms, kind, raw, error, poll_ms, seq).

    A counter kind fills value_counter, a text kind value_text, a numeric kind
    value_gauge.  A failed poll, a missing object, an unknown kind and a gauge
    that is infinite or no number give an invalid sample with the reason.
    """
    kind, number = F.col("kind"), F.expr("try_cast(raw as double)")
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    error = (
        F.when(~no_error, F.col("error"))
        .when(kind.isin(MISSING_KINDS), F.lit("OID not found"))
        .when(~kind.isin(COUNTER_KINDS + GAUGE_KINDS + TEXT_KINDS), F.concat(F.lit("unsupported type: "), kind))
        .when(kind.isNull(), F.lit("unsupported type: "))
        .when(kind.isin(GAUGE_KINDS) & ~finite(F.coalesce(number, F.lit(0.0))), F.lit(NOT_FINITE))
    )
    value_type = (
        F.when(kind.isin(COUNTER_KINDS), "counter").when(kind.isin(TEXT_KINDS), "text").otherwise("gauge")
    )
    good = F.col("error").isNull()
    return raw.select(
        *SERIES,
        "timestamp_ms",
        value_type.alias("value_type"),
        error.alias("error"),
        "raw",
        "poll_ms",
        "seq",
    ).select(
        *SERIES,
        "timestamp_ms",
        "value_type",
        F.when(good & (F.col("value_type") == "gauge"), F.expr("try_cast(raw as double)")).alias("value_gauge"),
        F.when(good & (F.col("value_type") == "counter"), F.expr("try_cast(raw as decimal(20,0))"))
        .cast(COUNTER_TYPE)
        .alias("value_counter"),
        F.when(good & (F.col("value_type") == "text"), F.col("raw")).alias("value_text"),
        good.alias("valid"),
        "error",
        "poll_ms",
        "seq",
    )


def poll_outcome(valid: Column | None = None, error: Column | None = None) -> Column:
    """success, timeout or failed."""
    valid = F.col("valid") if valid is None else valid
    error = F.col("error") if error is None else error
    timed_out = [CANCELLED_ERROR] + [GET_PREFIX + text for text in TIMEOUT_ERRORS]
    return F.when(valid, "success").when(error.isin(timed_out), "timeout").otherwise("failed")


def ingest_summary(samples: DataFrame, batch_ms: int, received_at: str = "timestamp_ms") -> DataFrame:
    """Received, ingested, invalid and text samples and distinct series per arrival batch."""
    batch = floor_to(received_at, batch_ms).alias("batch_start")
    # One row per batch and series first, so that the distinct count is a plain sum.
    per_series = samples.groupBy(batch, *SERIES).agg(
        F.count("*").alias("received"),
        F.count_if("valid").alias("ingested"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("value_type") == "text").alias("text"),
    )
    return per_series.groupBy("batch_start").agg(
        F.sum("received").alias("received"),
        F.sum("ingested").alias("ingested"),
        F.sum("invalid").alias("invalid"),
        F.sum("text").alias("text"),
        F.count("*").alias("series"),
    )
