"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierlake.operators.rollup import merge_aggregates, rollup_samples
from tierlake.plans import inventory, reconciliation, status, streams, timeseries, trees  # noqa: F401
from tierlake.plans.registry import QUERIES
from tierlake.sources import demo
from tierlake.sources.polls import normalise_poll_results

__all__ = ["QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly buckets of every series, through typed samples and the 5-minute tier."""
    samples = normalise_poll_results(demo.poll_results(spark, sf_dir))
    return merge_aggregates(rollup_samples(samples, "5min", percentiles=True), "hourly", percentiles=True).drop("sketch")
