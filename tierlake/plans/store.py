"""Tables that queries derive from the test tables once per session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.operators.rollup import run_cascade
from tierlake.schemas import DAY_MS, TIER_ORDER
from tierlake.session import passing, scratch_path
from tierlake.sources import demo
from tierlake.sources.tagstore import write_tag_index
from tierlake.sources.tiers import sample_span, scan_tier, write_samples

_BUILT: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last millisecond of the events."""

    def build():
        row = demo.events(spark, sf_dir).agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b")).first()
        return row["a"], row["b"]

    return _once(spark, sf_dir, "span", build)


def tier_root(spark: SparkSession, sf_dir: str) -> str:
    """Raw samples and all tiers of the nation series, written by the cascade."""

    def build():
        root = scratch_path(spark, "tiers")
        write_samples(demo.samples(spark, sf_dir, "nation"), root)
        # From the stored samples: the events are joined once, not again for their span.
        first, last = sample_span(spark, root)
        run_cascade(spark, root, first, last + 1)
        return root

    return _once(spark, sf_dir, "tiers", build)


def tag_root(spark: SparkSession, sf_dir: str) -> str:
    """The stored tag index of the targets."""

    def build():
        root = scratch_path(spark, "tags")
        write_tag_index(demo.targets(spark, sf_dir), root)
        return root

    return _once(spark, sf_dir, "tags", build)


def tiers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    root = tier_root(spark, sf_dir)
    return {tier: scan_tier(spark, root, tier) for tier in TIER_ORDER}


def tier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers in one table."""
    parts = [df.withColumn("tier", F.lit(t)) for t, df in tiers(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts)


SLICES = 3
# Namespace of samples that only move a watermark.
MARKER = "marker"


def slices(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Samples in folders slice-0, slice-1, ... of consecutive time, as a stream would find them."""

    def build():
        root = scratch_path(spark, f"slices-{kind}")
        first, last = span(spark, sf_dir)
        rows, order = {
            "nation": lambda: (demo.samples(spark, sf_dir, "nation"), "timestamp_ms"),
            "marked": lambda: (demo.samples(spark, sf_dir, "nation"), "timestamp_ms"),
            "customer": lambda: (demo.samples(spark, sf_dir, "customer"), "timestamp_ms"),
            "health": lambda: (demo.health_samples(spark, sf_dir), "timestamp_ms"),
            "arrivals": lambda: (demo.arrivals(spark, sf_dir), "arrival_ms"),
        }[kind]()
        step = (last - first) // SLICES + 1
        part = F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor((F.col(order) - first) / step)))
        numbered = rows.withColumn("_slice", part.cast("int"))
        # The samples are joined once, not for every slice.
        with passing(spark, numbered, "numbered") as once:
            for i in range(SLICES):
                once.where(F.col("_slice") == i).drop("_slice").write.parquet(f"{root}/slice-{i}")
            for i in range(SLICES, SLICES + 2 * (kind == "marked")):
                marker = once.drop("_slice").where("valid and value_type = 'gauge'").limit(1).withColumns(
                    {"namespace": F.lit(MARKER), "timestamp_ms": F.lit(last + i * DAY_MS).cast("bigint")}
                )
                marker.write.parquet(f"{root}/slice-{i}")
        return root

    return _once(spark, sf_dir, f"slices-{kind}", build)


def slice_glob(root: str, upto: int) -> str:
    return root + "/slice-{" + ",".join(str(i) for i in range(upto + 1)) + "}"
