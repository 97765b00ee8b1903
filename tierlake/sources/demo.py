"""Samples and inventory derived from the test tables.

Events become poll samples, customers become targets, their event types
become pollers, regions become namespaces.  ``plans.twin`` states the same
tables as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierlake.functions.buckets import ntz_millis
from tierlake.functions.paths import ancestors
from tierlake.operators.views import SmartFolder, View
from tierlake.schemas import COUNTER_TYPE, DAY_MS, HOUR_MS

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# 2024-01-31 00:00 UTC, just past the newest event.
NOW_MS = 1_706_659_200_000
LATE_MS = 26 * HOUR_MS


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _millis(df: DataFrame, column: str):
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return ntz_millis(column)
    return F.unix_millis(column)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and region names; both tables have a fixed handful of rows."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_regionkey", "r_name"
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    places = _places(spark, sf_dir)
    return c.join(places, c.c_nationkey == places.n_nationkey)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    rows = e.select(
        "event_id",
        _millis(e, "ts").alias("timestamp_ms"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    # Customers are joined before the place names: their size is then known
    # to the planner, which broadcasts them only when they are small.
    named = rows.join(c, F.col("user_id") == F.col("c_custkey"))
    return named.join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))


def _target(grain: str):
    if grain not in ("nation", "customer"):
        raise ValueError("grain must be nation or customer")
    return F.col("n_name" if grain == "nation" else "c_name").alias("target")


def samples(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "counter")
        .when(F.col("event_type") == "error", "text")
        .otherwise("gauge")
    )
    valid = F.col("k") % 10 != 0
    return events(spark, sf_dir).select(
        F.col("r_name").alias("namespace"),
        _target(grain),
        F.col("event_type").alias("poller"),
        "timestamp_ms",
        kind.alias("value_type"),
        F.when((kind == "gauge") & valid, F.col("value")).alias("value_gauge"),
        F.when((kind == "counter") & valid, F.col("event_id")).cast(COUNTER_TYPE).alias("value_counter"),
        F.when((kind == "text") & valid, F.col("props")).alias("value_text"),
        valid.alias("valid"),
        F.when(valid, F.lit(None).cast("string"))
        .when(F.col("k") % 20 == 0, "get: request timeout")
        .otherwise("get: connection refused")
        .alias("error"),
        F.col("k").alias("poll_ms"),
        F.col("event_id").alias("seq"),
    )


def health_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per nation where every error event is a failed poll."""
    ok = F.col("event_type") != "error"
    return events(spark, sf_dir).select(
        F.col("r_name").alias("namespace"),
        F.col("n_name").alias("target"),
        F.lit("poll").alias("poller"),
        "timestamp_ms",
        F.lit("gauge").alias("value_type"),
        F.when(ok, F.col("value")).alias("value_gauge"),
        F.lit(None).cast(COUNTER_TYPE).alias("value_counter"),
        F.lit(None).cast("string").alias("value_text"),
        ok.alias("valid"),
        F.when(~ok, F.concat(F.lit("error "), F.col("k").cast("string"))).alias("error"),
        F.col("k").alias("poll_ms"),
        F.col("event_id").alias("seq"),
    )


def wrap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that pass 2^32 again and again, one series per nation and event type."""
    return samples(spark, sf_dir, "nation").select(
        "namespace",
        "target",
        "poller",
        "timestamp_ms",
        F.lit("counter").alias("value_type"),
        F.lit(None).cast("double").alias("value_gauge"),
        F.when(F.col("valid"), F.expr("(seq * 40503077) % 4294967296")).cast(COUNTER_TYPE).alias("value_counter"),
        F.lit(None).cast("string").alias("value_text"),
        "valid",
        "error",
        "poll_ms",
        "seq",
    )


def poll_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped poll results; some carry a kind that no poll can read, or a number that is not finite."""
    kind = (
        F.when(F.col("k") == 7, "NoSuchObject")
        .when(F.col("k") == 13, "Opaque")
        .when(F.col("event_type") == "signup", "Counter64")
        .when(F.col("event_type") == "error", "OctetString")
        .when(F.col("event_type") == "click", "Gauge32")
        .otherwise("Integer")
    )
    raw = (
        F.when(F.col("event_type").isin("click", "view") & (F.col("k") == 17), "Infinity")
        .when(F.col("event_type").isin("click", "view") & (F.col("k") == 19), "NaN")
        .when(F.col("event_type") == "signup", F.col("event_id").cast("string"))
        .when(F.col("event_type") == "error", F.col("props"))
        .otherwise(F.col("k").cast("string"))
    )
    failed = F.col("k") % 10 == 0
    return events(spark, sf_dir).select(
        F.col("r_name").alias("namespace"),
        F.col("n_name").alias("target"),
        F.col("event_type").alias("poller"),
        "timestamp_ms",
        kind.alias("kind"),
        raw.alias("raw"),
        F.when(failed & (F.col("k") % 20 == 0), "get: request timeout")
        .when(failed, "get: connection refused")
        .alias("error"),
        F.col("k").alias("poll_ms"),
        F.col("event_id").alias("seq"),
    )


def samples_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples over several years, one series per supplier and return flag."""
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    places = _places(spark, sf_dir).select("n_nationkey", "r_name")
    homes = supplier.join(places, supplier.s_nationkey == places.n_nationkey)
    return line.select(
        "l_suppkey",
        "l_returnflag",
        "l_extendedprice",
        "l_orderkey",
        "l_linenumber",
        _millis(line, "l_shipdate").alias("timestamp_ms"),
    ).join(homes, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("r_name").alias("namespace"),
        F.col("s_name").alias("target"),
        F.col("l_returnflag").alias("poller"),
        "timestamp_ms",
        F.lit("gauge").alias("value_type"),
        F.col("l_extendedprice").alias("value_gauge"),
        F.lit(None).cast(COUNTER_TYPE).alias("value_counter"),
        F.lit(None).cast("string").alias("value_text"),
        F.lit(True).alias("valid"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("poll_ms"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with an arrival time; every fiftieth comes 26 hours late."""
    late = F.when(F.col("seq") % 50 == 0, LATE_MS).otherwise(0)
    return samples(spark, sf_dir, "nation").withColumn("arrival_ms", F.col("timestamp_ms") + late)


# Inventory ---------------------------------------------------------------

_DEFAULT_TEXT = [
    "community",
    "security_name",
    "security_level",
    "auth_protocol",
    "auth_password",
    "priv_protocol",
    "priv_password",
]
_DEFAULT_NUMBERS = ["interval_ms", "timeout_ms", "retries", "buffer_size"]


def _defaults(**given):
    """The defaults struct of a level; what is not given is NULL and inherits."""
    fields = [given.get(n, F.lit(None)).cast("string").alias(n) for n in _DEFAULT_TEXT]
    fields += [given.get(n, F.lit(None)).cast("int").alias(n) for n in _DEFAULT_NUMBERS]
    return F.struct(*fields).alias("defaults")


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("name"),
        F.concat(F.lit("Region "), F.col("r_name")).alias("description"),
        _defaults(
            interval_ms=F.when(key % 2 == 0, F.lit(5000)),
            community=F.when(key < 4, F.lit("ro")),
        ),
        F.lit("yaml").alias("source"),
        F.lit(1).alias("version"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    site = F.when(key % 9 != 0, F.concat(F.lit("dc"), (key % 4).cast("string")))
    labels = F.map_filter(
        F.create_map(
            F.lit("nation"), F.col("n_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("site"), site
        ),
        lambda k, v: v.isNotNull(),
    )
    host = F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"), (key % 256).cast("string"), F.lit("1"))
    return customers(spark, sf_dir).select(
        F.col("r_name").alias("namespace"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("Customer "), key.cast("string")).alias("description"),
        labels.alias("labels"),
        F.array(
            F.concat_ws("/", F.lit("geo"), F.col("r_name"), F.col("n_name")),
            F.concat(F.lit("segment/"), F.col("c_mktsegment")),
        ).alias("tags"),
        host.alias("host"),
        F.lit(161).alias("port"),
        F.when(key % 10 == 3, "ping").otherwise("snmp").alias("protocol"),
        _defaults(timeout_ms=F.when(key % 7 == 0, F.lit(3000)), retries=F.when(key % 5 == 0, F.lit(0))),
        F.lit("yaml").alias("source"),
        F.lit(1).alias("version"),
        key.alias("custkey"),
    )


def pollers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("custkey")
    polling = F.struct(
        F.when(key % 6 == 0, F.lit(1000)).when(key % 6 == 1, F.lit(0)).cast("int").alias("interval_ms"),
        F.lit(None).cast("int").alias("timeout_ms"),
        F.lit(None).cast("int").alias("retries"),
        F.when(key % 8 == 0, F.lit(600)).cast("int").alias("buffer_size"),
    )
    oid = F.when(key % 50 != 1, F.lit("1.3.6.1.2.1.1.3.0")).otherwise(F.lit(""))
    owners = targets(spark, sf_dir).select(
        "namespace",
        F.col("name").alias("target"),
        F.col("description"),
        F.col("protocol"),
        F.to_json(F.struct(oid.alias("oid"))).alias("protocol_config"),
        polling.alias("polling"),
        F.when(key % 4 == 0, "disabled").otherwise("enabled").alias("admin_state"),
        # Running unless disabled; every thirteenth target is stopped by hand.
        F.when((key % 4 == 0) | (key % 13 == 0), "stopped").otherwise("running").alias("oper_state"),
        "source",
        "version",
        "custkey",
    )
    return owners.withColumn("name", F.explode(F.array(*[F.lit(e) for e in EVENT_TYPES])))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories, links to targets and pollers, and one dangling link per namespace."""
    base = F.concat_ws("/", F.lit("/geo"), F.col("r_name"), F.col("n_name"))
    c = customers(spark, sf_dir)
    links = (
        c.where(F.col("c_custkey") % 3 == 0)
        .select(
            F.col("r_name").alias("namespace"),
            F.concat_ws("/", base, F.col("c_name")).alias("path"),
            F.lit("link_target").alias("node_type"),
            F.concat(F.lit("target:"), F.col("c_name")).alias("link_ref"),
        )
        .unionByName(
            c.where(F.col("c_custkey") % 15 == 1).select(
                F.col("r_name").alias("namespace"),
                F.concat(base, F.lit("/"), F.col("c_name"), F.lit("-errors")).alias("path"),
                F.lit("link_poller").alias("node_type"),
                F.concat(F.lit("poller:"), F.col("c_name"), F.lit("/error")).alias("link_ref"),
            )
        )
    )
    places = _places(spark, sf_dir)
    leaves = places.select(F.col("r_name").alias("namespace"), base.alias("path"))
    directories = (
        leaves.unionByName(leaves.select("namespace", F.explode(ancestors(F.col("path"))).alias("path")))
        .distinct()
        .select(
            "namespace",
            "path",
            F.lit("directory").alias("node_type"),
            F.lit(None).cast("string").alias("link_ref"),
        )
    )
    dangling = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("namespace"),
        F.concat_ws("/", F.lit("/geo"), F.col("r_name"), F.lit("gone")).alias("path"),
        F.lit("link_target").alias("node_type"),
        F.lit("target:gone").alias("link_ref"),
    )
    return links.unionByName(directories).unionByName(dangling)


VIEWS = [
    View("by-nation", "/by-nation/{label:nation}/{name}", "target", priority=50),
    View("by-site", "/by-site/{label:site}/{name}", "target", filter_expr="label:site", priority=40),
    View("by-segment", "/by-segment/{target:segment}/{target}/{name}", "poller", priority=50),
]

SMART_FOLDERS = [
    SmartFolder("/smart/machinery", "label:segment = MACHINERY"),
    SmartFolder("/smart/edge-sites", "label:site in [dc0, dc1]"),
    SmartFolder("/smart/all", "everything"),
    SmartFolder("/by-site/dc1", "label:segment = FURNITURE", priority=45),
]


def owned_pollers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pollers of an inventory in which some targets own none."""
    return pollers(spark, sf_dir).where(F.col("custkey") % 21 != 0)


def remaining_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces after one of them has gone."""
    return namespaces(spark, sf_dir).where(F.col("name") != "ASIA")


def remaining_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets after some of them have gone."""
    return targets(spark, sf_dir).where(F.col("custkey") % 40 != 0)


def series_to_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pollers of every target of a namespace."""
    rows = samples(spark, sf_dir, "nation").select("namespace", "target", "poller").distinct()
    return rows.where((F.col("namespace") == "ASIA") & F.col("poller").isin("view", "error"))


def invalidated(rows: DataFrame, day_ms: int) -> DataFrame:
    """Samples of which those of one day have turned out to be invalid."""
    hit = F.floor(F.col("timestamp_ms") / DAY_MS) == day_ms // DAY_MS
    return rows.withColumn("valid", F.col("valid") & ~hit)


def stored_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored side of a reconciliation: some rows missing, changed, or left over."""
    key = F.col("custkey")
    declared = targets(spark, sf_dir)
    source = F.when(key % 5 == 0, "api").otherwise("yaml")
    kept = declared.where(key % 11 != 0).withColumns(
        {
            "description": F.when(key % 13 == 0, F.lit("changed by hand")).otherwise(F.col("description")),
            "labels": F.when(key % 19 == 0, F.map_filter("labels", lambda k, v: k != "segment")).otherwise(
                F.col("labels")
            ),
            "source": source,
            "version": F.lit(3),
        }
    )
    left_over = declared.where(key % 17 == 0).withColumns(
        {"name": F.concat(F.lit("old-"), F.col("name")), "source": source, "version": F.lit(2)}
    )
    return kept.unionByName(left_over)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    key = F.col("c_custkey")
    return c.where((key % 10).isin(0, 1)).select(
        F.concat(F.lit("session-"), (key % 7).cast("string")).alias("subscriber"),
        F.col("r_name").alias("namespace"),
        F.col("c_name").alias("target"),
        F.when(key % 10 == 1, F.lit("click")).alias("poller"),
    )
