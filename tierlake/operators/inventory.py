"""Listing, paging, labels, filters and deletion of inventory entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.functions.labels import label, label_filter
from tierlake.functions.paths import glob_match, link_target
from tierlake.operators.tags import has_tags, one_update
from tierlake.schemas import SERIES

# Fixed value: page size of a browse that names none.
DEFAULT_PAGE = 100


def list_namespaces(namespaces: DataFrame) -> DataFrame:
    return namespaces.orderBy("name")


def list_targets(targets: DataFrame, ns: str | None = None) -> DataFrame:
    rows = targets.where(F.col("namespace") == ns) if ns else targets
    return rows.orderBy("namespace", "name")


def list_pollers(pollers: DataFrame, ns: str | None = None, target: str | None = None) -> DataFrame:
    rows = pollers.where(F.col("namespace") == ns) if ns else pollers
    rows = rows.where(F.col("target") == target) if target else rows
    return rows.orderBy("namespace", "target", "name")


def page(df: DataFrame, order_col: str, cursor: str | None = None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page after the cursor in the order of a unique column.

    next_cursor repeats the last value kept and is NULL on the last page.
    """
    limit = limit if limit > 0 else DEFAULT_PAGE
    rows = df.where(F.col(order_col) > cursor) if cursor else df
    # One row more than the page tells whether another page follows; the
    # windows see only these few rows.
    head = rows.orderBy(order_col).limit(limit + 1).withColumn("_all", F.lit(1))
    every = Window.partitionBy("_all")
    placed = head.withColumns(
        {"_place": F.row_number().over(every.orderBy(order_col)), "_size": F.count("*").over(every)}
    ).where(F.col("_place") <= limit)
    last = F.max(order_col).over(every)
    paged = placed.withColumn("next_cursor", F.when(F.col("_size") > limit, last))
    return paged.drop("_all", "_place", "_size")


def page_targets(
    targets: DataFrame, ns: str, cursor: str | None = None, limit: int = DEFAULT_PAGE, label_expr: str = ""
) -> DataFrame:
    rows = targets.where(F.col("namespace") == ns).where(label_filter(label_expr))
    return page(rows, "name", cursor, limit)


def targets_by_label(targets: DataFrame, key: str, value: str) -> DataFrame:
    return targets.where(label(F.col("labels"), key) == value)


def targets_with_label(targets: DataFrame, key: str) -> DataFrame:
    return targets.where(F.map_contains_key("labels", F.lit(key)))


def label_values(targets: DataFrame, key: str) -> DataFrame:
    value = label(F.col("labels"), key).alias("value")
    return targets.select(value).where(F.col("value").isNotNull()).distinct().orderBy("value")


def label_histogram(targets: DataFrame) -> DataFrame:
    """Targets per label key and value."""
    pairs = targets.select("namespace", F.explode("labels").alias("key", "value"))
    return pairs.groupBy("namespace", "key", "value").agg(F.count("*").alias("targets"))


def set_labels(targets: DataFrame, updates: DataFrame, merge: bool = False, order: str | None = None) -> DataFrame:
    """Replace the labels of the targets listed in updates (namespace, name, labels), or merge into them.

    Of several updates of one target the one that is last by the column order
    counts; without order they are an error.
    """
    given = one_update(updates, order).select("namespace", "name", F.col("labels").alias("_new"))
    joined = targets.join(given, ["namespace", "name"], "left")
    if merge:
        now = F.coalesce("labels", F.create_map().cast("map<string,string>"))
        kept = F.map_filter(now, lambda k, v: ~F.map_contains_key(F.col("_new"), k))
        changed = F.map_concat(kept, F.col("_new"))
    else:
        changed = F.col("_new")
    return joined.withColumn("labels", F.when(F.col("_new").isNotNull(), changed).otherwise(F.col("labels"))).select(
        targets.columns
    )


def enabled_pollers(pollers: DataFrame) -> DataFrame:
    """Enabled pollers, with whether each could be started now."""
    return pollers.where(F.col("admin_state") == "enabled").withColumn(
        "startable", F.col("oper_state") == "stopped"
    )


def filter_targets(
    targets: DataFrame,
    state: str | None = None,
    protocol: str | None = None,
    tags: list[str] | None = None,
    host: str | None = None,
) -> DataFrame:
    """Conjunction of all given filters; none given keeps every target."""
    for column, value in (("state", state), ("protocol", protocol)):
        if value:
            targets = targets.where(F.col(column) == value)
    if tags:
        targets = targets.where(has_tags(F.col("tags"), tags))
    return targets.where(glob_match(F.col("host"), host)) if host else targets


def host_glob(targets: DataFrame, pattern: str) -> DataFrame:
    return targets.where(glob_match(F.col("host"), pattern))


def index_counts(targets: DataFrame) -> DataFrame:
    """Numbers of states, protocols and hosts, and targets per state and per protocol."""
    pairs = targets.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
                    for k, c in (("state", "state"), ("protocol", "protocol"), ("host", "host"))
                ]
            )
        ).alias("p")
    ).select("p.*")
    # One row per kind and value; the totals below are sums over these.
    per_value = pairs.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("kind", "value").agg(
        F.count("*").alias("n")
    )
    distinct = per_value.groupBy("kind").agg(F.count("*").alias("n")).select(
        F.concat("kind", F.lit("s")).alias("name"), "n"
    )
    each = per_value.where(F.col("kind") != "host").select(F.concat_ws("_", "kind", "value").alias("name"), "n")
    return distinct.unionByName(each)


def delete_preview(
    namespaces: DataFrame, targets: DataFrame, pollers: DataFrame, nodes: DataFrame, samples: DataFrame
) -> DataFrame:
    """What a forced delete of each target, and of each namespace, would remove."""
    keys = ["namespace", "target"]
    ref = F.col("link_ref")
    links = (
        nodes.where(ref.isNotNull())
        .select("namespace", link_target(ref).alias("target"))
        .groupBy(*keys)
        .agg(F.count("*").alias("links"))
    )
    # Only pollers that exist are deleted, and their samples with them.
    owned = pollers.select("namespace", "target", F.col("name").alias("poller"))
    stored = samples.groupBy(*SERIES).agg(F.count("*").alias("samples"))
    per_poller = owned.join(stored, SERIES, "left").groupBy(*keys).agg(
        F.count("*").alias("pollers"), F.coalesce(F.sum("samples"), F.lit(0)).alias("samples")
    )
    per_target = (
        targets.select("namespace", F.col("name").alias("target"))
        .join(per_poller, keys, "left")
        .join(links, keys, "left")
        .na.fill(0)
    )
    all_nodes = nodes.groupBy("namespace").agg(F.count("*").alias("nodes"))
    per_namespace = per_target.groupBy("namespace").agg(
        F.count("*").alias("targets"),
        F.sum("pollers").alias("pollers"),
        F.sum("samples").alias("samples"),
    )
    whole = (
        namespaces.select(F.col("name").alias("namespace"))
        .join(per_namespace, "namespace", "left")
        .join(all_nodes, "namespace", "left")
        .na.fill(0)
        .select(
            F.lit("namespace").alias("scope"),
            "namespace",
            F.lit("").alias("target"),
            "targets",
            "pollers",
            F.col("nodes").alias("links"),
            "samples",
        )
    )
    single = per_target.select(
        F.lit("target").alias("scope"),
        *keys,
        F.lit(1).cast("bigint").alias("targets"),
        "pollers",
        "links",
        "samples",
    )
    return single.unionByName(whole)


def relation_count(parents: DataFrame, children: DataFrame, where: Column | None = None) -> DataFrame:
    """Related pollers of every target, optionally only those that pass a filter."""
    kept = children if where is None else children.where(where)
    counts = kept.groupBy("namespace", "target").agg(F.count("*").alias("related"))
    names = parents.select("namespace", F.col("name").alias("target"))
    return names.join(counts, ["namespace", "target"], "left").na.fill(0)


def metric_requests(entities: DataFrame, poller: str, start_ms: int, end_ms: int) -> DataFrame:
    """One span request per entity (namespace, target), as query_many takes them."""
    return entities.select(
        F.concat_ws("/", "namespace", "target").alias("request_id"),
        "namespace",
        "target",
        F.lit(poller).alias("poller"),
        F.lit(start_ms).cast("bigint").alias("start_ms"),
        F.lit(end_ms).cast("bigint").alias("end_ms"),
    )


def metric_column(entities: DataFrame, answers: DataFrame) -> DataFrame:
    """Mean and peak of a metric for every entity; NULL where nothing was measured."""
    measured = answers.groupBy("namespace", "target").agg(
        (F.sum("sum") / F.sum("count")).alias("metric"), F.max("max").alias("peak")
    )
    return entities.join(measured, ["namespace", "target"], "left")
