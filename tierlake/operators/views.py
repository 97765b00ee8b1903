"""Views and smart folders: virtual paths of entities from templates and saved queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.functions.labels import label, label_filter, saved_query, template_path

# Default priorities; the higher one wins a name.
STATIC_PRIORITY = 100
VIEW_PRIORITY = 50
SMART_PRIORITY = 25


@dataclass(frozen=True)
class View:
    """A path template over targets or pollers; without a namespace it holds in all of them."""

    name: str
    path_template: str
    entity_type: str
    filter_expr: str = ""
    priority: int = VIEW_PRIORITY
    enabled: bool = True
    namespace: str | None = None


@dataclass(frozen=True)
class SmartFolder:
    """A saved query mounted at a path."""

    path: str
    target_query: str
    priority: int = SMART_PRIORITY
    enabled: bool = True
    namespace: str | None = None


def _here(namespace: str | None) -> Column:
    return F.lit(True) if namespace is None else F.col("namespace") == namespace


def _view_rows(views: list[View], entity_type: str, path_of) -> Column:
    """All paths of one entity, one array element per view that applies."""
    rows = [
        F.when(
            _here(v.namespace) & label_filter(v.filter_expr),
            F.struct(
                path_of(v).alias("path"),
                F.lit(v.name).alias("view"),
                F.lit(v.priority).alias("priority"),
            ),
        )
        for v in views
        if v.enabled and v.entity_type == entity_type
    ]
    empty = F.array().cast("array<struct<path:string,view:string,priority:int>>")
    found = F.filter(F.array(*rows), lambda r: r["path"].isNotNull()) if rows else empty
    return F.inline(found)


def view_paths_targets(targets: DataFrame, views: list[View]) -> DataFrame:
    """Path of every target in every enabled target view that it satisfies."""

    def path_of(v):
        return template_path(v.path_template, F.col("name"), F.col("labels"))

    return targets.select(
        "namespace",
        "name",
        F.concat(F.lit("target:"), F.col("name")).alias("link_ref"),
        _view_rows(views, "target", path_of),
    )


def view_paths_pollers(targets: DataFrame, pollers: DataFrame, views: list[View]) -> DataFrame:
    """Path of every poller in every enabled poller view; filters read the labels of its target."""
    parents = targets.select("namespace", F.col("name").alias("target"), "labels")
    rows = pollers.select("namespace", "target", "name").join(parents, ["namespace", "target"])

    def path_of(v):
        return template_path(v.path_template, F.col("name"), F.col("labels"), F.col("target"))

    return rows.select(
        "namespace",
        "target",
        "name",
        F.concat(F.lit("poller:"), F.col("target"), F.lit("/"), F.col("name")).alias("link_ref"),
        _view_rows(views, "poller", path_of),
    )


def view_group_counts(targets: DataFrame, first: str, second: str) -> DataFrame:
    """Targets per label and per pair of labels; targets without a label are left out of its level."""
    labels = F.col("labels")
    keyed = targets.select("namespace", label(labels, first).alias("first"), label(labels, second).alias("second"))
    per_pair = keyed.where(F.col("first").isNotNull()).groupBy("namespace", "first", "second").agg(
        F.count("*").alias("n")
    )
    rolled = per_pair.rollup("namespace", "first", "second").agg(
        F.sum("n").alias("targets"), F.grouping_id().alias("_g")
    )
    upper, lower = F.col("_g") == 1, (F.col("_g") == 0) & F.col("second").isNotNull()
    return rolled.where(upper | lower).select(
        "namespace", F.when(upper, 1).otherwise(2).alias("level"), "first", "second", "targets"
    )


def smart_folder_targets(targets: DataFrame, folders: list[SmartFolder]) -> DataFrame:
    """Targets in every enabled smart folder, each once per folder."""
    rows = [
        F.when(
            _here(f.namespace) & saved_query(f.target_query),
            F.struct(F.lit(f.path).alias("folder"), F.lit(f.priority).alias("priority")),
        )
        for f in folders
        if f.enabled and f.target_query
    ]
    found = F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<folder:string,priority:int>>")
    return targets.select(
        "namespace",
        "name",
        F.concat(F.lit("target:"), F.col("name")).alias("link_ref"),
        F.inline(found),
    )


def smart_folder_status(info: DataFrame, now_ms: int, error_rate: float = 0.1, recent_ms: int = 300_000) -> DataFrame:
    """Pollers in the saved status folders: high error rate, recent errors, disabled."""
    rate = F.col("polls_failed") / F.nullif(F.col("polls_total"), F.lit(0))
    tests = {
        "high-error-rate": rate > error_rate,
        "recent-errors": (F.col("last_error") != "") & (F.lit(now_ms) - F.col("last_poll_at") < recent_ms),
        "disabled": F.col("admin_state") == "disabled",
    }
    folders = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return info.select("namespace", "target", "poller", F.explode(folders).alias("folder"))
