"""The tree of directories and links, and its merge with views and smart folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.functions.paths import (
    ancestors,
    below,
    clean_path,
    last_name,
    link_poller,
    link_target,
    link_type,
    normalise_path,
    parent_path,
)
from tierlake.operators.views import (
    STATIC_PRIORITY,
    SmartFolder,
    View,
    smart_folder_targets,
    view_paths_targets,
)
from tierlake.schemas import SERIES

ENTRY = ["namespace", "parent", "name", "path", "type", "link_ref", "priority", "source"]


def tree_children(nodes: DataFrame, ns: str, path: str) -> DataFrame:
    """Direct children of a directory, by path."""
    rows = nodes.where((F.col("namespace") == ns) & (parent_path(F.col("path")) == clean_path(path)))
    return rows.orderBy("path")


def tree_ancestors(nodes: DataFrame) -> DataFrame:
    """All directories that the paths imply."""
    return nodes.select("namespace", F.explode(ancestors(F.col("path"))).alias("path")).distinct()


def tree_subtree(nodes: DataFrame, ns: str, path: str) -> DataFrame:
    """A node and everything below it; the prefix is literal."""
    path = clean_path(path)
    return nodes.where((F.col("namespace") == ns) & ((F.col("path") == path) | below(F.col("path"), path)))


def _winners(entries: DataFrame) -> DataFrame:
    """One entry per name in a directory: highest priority, then static, view, smart, then path order.

    The entries are moved by name before a minimum over a struct is taken,
    which has to sort: its tasks then have the bounded size of shuffled
    pieces, not that of an input file.  A directory that many paths imply
    comes here as one row for each view priority.
    """
    rank = F.when(F.col("source") == "static", 0).when(F.col("source") == "view", 1).otherwise(2)
    order = F.struct(
        (-F.col("priority")).alias("low_first"),
        rank.alias("rank"),
        "type",
        "path",
        "link_ref",
        "priority",
        "source",
    )
    names = ["namespace", "parent", "name"]
    best = entries.repartition(*names).groupBy(*names).agg(F.min(order).alias("e"))
    return best.select("namespace", "parent", "name", "e.path", "e.type", "e.link_ref", "e.priority", "e.source")


def _static_entries(nodes: DataFrame) -> DataFrame:
    path = F.col("path")
    return nodes.where(path != "/").select(
        "namespace",
        parent_path(path).alias("parent"),
        last_name(path).alias("name"),
        "path",
        F.col("node_type").alias("type"),
        "link_ref",
        F.lit(STATIC_PRIORITY).alias("priority"),
        F.lit("static").alias("source"),
    )


def _smart_entries(targets: DataFrame, folders: list[SmartFolder]) -> DataFrame:
    return smart_folder_targets(targets, folders).select(
        "namespace",
        F.col("folder").alias("parent"),
        "name",
        F.concat_ws("/", "folder", "name").alias("path"),
        F.lit("link_target").alias("type"),
        "link_ref",
        "priority",
        F.lit("smart").alias("source"),
    )


def _view_links(paths: DataFrame) -> DataFrame:
    """The entries of the paths themselves."""
    path = F.col("path")
    return paths.select(
        "namespace",
        parent_path(path).alias("parent"),
        last_name(path).alias("name"),
        "path",
        F.lit("link_target").alias("type"),
        "link_ref",
        "priority",
        F.lit("view").alias("source"),
    )


def _view_directories(paths: DataFrame) -> DataFrame:
    """Entries of directories (`namespace, path, priority`) that many paths imply: one row each, by a maximum of numbers alone."""
    path = F.col("path")
    return paths.groupBy("namespace", "path").agg(F.max("priority").alias("priority")).select(
        "namespace",
        parent_path(path).alias("parent"),
        last_name(path).alias("name"),
        "path",
        F.lit("directory").alias("type"),
        F.lit(None).cast("string").alias("link_ref"),
        "priority",
        F.lit("view").alias("source"),
    )


def tree_browse(
    nodes: DataFrame, targets: DataFrame, views: list[View], folders: list[SmartFolder], ns: str, path: str
) -> DataFrame:
    """Entries of one directory from static nodes, views and smart folders, by name."""
    path = clean_path(path)
    own = targets.where(F.col("namespace") == ns)
    paths = view_paths_targets(own, views).where(below(F.col("path"), path))
    prefix = "/" if path == "/" else path + "/"
    child = F.substring_index(F.substr(F.col("path"), F.lit(len(prefix) + 1)), "/", 1)
    at = F.concat(F.lit(prefix), child)
    links = _view_links(paths.where(at == F.col("path")))
    directories = _view_directories(paths.where(at != F.col("path")).select("namespace", at.alias("path"), "priority"))
    from_views = links.unionByName(directories)
    static = _static_entries(nodes.where(F.col("namespace") == ns)).where(F.col("parent") == path)
    smart = _smart_entries(own, [f for f in folders if clean_path(f.path) == path])
    return _winners(static.unionByName(from_views).unionByName(smart)).orderBy("name")


def tree_browse_all(
    nodes: DataFrame, targets: DataFrame, views: list[View], folders: list[SmartFolder]
) -> DataFrame:
    """Entries of every directory at once: the materialised tree."""
    paths = view_paths_targets(targets, views)
    above = paths.select("namespace", F.explode(ancestors(F.col("path"))).alias("path"), "priority")
    from_views = _view_links(paths).unionByName(_view_directories(above))
    return _winners(
        _static_entries(nodes).unionByName(from_views).unionByName(_smart_entries(targets, folders))
    )


def with_link(nodes: DataFrame) -> DataFrame:
    ref = F.col("link_ref")
    return nodes.where(ref.isNotNull()).withColumns(
        {"link_type": link_type(ref), "target": link_target(ref), "poller": link_poller(ref)}
    )


def link_resolve(nodes: DataFrame, targets: DataFrame, info: DataFrame) -> DataFrame:
    """Links with the target they point to and, for poller links, the three states."""
    links = with_link(nodes).select("namespace", "path", "node_type", "link_ref", "link_type", "target", "poller")
    t = targets.select("namespace", F.col("name").alias("target"), "host", "protocol")
    p = info.select(*SERIES, "admin_state", "oper_state", "health")
    return links.join(t, ["namespace", "target"], "left").join(p, SERIES, "left")


def dangling_links(nodes: DataFrame, targets: DataFrame, pollers: DataFrame) -> DataFrame:
    """Links whose target or poller is gone."""
    links = with_link(nodes).select("namespace", "path", "link_ref", "link_type", "target", "poller")
    t = targets.select("namespace", F.col("name").alias("target"))
    p = pollers.select("namespace", "target", F.col("name").alias("poller"))
    to_target = links.where(F.col("link_type") == "target").join(t, ["namespace", "target"], "left_anti")
    to_poller = links.where(F.col("link_type") == "poller").join(p, SERIES, "left_anti")
    broken = links.where(F.col("link_type").isNull())
    columns = ["namespace", "path", "link_ref"]
    return to_target.select(columns).unionByName(to_poller.select(columns)).unionByName(broken.select(columns))


def links_to(nodes: DataFrame, ns: str, target: str, poller: str | None = None, with_pollers: bool = False) -> DataFrame:
    """Paths that link to a target, to one poller, or to a target and all its pollers."""
    ref = F.col("link_ref")
    if poller is not None:
        test = ref == f"poller:{target}/{poller}"
    elif with_pollers:
        test = (ref == f"target:{target}") | F.startswith(ref, F.lit(f"poller:{target}/"))
    else:
        test = ref == f"target:{target}"
    return nodes.where((F.col("namespace") == ns) & test).select("namespace", "path", "link_ref")


def links_count(nodes: DataFrame) -> DataFrame:
    """Links to every target, and to it or any of its pollers."""
    return (
        with_link(nodes)
        .where(F.col("target").isNotNull())
        .groupBy("namespace", "target")
        .agg(F.count_if(F.col("link_type") == "target").alias("links"), F.count("*").alias("links_with_pollers"))
    )


def path_resolve(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Type, target and poller behind each (namespace, path); type is NULL when nothing is there.

    /targets/T and /targets/T/P name an entity, /tree/... follows the tree.
    """
    asked = requests.withColumn("_path", normalise_path(F.col("path")))
    parts = F.split("_path", "/")
    named = F.startswith(F.col("_path"), F.lit("/targets/")) & F.size(parts).isin(3, 4)
    in_tree = F.startswith(F.col("_path"), F.lit("/tree/"))
    asked = asked.withColumns(
        {
            "_kind": F.when(named & (F.size(parts) == 3), "target").when(named, "poller"),
            "_t": F.when(named, F.get(parts, F.lit(2))),
            "_p": F.when(named, F.get(parts, F.lit(3))),
            "_node": F.when(in_tree, F.substr(F.col("_path"), F.lit(6))),
        }
    )
    tree = nodes.select("namespace", F.col("path").alias("_node"), "node_type", "link_ref")
    ref = F.col("link_ref")
    found = asked.join(tree, ["namespace", "_node"], "left")
    kind = F.coalesce("_kind", F.when(F.col("node_type") == "directory", "directory"), link_type(ref))
    return found.select(
        *requests.columns,
        kind.alias("type"),
        F.coalesce("_t", link_target(ref)).alias("target"),
        F.coalesce("_p", link_poller(ref)).alias("poller"),
    )


def target_listing(targets: DataFrame, stats: DataFrame) -> DataFrame:
    """Browse rows of all targets with their totals."""
    rows = targets.select(
        "namespace",
        "name",
        F.concat(F.lit("/targets/"), F.col("name")).alias("path"),
        F.lit("target").alias("type"),
        "description",
    )
    totals = stats.select(
        "namespace", F.col("target").alias("name"), "pollers", "polls_total", "polls_success", "polls_failed"
    )
    counts = ["pollers", "polls_total", "polls_success", "polls_failed"]
    return rows.join(totals, ["namespace", "name"], "left").na.fill(0, counts)


def poller_listing(info: DataFrame) -> DataFrame:
    """Browse rows of all pollers with their three states."""
    return info.select(
        "namespace",
        "target",
        F.col("poller").alias("name"),
        F.concat(F.lit("/targets/"), F.col("target"), F.lit("/"), F.col("poller")).alias("path"),
        F.lit("poller").alias("type"),
        "description",
        "admin_state",
        "oper_state",
        "health",
    )
