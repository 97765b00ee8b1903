"""Queries over inventory: listing, labels, tags, filters, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlake.functions.labels import label_filter
from tierlake.operators import inventory as inv, tags
from tierlake.operators.config import config_violations, effective_config
from tierlake.operators.health import health_current
from tierlake.operators.query import query_many
from tierlake.plans import store
from tierlake.plans.registry import query, rounded
from tierlake.plans.timeseries import DAY0, TIERS_SQL
from tierlake.plans.twin import sql
from tierlake.schemas import DAY_MS, SERIES
from tierlake.sources import demo, tagstore

LABELS_SQL = """array_to_string(list_sort(list_filter([CASE WHEN nation IS NOT NULL THEN 'nation=' || nation END,
    CASE WHEN segment IS NOT NULL THEN 'segment=' || segment END, CASE WHEN site IS NOT NULL THEN 'site=' || site END],
    lambda x: x IS NOT NULL)), ',') AS labels"""


def flat(df):
    """Labels and tags as sorted text, without the nested columns."""
    out = df
    if "labels" in df.columns:
        pairs = F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"]))
        out = out.withColumn("labels", F.array_join(F.array_sort(pairs), ","))
    if "tags" in df.columns:
        out = out.withColumn("tags", F.array_join(F.array_sort("tags"), ","))
    return out


def target_rows(df):
    return flat(df.select("namespace", "name", "description", "labels", "host", "protocol"))


TARGET_SQL = f"namespace, name, description, {LABELS_SQL}, host, protocol"


@query("list_namespaces", sql("SELECT name, description FROM ns ORDER BY name", "ns"))
def list_namespaces(spark, sf):
    return inv.list_namespaces(demo.namespaces(spark, sf)).select("name", "description")


@query("list_targets", sql(f"SELECT {TARGET_SQL} FROM targets", "targets"))
def list_targets(spark, sf):
    return target_rows(inv.list_targets(demo.targets(spark, sf)))


@query("list_pollers", sql("SELECT namespace, target, name, admin_state, protocol FROM pollers WHERE namespace = 'ASIA'", "pollers"))
def list_pollers(spark, sf):
    rows = inv.list_pollers(demo.pollers(spark, sf), "ASIA")
    return rows.select("namespace", "target", "name", "admin_state", "protocol")


@query(
    "page_targets",
    sql(
        """SELECT name, description, CASE WHEN rest > 40 THEN max(name) OVER () END AS next_cursor
           FROM (SELECT *, count(*) OVER () AS rest FROM targets
                 WHERE namespace = 'EUROPE' AND site IN ('dc0', 'dc1') AND name > 'Customer#000000020'
                 ORDER BY name LIMIT 40)""",
        "targets",
    ),
)
def page_targets(spark, sf):
    page = inv.page_targets(demo.targets(spark, sf), "EUROPE", "Customer#000000020", 40, "label:site in [dc0, dc1]")
    return page.select("name", "description", "next_cursor")


@query("targets_by_label", sql(f"SELECT {TARGET_SQL} FROM targets WHERE site = 'dc1'", "targets"))
def targets_by_label(spark, sf):
    return target_rows(inv.targets_by_label(demo.targets(spark, sf), "site", "dc1"))


@query("targets_with_label", sql(f"SELECT {TARGET_SQL} FROM targets WHERE site IS NOT NULL", "targets"))
def targets_with_label(spark, sf):
    return target_rows(inv.targets_with_label(demo.targets(spark, sf), "site"))


@query("label_values", sql("SELECT DISTINCT segment AS value FROM targets WHERE segment IS NOT NULL", "targets"))
def label_values(spark, sf):
    return inv.label_values(demo.targets(spark, sf), "segment")


@query(
    "label_histogram",
    sql(
        """SELECT namespace, key, value, count(*) AS targets
           FROM (SELECT namespace, 'nation' AS key, nation AS value FROM targets UNION ALL
                 SELECT namespace, 'segment', segment FROM targets UNION ALL SELECT namespace, 'site', site FROM targets)
           WHERE value IS NOT NULL GROUP BY ALL""",
        "targets",
    ),
)
def label_histogram(spark, sf):
    return inv.label_histogram(demo.targets(spark, sf))


def label_updates(spark, sf):
    """New labels for every fourth target."""
    rows = demo.targets(spark, sf).where(F.col("custkey") % 4 == 0)
    return rows.select("namespace", "name", F.create_map(F.lit("site"), F.lit("moved"), F.lit("rack"), F.lit("r1")).alias("labels"))


SET_SQL = """SELECT namespace, name, CASE WHEN custkey % 4 = 0 THEN {new} ELSE labels END AS labels
             FROM (SELECT *, {labels} FROM targets)"""


@query("set_labels", sql(SET_SQL.format(new="'rack=r1,site=moved'", labels=LABELS_SQL), "targets"))
def set_labels(spark, sf):
    return flat(inv.set_labels(demo.targets(spark, sf), label_updates(spark, sf)).select("namespace", "name", "labels"))


@query(
    "set_labels_merge",
    sql(
        SET_SQL.format(
            new="'nation=' || nation || ',rack=r1,segment=' || segment || ',site=moved'", labels=LABELS_SQL
        ),
        "targets",
    ),
)
def set_labels_merge(spark, sf):
    merged = inv.set_labels(demo.targets(spark, sf), label_updates(spark, sf), merge=True)
    return flat(merged.select("namespace", "name", "labels"))


FILTERS = {
    "exists": ("label:site", "site IS NOT NULL"),
    "equals": ("label:segment = MACHINERY", "segment = 'MACHINERY'"),
    "in": ("label:site in [dc0, dc2, dc9]", "coalesce(site, '') IN ('dc0', 'dc2', 'dc9')"),
    "and_or": (
        "label:site = dc1 OR label:segment = BUILDING AND label:nation in [NATION_1, NATION_2, NATION_3]",
        "(coalesce(site, '') = 'dc1' OR segment = 'BUILDING') AND nation IN ('NATION_1', 'NATION_2', 'NATION_3')",
    ),
    "empty": ("", "true"),
    "unknown": ("name ~ x", "false"),
}


@query(
    "label_filter",
    sql(
        "SELECT namespace, name, " + ", ".join(f"{test} AS is_{n}" for n, (_, test) in FILTERS.items()) + " FROM targets",
        "targets",
    ),
)
def label_filters(spark, sf):
    tests = [label_filter(text).alias(f"is_{n}") for n, (text, _) in FILTERS.items()]
    return demo.targets(spark, sf).select("namespace", "name", *tests)


@query(
    "enabled_pollers",
    sql("SELECT namespace, target, name, oper_state = 'stopped' AS startable FROM pollers WHERE admin_state = 'enabled'", "pollers"),
)
def enabled_pollers(spark, sf):
    return inv.enabled_pollers(demo.pollers(spark, sf)).select("namespace", "target", "name", "startable")


# Tags --------------------------------------------------------------------

INDEX_SQL = """SELECT DISTINCT namespace, name, tag FROM (
    SELECT namespace, name, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS tag
    FROM (SELECT namespace, name, string_split(unnest(tags), '/') AS parts FROM targets))"""


@query("tag_index", sql(INDEX_SQL, "targets"))
def tag_index(spark, sf):
    return tags.tag_index(demo.targets(spark, sf))


@query("tag_query", sql(f"SELECT namespace, name FROM ({INDEX_SQL}) WHERE tag = 'geo/ASIA'", "targets"))
def tag_query(spark, sf):
    return tagstore.with_tag(spark, store.tag_root(spark, sf), "geo/ASIA")


TWO_TAGS = ["geo/EUROPE", "segment/BUILDING"]


@query(
    "tag_query_and",
    sql(
        f"""SELECT namespace, name FROM ({INDEX_SQL}) WHERE tag IN ('geo/EUROPE', 'segment/BUILDING')
            GROUP BY ALL HAVING count(DISTINCT tag) = 2""",
        "targets",
    ),
)
def tag_query_and(spark, sf):
    return tagstore.with_all_tags(spark, store.tag_root(spark, sf), TWO_TAGS)


@query(
    "tag_query_or",
    sql(f"SELECT DISTINCT namespace, name FROM ({INDEX_SQL}) WHERE tag IN ('geo/EUROPE', 'segment/BUILDING')", "targets"),
)
def tag_query_or(spark, sf):
    return tagstore.with_any_tag(spark, store.tag_root(spark, sf), TWO_TAGS)


@query("tag_counts", sql(f"SELECT tag, count(*) AS targets FROM ({INDEX_SQL}) GROUP BY tag", "targets"))
def tag_counts(spark, sf):
    return tags.tag_counts(demo.targets(spark, sf))


@query(
    "tag_children",
    sql(
        """SELECT 'geo/AMERICA' AS prefix, 'dir' AS kind, '' AS namespace, nation AS name FROM targets WHERE namespace = 'AMERICA' GROUP BY nation
           UNION ALL SELECT '', 'dir', '', unnest(['geo', 'segment'])
           UNION ALL SELECT 'segment/FURNITURE', 'target', namespace, name FROM targets WHERE segment = 'FURNITURE'""",
        "targets",
    ),
)
def tag_children(spark, sf):
    targets = demo.targets(spark, sf)
    out = None
    for prefix in ("geo/AMERICA", "", "segment/FURNITURE"):
        part = tags.tag_children(targets, prefix).withColumn("prefix", F.lit(prefix))
        out = part if out is None else out.unionByName(part)
    return out


@query("has_tag", sql("SELECT namespace, name, namespace = 'AFRICA' AS has_tag FROM targets", "targets"))
def has_tag(spark, sf):
    return tags.has_tag(demo.targets(spark, sf), "geo/AFRICA")


@query(
    "update_tags",
    sql(
        """SELECT namespace, name, array_to_string(list_sort(CASE custkey % 3
                  WHEN 0 THEN ['a', 'b/c']
                  WHEN 1 THEN list_concat(list_filter(tags, lambda t: t <> 'segment/' || segment), ['owner/ops'])
                  ELSE tags END), ',') AS tags FROM targets""",
        "targets",
    ),
)
def update_tags(spark, sf):
    targets = demo.targets(spark, sf)
    key = F.col("custkey") % 3
    none = F.array().cast("array<string>")
    updates = targets.where(key < 2).select(
        "namespace",
        "name",
        F.array(F.lit("owner/ops"), F.lit("")).alias("add"),
        F.array(F.concat(F.lit("segment/"), F.element_at("labels", "segment"))).alias("remove"),
        F.when(key == 0, F.array(F.lit("b/c"), F.lit("a"))).otherwise(none).alias("set"),
    )
    return flat(tags.update_tags(targets, updates).select("namespace", "name", "tags"))


# Filters -----------------------------------------------------------------


def with_state(spark, sf):
    """Targets with the state of their click poller."""
    clicks = health_current(demo.samples(spark, sf, "customer")).where(F.col("poller") == "click")
    state = clicks.select("namespace", F.col("target").alias("name"), F.col("health").alias("state"))
    joined = demo.targets(spark, sf).join(state, ["namespace", "name"], "left")
    return joined.withColumn("state", F.coalesce("state", F.lit("unknown")))


STATE_CTE = """SELECT t.*, coalesce(h.health, 'unknown') AS state
    FROM targets t LEFT JOIN health h ON h.namespace = t.namespace AND h.target = t.name AND h.poller = 'click'"""


@query(
    "filter_targets",
    sql(
        """SELECT namespace, name FROM state_targets
           WHERE state = 'unknown' AND protocol = 'snmp' AND namespace IN ('ASIA') AND segment = 'BUILDING'
                 AND regexp_matches(host, '^10\\.[^/]*\\.1[^/]*\\.1$')""",
        "targets",
        "health",
        state_targets=STATE_CTE,
    ),
)
def filter_targets(spark, sf):
    found = inv.filter_targets(with_state(spark, sf), "unknown", "snmp", ["geo/ASIA", "segment/BUILDING"], "10.*.1*.1")
    return found.select("namespace", "name")


@query(
    "host_glob",
    sql("SELECT namespace, name, host FROM targets WHERE regexp_matches(host, '^10\\.[^/]\\.[12][^/][^/]\\.1$')", "targets"),
)
def host_glob(spark, sf):
    return inv.host_glob(demo.targets(spark, sf), "10.?.[12]??.1").select("namespace", "name", "host")


@query(
    "index_counts",
    sql(
        """SELECT 'states' AS name, count(DISTINCT state) AS n FROM state_targets
           UNION ALL SELECT 'protocols', count(DISTINCT protocol) FROM state_targets
           UNION ALL SELECT 'hosts', count(DISTINCT host) FROM state_targets
           UNION ALL SELECT 'state_' || state, count(*) FROM state_targets GROUP BY state
           UNION ALL SELECT 'protocol_' || protocol, count(*) FROM state_targets GROUP BY protocol""",
        "targets",
        "health",
        state_targets=STATE_CTE,
    ),
)
def index_counts(spark, sf):
    return inv.index_counts(with_state(spark, sf))


# Configuration -----------------------------------------------------------

SERVER = {"timeout_ms": 4000, "retries": 0, "interval_ms": 0}

CONFIG_SQL = """
  SELECT p.namespace, p.target, p.name AS poller, t.host, p.oid,
         coalesce(nullif(p_interval_ms, 0), n.interval_ms, 60000)::BIGINT AS interval_ms,
         CASE WHEN p_interval_ms > 0 THEN 'poller:' || p.name WHEN n.interval_ms > 0 THEN 'namespace:' || p.namespace
              ELSE 'default' END AS interval_ms_source,
         coalesce(t.timeout_ms, 4000)::BIGINT AS timeout_ms,
         CASE WHEN t.timeout_ms > 0 THEN 'target:' || p.target ELSE 'server' END AS timeout_ms_source,
         coalesce(t.retries, 2)::BIGINT AS retries,
         CASE WHEN t.retries IS NOT NULL THEN 'target:' || p.target ELSE 'default' END AS retries_source,
         coalesce(p_buffer_size, 3600)::BIGINT AS buffer_size,
         CASE WHEN p_buffer_size > 0 THEN 'poller:' || p.name ELSE 'default' END AS buffer_size_source,
         n.community, CASE WHEN n.community IS NOT NULL THEN 'namespace:' || p.namespace END AS community_source,
         coalesce(p_interval_ms, n.interval_ms, 60000)::BIGINT AS scheduled_interval_ms
  FROM pollers p LEFT JOIN targets t ON t.namespace = p.namespace AND t.name = p.target LEFT JOIN ns n ON n.name = p.namespace"""
CONFIG_COLUMNS = [
    *SERIES, "host", "oid", "interval_ms", "interval_ms_source", "timeout_ms", "timeout_ms_source", "retries",
    "retries_source", "buffer_size", "buffer_size_source", "community", "community_source", "scheduled_interval_ms",
]


def config(spark, sf):
    return effective_config(demo.namespaces(spark, sf), demo.targets(spark, sf), demo.pollers(spark, sf), SERVER)


@query("effective_config", sql(CONFIG_SQL, "pollers", "ns"))
def effective_configs(spark, sf):
    return config(spark, sf).select(CONFIG_COLUMNS)


@query(
    "delete_preview",
    sql(
        """SELECT 'target' AS scope, t.namespace, t.name AS target, 1::BIGINT AS targets, coalesce(p.n, 0) AS pollers,
                  coalesce(l.n, 0) AS links, coalesce(s.n, 0) AS samples
           FROM targets t LEFT JOIN (SELECT namespace, target, count(*) AS n FROM pollers GROUP BY ALL) p
                     ON p.namespace = t.namespace AND p.target = t.name
                LEFT JOIN (SELECT namespace, split_part(split_part(link_ref, ':', 2), '/', 1) AS target, count(*) AS n FROM nodes
                           WHERE link_ref IS NOT NULL GROUP BY ALL) l ON l.namespace = t.namespace AND l.target = t.name
                LEFT JOIN (SELECT namespace, target, count(*) AS n FROM csamples GROUP BY ALL) s
                     ON s.namespace = t.namespace AND s.target = t.name
           UNION ALL
           SELECT 'namespace', ns.name, '', (SELECT count(*) FROM targets WHERE namespace = ns.name),
                  (SELECT count(*) FROM pollers WHERE namespace = ns.name), (SELECT count(*) FROM nodes WHERE namespace = ns.name),
                  (SELECT count(*) FROM csamples WHERE namespace = ns.name) FROM ns""",
        "targets",
        "pollers",
        "nodes",
        "csamples",
        "ns",
    ),
)
def delete_preview(spark, sf):
    return inv.delete_preview(
        demo.namespaces(spark, sf),
        demo.targets(spark, sf),
        demo.pollers(spark, sf),
        demo.tree_nodes(spark, sf),
        demo.samples(spark, sf, "customer"),
    )


@query(
    "config_violations",
    sql(
        f"""SELECT namespace, target, poller, array_to_string(list_filter([CASE WHEN oid = '' THEN 'OID is required' END,
                   CASE WHEN community IS NULL THEN 'v2c requires community' END,
                   CASE WHEN contains(namespace, ' ') THEN 'invalid namespace name' END,
                   'invalid target name'], lambda x: x IS NOT NULL), '; ') AS reasons
            FROM ({CONFIG_SQL})""",
        "pollers",
        "ns",
    ),
)
def violations(spark, sf):
    # The names of the test customers hold a character that names may not.
    return config_violations(config(spark, sf)).withColumn("reasons", F.array_join("reasons", "; "))


# Planned entity columns ----------------------------------------------------


@query(
    "relation_count",
    sql(
        """SELECT t.namespace, t.name AS target, coalesce(n, 0) AS related FROM targets t
           LEFT JOIN (SELECT namespace, target, count(*) AS n FROM pollers WHERE admin_state = 'enabled' GROUP BY ALL) p
                ON p.namespace = t.namespace AND p.target = t.name""",
        "pollers",
    ),
)
def relation_count(spark, sf):
    return inv.relation_count(demo.targets(spark, sf), demo.pollers(spark, sf), F.col("admin_state") == "enabled")


METRIC_SPAN = (DAY0 + 2 * DAY_MS, DAY0 + 22 * DAY_MS)


@query(
    "metric_column",
    sql(
        f"""SELECT e.namespace, e.target, round(sum(sum) / sum(count), 6) AS metric, max(max) AS peak
            FROM (SELECT r_name AS namespace, n_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey) e
                 LEFT JOIN (SELECT * FROM ({TIERS_SQL}) WHERE tier = '5min' AND poller = 'view'
                            AND bucket_start >= {METRIC_SPAN[0]} AND bucket_end <= {METRIC_SPAN[1]}) a
                 ON a.namespace = e.namespace AND a.target = e.target
            GROUP BY ALL""",
        "numeric",
    ),
)
def metric_column(spark, sf):
    places = demo.customers(spark, sf).select(F.col("r_name").alias("namespace"), F.col("n_name").alias("target")).distinct()
    asked = inv.metric_requests(places, "view", *METRIC_SPAN)
    return rounded(inv.metric_column(places, query_many(store.tiers(spark, sf), asked)), "metric", "peak")
