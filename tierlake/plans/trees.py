"""Queries over the tree, views and smart folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlake.operators import stats, tree, views
from tierlake.plans.registry import query
from tierlake.plans.status import customer, info
from tierlake.plans.twin import sql
from tierlake.sources import demo

VIEW_PATHS_SQL = """
  SELECT namespace, name, 'target:' || name AS link_ref, '/by-nation/' || nation || '/' || name AS path, 'by-nation' AS view, 50 AS priority
  FROM targets
  UNION ALL
  SELECT namespace, name, 'target:' || name, '/by-site/' || site || '/' || name, 'by-site', 40 FROM targets WHERE site IS NOT NULL"""
SMART_SQL = """
  SELECT namespace, name, 'target:' || name AS link_ref, '/smart/machinery' AS folder, 25 AS priority FROM targets WHERE segment = 'MACHINERY'
  UNION ALL SELECT namespace, name, 'target:' || name, '/smart/edge-sites', 25 FROM targets WHERE site IN ('dc0', 'dc1')
  UNION ALL SELECT namespace, name, 'target:' || name, '/smart/all', 25 FROM targets
  UNION ALL SELECT namespace, name, 'target:' || name, '/by-site/dc1', 45 FROM targets WHERE segment = 'FURNITURE'"""


@query("view_paths_targets", sql(VIEW_PATHS_SQL, "targets"))
def view_paths_targets(spark, sf):
    return views.view_paths_targets(demo.targets(spark, sf), demo.VIEWS)


@query(
    "view_paths_pollers",
    sql(
        """SELECT p.namespace, p.target, p.name, 'poller:' || p.target || '/' || p.name AS link_ref,
                  '/by-segment/' || segment || '/' || p.target || '/' || p.name AS path, 'by-segment' AS view, 50 AS priority
           FROM pollers p JOIN targets t ON t.namespace = p.namespace AND t.name = p.target""",
        "pollers",
    ),
)
def view_paths_pollers(spark, sf):
    return views.view_paths_pollers(demo.targets(spark, sf), demo.pollers(spark, sf), demo.VIEWS)


@query(
    "view_group_counts",
    sql(
        """SELECT namespace, 1 AS level, site AS first, NULL::VARCHAR AS second, count(*) AS targets FROM targets
           WHERE site IS NOT NULL GROUP BY ALL
           UNION ALL
           SELECT namespace, 2, site, segment, count(*) FROM targets WHERE site IS NOT NULL AND segment IS NOT NULL GROUP BY ALL""",
        "targets",
    ),
)
def view_group_counts(spark, sf):
    return views.view_group_counts(demo.targets(spark, sf), "site", "segment")


@query(
    "tree_children",
    sql(
        """SELECT namespace, path, node_type, link_ref FROM nodes
           WHERE namespace = 'AMERICA' AND path LIKE '/geo/AMERICA/%' AND path NOT LIKE '/geo/AMERICA/%/%'""",
        "nodes",
    ),
)
def tree_children(spark, sf):
    return tree.tree_children(demo.tree_nodes(spark, sf), "AMERICA", "/geo/AMERICA/")


@query(
    "tree_ancestors",
    sql(
        """SELECT DISTINCT namespace, array_to_string(parts[1:i], '/') AS path
           FROM (SELECT namespace, parts, unnest(range(2, len(parts))) AS i
                 FROM (SELECT namespace, string_split(path, '/') AS parts FROM nodes))""",
        "nodes",
    ),
)
def tree_ancestors(spark, sf):
    return tree.tree_ancestors(demo.tree_nodes(spark, sf))


@query(
    "tree_subtree",
    sql(
        """SELECT namespace, path, node_type, link_ref FROM nodes
           WHERE namespace = 'ASIA' AND (path = '/geo/ASIA/NATION_2' OR starts_with(path, '/geo/ASIA/NATION_2/'))""",
        "nodes",
    ),
)
def tree_subtree(spark, sf):
    return tree.tree_subtree(demo.tree_nodes(spark, sf), "ASIA", "/geo/ASIA/NATION_2")


ENTRIES_SQL = f"""
  SELECT namespace, CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
         regexp_extract(path, '[^/]*$') AS name, path, node_type AS type, link_ref, 100 AS priority, 'static' AS source, 0 AS rank
  FROM nodes
  UNION ALL
  SELECT namespace, CASE WHEN i = 2 THEN '/' ELSE array_to_string(parts[1:i - 1], '/') END, parts[i], array_to_string(parts[1:i], '/'),
         CASE WHEN i = len(parts) THEN 'link_target' ELSE 'directory' END, CASE WHEN i = len(parts) THEN link_ref END, priority, 'view', 1
  FROM (SELECT namespace, parts, link_ref, priority, unnest(range(2, len(parts) + 1)) AS i
        FROM (SELECT *, string_split(path, '/') AS parts FROM ({VIEW_PATHS_SQL})))
  UNION ALL
  SELECT namespace, folder, name, folder || '/' || name, 'link_target', link_ref, priority, 'smart', 2 FROM ({SMART_SQL})"""
TREE_SQL = f"""SELECT * EXCLUDE (rank) FROM ({ENTRIES_SQL})
  QUALIFY row_number() OVER (PARTITION BY namespace, parent, name
                             ORDER BY priority DESC, rank, type, path, link_ref NULLS FIRST) = 1"""


@query(
    "tree_browse",
    sql(f"SELECT * FROM ({TREE_SQL}) WHERE namespace = 'EUROPE' AND parent IN ('/', '/by-site', '/by-site/dc1', '/geo/EUROPE')", "nodes", "targets"),
)
def tree_browse(spark, sf):
    nodes, targets = demo.tree_nodes(spark, sf), demo.targets(spark, sf)
    out = None
    for path in ("/", "/by-site", "/by-site/dc1", "/geo/EUROPE"):
        part = tree.tree_browse(nodes, targets, demo.VIEWS, demo.SMART_FOLDERS, "EUROPE", path)
        out = part if out is None else out.unionByName(part)
    return out


@query("tree_browse_all", sql(TREE_SQL, "nodes", "targets"))
def tree_browse_all(spark, sf):
    return tree.tree_browse_all(demo.tree_nodes(spark, sf), demo.targets(spark, sf), demo.VIEWS, demo.SMART_FOLDERS)


@query("smart_folder_targets", sql(SMART_SQL, "targets"))
def smart_folder_targets(spark, sf):
    return views.smart_folder_targets(demo.targets(spark, sf), demo.SMART_FOLDERS)


RECENT_MS = 2 * 86_400_000


@query(
    "smart_folder_status",
    sql(
        f"""SELECT namespace, target, poller, 'high-error-rate' AS folder FROM info WHERE polls_total > 0 AND polls_failed::DOUBLE / polls_total > 0.1
            UNION ALL SELECT namespace, target, poller, 'recent-errors' FROM info
            WHERE last_error <> '' AND {demo.NOW_MS} - last_poll_at < {RECENT_MS}
            UNION ALL SELECT namespace, target, poller, 'disabled' FROM info WHERE admin_state = 'disabled'""",
        "info",
    ),
)
def smart_folder_status(spark, sf):
    return views.smart_folder_status(info(spark, sf), demo.NOW_MS, recent_ms=RECENT_MS)


LINKS_CTE = """SELECT namespace, path, node_type, link_ref, split_part(link_ref, ':', 1) AS link_type,
    split_part(split_part(link_ref, ':', 2), '/', 1) AS target,
    CASE WHEN starts_with(link_ref, 'poller:') THEN split_part(link_ref, '/', 2) END AS poller
    FROM nodes WHERE link_ref IS NOT NULL"""


@query(
    "link_resolve",
    sql(
        """SELECT l.namespace, l.path, l.node_type, l.link_ref, l.link_type, l.target, l.poller, t.host, t.protocol,
                  i.admin_state, i.oper_state, i.health
           FROM links l LEFT JOIN targets t ON t.namespace = l.namespace AND t.name = l.target
                LEFT JOIN info i ON i.namespace = l.namespace AND i.target = l.target AND i.poller = l.poller""",
        "nodes",
        "info",
        links=LINKS_CTE,
    ),
)
def link_resolve(spark, sf):
    return tree.link_resolve(demo.tree_nodes(spark, sf), demo.targets(spark, sf), info(spark, sf))


@query(
    "dangling_links",
    sql(
        """SELECT namespace, path, link_ref FROM links l
           WHERE (link_type = 'target' AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.namespace = l.namespace AND t.name = l.target
                                                       AND t.custkey % 30 <> 0))
              OR (link_type = 'poller' AND NOT EXISTS (SELECT 1 FROM pollers p WHERE p.namespace = l.namespace AND p.target = l.target
                                                       AND p.name = l.poller AND p.custkey % 45 <> 1))""",
        "nodes",
        "pollers",
        links=LINKS_CTE,
    ),
)
def dangling_links(spark, sf):
    # Some targets and pollers have gone since their links were made.
    targets = demo.targets(spark, sf).where(F.col("custkey") % 30 != 0)
    pollers = demo.pollers(spark, sf).where(F.col("custkey") % 45 != 1)
    return tree.dangling_links(demo.tree_nodes(spark, sf), targets, pollers)


@query(
    "links_to",
    sql(
        """SELECT namespace, target, count(*) FILTER (link_type = 'target') AS links, count(*) AS links_with_pollers
           FROM links GROUP BY ALL""",
        "nodes",
        links=LINKS_CTE,
    ),
)
def links_to(spark, sf):
    return tree.links_count(demo.tree_nodes(spark, sf))


@query(
    "links_to_target",
    sql(
        """SELECT 'target' AS ask, namespace, path, link_ref FROM nodes WHERE namespace = 'AFRICA' AND link_ref = 'target:gone'
           UNION ALL SELECT 'all', namespace, path, link_ref FROM nodes
           WHERE namespace = (SELECT namespace FROM targets WHERE name = 'Customer#000000031') AND
                 (link_ref = 'target:Customer#000000031' OR starts_with(link_ref, 'poller:Customer#000000031/'))""",
        "nodes",
        "targets",
    ),
)
def links_to_target(spark, sf):
    nodes = demo.tree_nodes(spark, sf)
    found = tree.links_to(nodes, "AFRICA", "gone").withColumn("ask", F.lit("target"))
    name = "Customer#000000031"
    ns = demo.targets(spark, sf).where(F.col("name") == name).select("namespace").first()
    both = tree.links_to(nodes, ns["namespace"], name, with_pollers=True).withColumn("ask", F.lit("all"))
    return found.unionByName(both)


def asked_paths(spark, sf):
    """Paths into targets, pollers and the tree, some of them wrong."""
    t = demo.targets(spark, sf)
    key = F.col("custkey")
    tree_path = F.concat_ws("/", F.lit("/tree/geo"), F.col("namespace"), F.element_at("labels", "nation"), F.col("name"))
    path = (
        F.when(key % 5 == 0, F.concat(F.lit("/targets/"), F.col("name"), F.lit("/")))
        .when(key % 5 == 1, F.concat(F.lit("targets/"), F.col("name"), F.lit("/view")))
        .when(key % 5 == 2, tree_path)
        .when(key % 5 == 3, F.concat(F.lit("/tree/geo/"), F.col("namespace")))
        .otherwise("/elsewhere")
    )
    return t.select("namespace", "custkey", path.alias("path"))


ASKED_SQL = """SELECT namespace, custkey, CASE custkey % 5 WHEN 0 THEN '/targets/' || name || '/' WHEN 1 THEN 'targets/' || name || '/view'
      WHEN 2 THEN '/tree/geo/' || namespace || '/' || nation || '/' || name WHEN 3 THEN '/tree/geo/' || namespace
      ELSE '/elsewhere' END AS path, name FROM targets"""


@query(
    "path_resolve",
    sql(
        """SELECT a.namespace, custkey, a.path,
                  CASE custkey % 5 WHEN 0 THEN 'target' WHEN 1 THEN 'poller' WHEN 2 THEN CASE WHEN n.path IS NOT NULL THEN 'target' END
                       WHEN 3 THEN 'directory' END AS type,
                  CASE custkey % 5 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN CASE WHEN n.path IS NOT NULL THEN name END END AS target,
                  CASE custkey % 5 WHEN 1 THEN 'view' END AS poller
           FROM asked a LEFT JOIN nodes n ON n.namespace = a.namespace AND '/tree' || n.path = a.path""",
        "targets",
        "nodes",
        asked=ASKED_SQL,
    ),
)
def path_resolve(spark, sf):
    return tree.path_resolve(asked_paths(spark, sf), demo.tree_nodes(spark, sf))


@query(
    "target_listing",
    sql(
        """SELECT t.namespace, t.name, '/targets/' || t.name AS path, 'target' AS type, t.description, coalesce(pollers, 0) AS pollers,
                  coalesce(polls_total, 0) AS polls_total, coalesce(polls_success, 0) AS polls_success, coalesce(polls_failed, 0) AS polls_failed
           FROM targets t LEFT JOIN (SELECT namespace, target, count(*) AS pollers, CAST(sum(polls_total) AS BIGINT) AS polls_total,
                  CAST(sum(polls_success) AS BIGINT) AS polls_success, CAST(sum(polls_failed) AS BIGINT) AS polls_failed
                  FROM stats GROUP BY ALL) s ON s.namespace = t.namespace AND s.target = t.name""",
        "targets",
        "stats",
    ),
)
def target_listing(spark, sf):
    totals = stats.stats_by_target(stats.poller_stats(customer(spark, sf)))
    return tree.target_listing(demo.targets(spark, sf), totals)


@query(
    "poller_listing",
    sql(
        """SELECT namespace, target, poller AS name, '/targets/' || target || '/' || poller AS path, 'poller' AS type, description,
                  admin_state, oper_state, health FROM info""",
        "info",
    ),
)
def poller_listing(spark, sf):
    return tree.poller_listing(info(spark, sf))
