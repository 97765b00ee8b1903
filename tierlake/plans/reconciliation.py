"""Queries over declared and stored inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlake.operators import reconcile as rec
from tierlake.plans.inventory import LABELS_SQL, flat
from tierlake.plans.registry import query
from tierlake.plans.twin import sql
from tierlake.sources import demo

KEYS = ["namespace", "name"]


def hash_sql(columns: str = "*") -> str:
    """Content hash of a target row: each value with its length, NULL as a dash, labels sorted."""

    def text(value: str) -> str:
        return f"coalesce(CAST(length(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def pair(key: str, value: str) -> str:
        return f"CASE WHEN {value} IS NOT NULL THEN '{len(key)}:{key}=' || {text(value)} END"

    labels = (
        "'{' || array_to_string(list_filter(["
        + ", ".join(pair(k, k) for k in ("nation", "segment", "site"))
        + "], lambda x: x IS NOT NULL), ',') || '}'"
    )
    defaults = "'{' || concat_ws(',', '-', '-', '-', '-', '-', '-', '-', '-', " + f"{text('timeout_ms')}, {text('retries')}, '-') || '}}'"
    return f"sha256(concat_ws('|', {text('namespace')}, {text('name')}, {text('description')}, {labels}, {defaults})) AS content_hash"


DECLARED = f"SELECT *, {hash_sql()} FROM targets"
STORED = f"SELECT *, {hash_sql()} FROM stored"


def declared(spark, sf):
    return rec.content_hash(demo.targets(spark, sf), rec.TARGET_FIELDS)


def stored(spark, sf):
    return rec.content_hash(demo.stored_targets(spark, sf), rec.TARGET_FIELDS)


@query("content_hash", sql("SELECT namespace, name, content_hash FROM declared", "targets", declared=DECLARED))
def content_hash(spark, sf):
    return declared(spark, sf).select("namespace", "name", "content_hash")


def diff_sql(policy: str) -> str:
    updates = {"full-sync": "true", "merge": "true", "source-aware": "s.source = 'yaml'"}.get(policy, "false")
    refused = f"'policy: {policy}'" + (" || ' (source=' || s.source || ')'" if policy == "source-aware" else "")
    creates = policy != "ignore"
    return f"""
      SELECT coalesce(d.namespace, s.namespace) AS namespace, coalesce(d.name, s.name) AS name,
             CASE WHEN d.name IS NULL THEN 'delete' WHEN s.name IS NULL THEN '{'create' if creates else 'skip'}'
                  WHEN d.content_hash = s.content_hash THEN 'skip' WHEN {updates} THEN 'update' ELSE 'skip' END AS action,
             CASE WHEN d.name IS NULL THEN 'orphan (not in yaml)' WHEN s.name IS NULL THEN '{'new entity' if creates else 'policy: ignore'}'
                  WHEN d.content_hash = s.content_hash THEN 'unchanged' WHEN {updates} THEN 'content changed' ELSE {refused} END AS reason,
             s.source AS source_state, d.content_hash AS declared_hash, s.content_hash AS stored_hash
      FROM declared d {'FULL' if policy == 'full-sync' else 'LEFT'} JOIN held s ON d.namespace = s.namespace AND d.name = s.name"""


def checked(body: str) -> str:
    return sql(body, "targets", "stored", declared=DECLARED, held=STORED)


ALL_POLICIES = " UNION ALL ".join(f"SELECT '{p}' AS policy, * FROM ({diff_sql(p)})" for p in rec.POLICIES)


@query("inventory_diff", checked(ALL_POLICIES))
def inventory_diff(spark, sf):
    new, old, out = declared(spark, sf), stored(spark, sf), None
    for policy in rec.POLICIES:
        part = rec.inventory_diff(new, old, KEYS, policy).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return out


def full_diff(spark, sf):
    return rec.inventory_diff(declared(spark, sf), stored(spark, sf), KEYS, "full-sync")


@query(
    "diff_summary",
    checked(
        f"""SELECT count(*) AS total, count(*) FILTER (action = 'create') AS "create", count(*) FILTER (action = 'update') AS "update",
                   count(*) FILTER (action = 'delete') AS "delete", count(*) FILTER (action = 'skip') AS skip,
                   count(*) FILTER (action <> 'skip') > 0 AS has_changes FROM ({diff_sql('full-sync')})"""
    ),
)
def diff_summary(spark, sf):
    return rec.diff_summary(full_diff(spark, sf))


@query("diff_actionable", checked(f"SELECT namespace, name, action, reason FROM ({diff_sql('source-aware')}) WHERE action <> 'skip'"))
def diff_actionable(spark, sf):
    diff = rec.inventory_diff(declared(spark, sf), stored(spark, sf), KEYS, "source-aware")
    return rec.diff_actionable(diff).select("namespace", "name", "action", "reason")


@query(
    "inventory_apply",
    checked(
        f"""SELECT s.namespace, s.name, s.description, s.labels, s.source, s.version::INTEGER AS version, s.content_hash
            FROM (SELECT *, {LABELS_SQL} FROM held) s LEFT JOIN ({diff_sql('full-sync')}) x ON x.namespace = s.namespace AND x.name = s.name
            WHERE x.action = 'skip'
            UNION ALL
            SELECT d.namespace, d.name, d.description, d.labels, 'yaml', CASE WHEN x.action = 'update' THEN s.version + 1 ELSE 1 END, d.content_hash
            FROM (SELECT *, {LABELS_SQL} FROM declared) d JOIN ({diff_sql('full-sync')}) x ON x.namespace = d.namespace AND x.name = d.name
                 LEFT JOIN held s ON s.namespace = d.namespace AND s.name = d.name
            WHERE x.action IN ('create', 'update')"""
    ),
)
def inventory_apply(spark, sf):
    new = rec.inventory_apply(full_diff(spark, sf), declared(spark, sf), stored(spark, sf), KEYS)
    return flat(new.select("namespace", "name", "description", "labels", "source", "version", "content_hash"))


ROUTE_PATHS = """SELECT 'fleet.' || replace(r_name, ' ', '-') || '.' || n_name || '.' || c_custkey AS path FROM cust
                 UNION ALL SELECT 'other.' || n_name FROM nation"""
ROUTE_RULES = """SELECT 'fleet' AS path, 'source-aware' AS policy
                 UNION ALL SELECT 'fleet.' || replace(r_name, ' ', '-'), 'full-sync' FROM region WHERE r_regionkey % 2 = 0
                 UNION ALL SELECT 'fleet.' || replace(r_name, ' ', '-') || '.' || n_name, 'ignore'
                           FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0"""


def dotted(*parts):
    return F.concat_ws(".", *parts)


@query(
    "policy_route",
    sql(
        """SELECT p.path, coalesce(max_by(r.policy, length(r.path)), 'create-only') AS policy
           FROM paths p LEFT JOIN rules r ON p.path = r.path OR starts_with(p.path, r.path || '.') GROUP BY p.path""",
        "cust",
        paths=ROUTE_PATHS,
        rules=ROUTE_RULES,
    ),
)
def policy_route(spark, sf):
    c = demo.customers(spark, sf).withColumn("r", F.regexp_replace("r_name", " ", "-"))
    nations = c.select("r", "n_name", "r_regionkey", "c_nationkey").distinct()
    paths = c.select(dotted(F.lit("fleet"), "r", "n_name", F.col("c_custkey").cast("string")).alias("path")).unionByName(
        demo.table(spark, sf, "nation").select(dotted(F.lit("other"), "n_name").alias("path"))
    )
    rules = (
        demo.table(spark, sf, "region")
        .where(F.col("r_regionkey") == 0)
        .select(F.lit("fleet").alias("path"), F.lit("source-aware").alias("policy"))
        .unionByName(
            nations.where(F.col("r_regionkey") % 2 == 0)
            .select(dotted(F.lit("fleet"), "r").alias("path"), F.lit("full-sync").alias("policy"))
            .distinct()
        )
        .unionByName(
            nations.where(F.col("c_nationkey") % 3 == 0).select(
                dotted(F.lit("fleet"), "r", "n_name").alias("path"), F.lit("ignore").alias("policy")
            )
        )
    )
    return rec.policy_route(paths, rules)


@query(
    "orphan_entities",
    sql(
        """SELECT 'target' AS entity, namespace, '' AS target, name FROM targets
           WHERE namespace NOT IN (SELECT name FROM left_ns)
           UNION ALL
           SELECT 'poller', p.namespace, p.target, p.name FROM pollers p
           WHERE NOT EXISTS (SELECT 1 FROM left_targets t WHERE t.namespace = p.namespace AND t.name = p.target)""",
        "pollers",
        "left_ns",
        "left_targets",
    ),
)
def orphan_entities(spark, sf):
    # One namespace has gone, and some targets have.
    names, pollers = demo.remaining_namespaces(spark, sf), demo.pollers(spark, sf)
    whole = rec.orphan_entities(names, demo.targets(spark, sf), pollers).where(F.col("entity") == "target")
    lost = rec.orphan_entities(names, demo.remaining_targets(spark, sf), pollers).where(F.col("entity") == "poller")
    return whole.unionByName(lost)


def digest_sql(section: str, a: str, b: str) -> str:
    word = "CAST('0x' || substr(content_hash, 1, 15) AS BIGINT)"
    return f"""SELECT '{section}' AS section, a.n AS entities, a.x AS digest, b.n AS stored_entities, b.x AS stored_digest,
                      a.n = b.n AND a.x = b.x AS unchanged
               FROM (SELECT count(*) AS n, bit_xor({word}) AS x FROM {a}) a, (SELECT count(*) AS n, bit_xor({word}) AS x FROM {b}) b"""


@query("sync_unchanged", checked(digest_sql("same", "declared", "declared") + " UNION ALL " + digest_sql("targets", "declared", "held")))
def sync_unchanged(spark, sf):
    d = declared(spark, sf)
    # The same rows in another order digest alike.
    again = declared(spark, sf).repartition(5, "name")
    return rec.sync_unchanged({"same": d, "targets": d}, {"same": again, "targets": stored(spark, sf)})


@query(
    "entity_changes",
    checked(
        """SELECT coalesce(d.namespace, s.namespace) AS namespace, coalesce(d.name, s.name) AS name,
                  CASE WHEN s.name IS NULL THEN 'create' WHEN d.name IS NULL THEN 'delete' ELSE 'update' END AS event,
                  CASE WHEN s.name IS NULL OR d.name IS NULL THEN '' ELSE array_to_string(list_filter([
                    CASE WHEN d.description IS DISTINCT FROM s.description THEN 'description' END,
                    CASE WHEN d.segment IS DISTINCT FROM s.segment THEN 'labels' END], lambda x: x IS NOT NULL), ',') END AS changed_fields
           FROM declared d FULL JOIN held s ON d.namespace = s.namespace AND d.name = s.name
           WHERE d.name IS NULL OR s.name IS NULL OR d.content_hash <> s.content_hash"""
    ),
)
def entity_changes(spark, sf):
    changes = rec.entity_changes(stored(spark, sf), declared(spark, sf), KEYS, ["description", "labels", "host", "defaults"])
    return changes.withColumn("changed_fields", F.array_join("changed_fields", ","))
