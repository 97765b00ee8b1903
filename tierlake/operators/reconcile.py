"""Declared against stored inventory: hashes, differences, new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlake.session import materialise

# Policies, actions' reasons and import modes.
POLICIES = ["create-only", "full-sync", "source-aware", "ignore", "merge"]
IMPORT_MODES = {"create": "create-only", "merge": "merge", "replace": "full-sync"}

NAMESPACE_FIELDS = ["name", "description", "defaults"]
TARGET_FIELDS = ["namespace", "name", "description", "labels", "defaults"]
POLLER_FIELDS = ["namespace", "target", "name", "description", "protocol", "protocol_config", "admin_state", "polling"]


def _text(value: Column, kind: T.DataType) -> Column:
    """Text of a value that no other value shares: length first, NULL as a dash."""
    if isinstance(kind, T.StructType):
        inner = F.concat_ws(",", *[_text(value[f.name], f.dataType) for f in kind.fields])
        return F.when(value.isNull(), "-").otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.array_sort(F.map_entries(value)),
            lambda e: F.concat(_text(e["key"], kind.keyType), F.lit("="), _text(e["value"], kind.valueType)),
        )
        # An absent map and an empty one are the same content.
        return F.concat(F.lit("{"), F.coalesce(F.array_join(entries, ","), F.lit("")), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(F.array_sort(value), lambda e: _text(e, kind.elementType))
        return F.concat(F.lit("["), F.coalesce(F.array_join(items, ","), F.lit("")), F.lit("]"))
    plain = value.cast("string")
    return F.coalesce(F.concat(F.length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def content_hash(df: DataFrame, fields: list[str], name: str = "content_hash") -> DataFrame:
    """Add a SHA-256 of the content fields; map order does not matter, NULL differs from empty."""
    types = {f.name: f.dataType for f in df.schema.fields}
    text = F.concat_ws("|", *[_text(F.col(f), types[f]) for f in fields])
    return df.withColumn(name, F.sha2(text, 256))


def inventory_diff(
    declared: DataFrame, stored: DataFrame, keys: list[str], policy: str = "create-only"
) -> DataFrame:
    """Action and reason for every entity under a policy.

    Both sides carry content_hash, the stored side also source.  Entities that
    are only stored appear under full-sync alone, as deletions.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    d = declared.select(*keys, F.col("content_hash").alias("declared_hash"), F.lit(True).alias("_d"))
    s = stored.select(
        *keys, F.col("content_hash").alias("stored_hash"), F.col("source").alias("source_state"), F.lit(True).alias("_s")
    )
    both = d.join(s, keys, "full" if policy == "full-sync" else "left")
    is_new, is_gone = F.col("_s").isNull(), F.col("_d").isNull()
    same = F.col("declared_hash") == F.col("stored_hash")
    may_update = {
        "full-sync": F.lit(True),
        "merge": F.lit(True),
        "source-aware": F.coalesce(F.col("source_state") == "yaml", F.lit(False)),
    }.get(policy, F.lit(False))
    refused = F.lit(f"policy: {policy}")
    if policy == "source-aware":
        refused = F.concat(refused, F.lit(" (source="), F.coalesce("source_state", F.lit("")), F.lit(")"))
    creates = policy != "ignore"
    action = (
        F.when(is_gone, "delete")
        .when(is_new, "create" if creates else "skip")
        .when(same, "skip")
        .when(may_update, "update")
        .otherwise("skip")
    )
    reason = (
        F.when(is_gone, "orphan (not in yaml)")
        .when(is_new, "new entity" if creates else "policy: ignore")
        .when(same, "unchanged")
        .when(may_update, "content changed")
        .otherwise(refused)
    )
    return both.select(
        *keys, action.alias("action"), reason.alias("reason"), "source_state", "declared_hash", "stored_hash"
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per action and whether anything changes."""
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ("create", "update", "delete", "skip")]
    changing = F.count_if(F.col("action") != "skip") > 0
    return diff.agg(F.count("*").alias("total"), *counts, changing.alias("has_changes"))


def diff_actionable(diff: DataFrame, action: str | None = None) -> DataFrame:
    """Rows that change something, or those of one action."""
    return diff.where(F.col("action") == action) if action else diff.where(F.col("action") != "skip")


def inventory_apply(diff: DataFrame, declared: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The stored inventory after the differences are carried out.

    Created and updated entities take the declared content and the source
    yaml; an update raises the version by one.  Stored columns that the
    declared side lacks stay as they are, and are null in created entities.
    """
    actions = diff.select(*keys, "action")
    kept = (
        stored.join(actions, keys, "left")
        .where(F.col("action").isNull() | (F.col("action") == "skip"))
        .select(stored.columns)
    )
    own = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in own])
    new = {c: F.col(c) if c in declared.columns else F.col(f"_old_{c}") for c in own}
    new["source"] = F.lit("yaml")
    new["version"] = F.when(F.col("action") == "update", F.col("_old_version") + 1).otherwise(1)
    written = (
        declared.join(actions.where(F.col("action").isin("create", "update")), keys)
        .join(old, keys, "left")
        .select(*keys, *[new[c].alias(c) for c in own])
    )
    return kept.unionByName(written)


def policy_route(paths: DataFrame, policies: DataFrame, default: str = "create-only") -> DataFrame:
    """Policy of each distinct dotted path: its own, else that of the longest ancestor, else the default.

    A sorted sweep. Paths and rules, one row for each name, are cut by range into even pieces and written below the
    shared folder. In the order of names all paths under a rule follow it, and no other rule of its depth lies between;
    so the newest rule of every depth, in the piece or else from the pieces before it, is the stack of rules that may be
    open at a row. The deepest of them that is a prefix counts. The stack has as many columns as the deepest rule has
    steps. Of several policies for a path the largest counts; rows without a path, and rules without a policy, are left
    out.
    """
    spark = paths.sparkSession
    named = paths.select("path", F.lit(True).alias("asked"), F.lit(None).cast("string").alias("policy")).unionByName(
        policies.select("path", F.lit(False).alias("asked"), "policy").where(F.col("policy").isNotNull())
    )
    # The closing dot makes a name a prefix of those below it and of no other.
    rows = (
        named.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.max("asked").alias("asked"), F.max("policy").alias("policy"))
        .withColumn("key", F.concat("path", F.lit(".")))
        .withColumn("depth", F.when(F.col("policy").isNotNull(), F.size(F.split("path", "[.]"))))
        .repartitionByRange("key")
        .withColumn("piece", F.spark_partition_id())
    )
    placed = materialise(spark, rows, "route")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    depths = range(1, deepest + 1)
    rule = F.struct("key", "policy")
    ends = placed.groupBy("piece").agg(
        *[F.max(F.when(F.col("depth") == d, rule)).alias(f"_in{d}") for d in depths], F.count("*").alias("_rows")
    )
    # One row for each piece.
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("piece", *[F.last(f"_in{d}", ignorenulls=True).over(before).alias(f"_in{d}") for d in depths])
    upto = Window.partitionBy("piece").orderBy("key")
    swept = placed.withColumns(
        {f"_at{d}": F.last(F.when(F.col("depth") == d, rule), ignorenulls=True).over(upto) for d in depths}
    )
    opened = [F.coalesce(f"_at{d}", f"_in{d}") for d in reversed(depths)]
    found = [F.when(F.startswith(F.col("key"), o["key"]), o["policy"]) for o in opened]
    return (
        swept.join(carried, "piece")
        .where("asked")
        .select("path", F.coalesce(*found, F.lit(default)).alias("policy"))
    )


def orphan_entities(namespaces: DataFrame, targets: DataFrame, pollers: DataFrame) -> DataFrame:
    """Targets without their namespace and pollers without their target."""
    n = namespaces.select(F.col("name").alias("namespace"))
    t = targets.select("namespace", F.col("name").alias("target"))
    lost_targets = targets.join(n, "namespace", "left_anti").select(
        F.lit("target").alias("entity"), "namespace", F.lit("").alias("target"), "name"
    )
    lost_pollers = pollers.join(t, ["namespace", "target"], "left_anti").select(
        F.lit("poller").alias("entity"), "namespace", "target", "name"
    )
    return lost_targets.unionByName(lost_pollers)


def section_digest(df: DataFrame, section: str) -> DataFrame:
    """Order-free digest of a section: number of entities and the exclusive or of their hashes."""
    word = F.conv(F.substr(F.col("content_hash"), F.lit(1), F.lit(15)), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("entities"), F.bit_xor(word).alias("digest")).withColumn(
        "section", F.lit(section)
    )


def sync_unchanged(declared: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """Per section, whether both sides hold the same content, so that there is nothing to do."""
    out = None
    for section, df in declared.items():
        a = section_digest(df, section)
        b = section_digest(stored[section], section).select(
            "section", F.col("entities").alias("stored_entities"), F.col("digest").alias("stored_digest")
        )
        row = a.join(b, "section").withColumn(
            "unchanged",
            (F.col("entities") == F.col("stored_entities")) & F.col("digest").eqNullSafe(F.col("stored_digest")),
        )
        out = row if out is None else out.unionByName(row)
    return out


def entity_changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Create, update and delete events between two snapshots, with the names of changed fields."""
    types = {f.name: f.dataType for f in new.schema.fields}

    def side(df, prefix):
        # Maps cannot be compared, their text can.
        columns = [
            (_text(F.col(f), types[f]) if isinstance(types[f], (T.MapType, T.StructType)) else F.col(f)).alias(prefix + f)
            for f in fields
        ]
        return df.select(*keys, *columns, F.lit(True).alias(prefix))

    both = side(old, "_o").join(side(new, "_n"), keys, "full")
    changed = F.array_compact(
        F.array(*[F.when(~F.col("_o" + f).eqNullSafe(F.col("_n" + f)), F.lit(f)) for f in fields])
    )
    event = (
        F.when(F.col("_o").isNull(), "create").when(F.col("_n").isNull(), "delete").when(F.size(changed) > 0, "update")
    )
    none = F.array().cast("array<string>")
    return both.select(
        *keys, event.alias("event"), F.when(event == "update", changed).otherwise(none).alias("changed_fields")
    ).where(F.col("event").isNotNull())
