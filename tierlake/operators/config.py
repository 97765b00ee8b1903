"""Inherited polling configuration with the source of each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.schemas import DEFAULT_BUFFER_SIZE, DEFAULT_INTERVAL_MS, DEFAULT_RETRIES, DEFAULT_TIMEOUT_MS

CREDENTIALS = [
    "community",
    "security_name",
    "security_level",
    "auth_protocol",
    "auth_password",
    "priv_protocol",
    "priv_password",
]
BUILT_IN = {
    "interval_ms": DEFAULT_INTERVAL_MS,
    "timeout_ms": DEFAULT_TIMEOUT_MS,
    "retries": DEFAULT_RETRIES,
    "buffer_size": DEFAULT_BUFFER_SIZE,
}


def _first(levels: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Value and source of the first level that has a value."""
    value = F.coalesce(*[v for v, _ in levels])
    source = F.coalesce(*[F.when(v.isNotNull(), s) for v, s in levels])
    return value, source


def effective_config(
    namespaces: DataFrame, targets: DataFrame, pollers: DataFrame, server: dict[str, int] | None = None
) -> DataFrame:
    """Settings of every poller, each with its source; the innermost level that sets a value wins.

    Zero counts as unset, except for retries below the server level.
    Credentials come from the namespace and the target only.  The interval a
    poll is scheduled with differs: a poller's own value counts even when 0.
    """
    server = server or {}
    n = namespaces.select(F.col("name").alias("namespace"), F.col("defaults").alias("_n"))
    t = targets.select("namespace", F.col("name").alias("target"), "host", F.col("defaults").alias("_t"))
    p = pollers.select("namespace", "target", F.col("name").alias("poller"), "protocol_config", F.col("polling").alias("_p"))
    joined = p.join(t, ["namespace", "target"], "left").join(n, "namespace", "left")

    from_poller = F.concat(F.lit("poller:"), F.col("poller"))
    from_target = F.concat(F.lit("target:"), F.col("target"))
    from_namespace = F.concat(F.lit("namespace:"), F.col("namespace"))

    out = {}
    for name, built_in in BUILT_IN.items():
        zero_counts = name == "retries"

        def set_at(level: str) -> Column:
            value = F.col(f"{level}.{name}")
            return value if zero_counts else F.when(value > 0, value)

        given = server.get(name) or None
        value, source = _first(
            [
                (set_at("_p"), from_poller),
                (set_at("_t"), from_target),
                (set_at("_n"), from_namespace),
                (F.lit(given if given and given > 0 else None).cast("int"), F.lit("server")),
                (F.lit(built_in), F.lit("default")),
            ]
        )
        out[name], out[f"{name}_source"] = value.cast("bigint"), source
    for name in CREDENTIALS:
        value, source = _first(
            [
                (F.nullif(F.col(f"_t.{name}"), F.lit("")), from_target),
                (F.nullif(F.col(f"_n.{name}"), F.lit("")), from_namespace),
            ]
        )
        out[name], out[f"{name}_source"] = value, source
    scheduled = F.coalesce(F.col("_p.interval_ms").cast("bigint"), out["interval_ms"])
    return joined.select(
        "namespace",
        "target",
        "poller",
        "host",
        F.get_json_object("protocol_config", "$.oid").alias("oid"),
        *[column.alias(name) for name, column in out.items()],
        scheduled.alias("scheduled_interval_ms"),
    )


# The form of an entity name.
NAME_PATTERN = r"^[\p{L}\p{Nd}_-][\p{L}\p{Nd}._-]{0,254}$"


def config_violations(config: DataFrame) -> DataFrame:
    """Pollers whose effective configuration cannot be polled, with all reasons."""

    def blank(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) == ""

    # The texts of the reasons.
    reasons = [
        F.when(blank("host"), "host is required"),
        F.when(blank("oid"), "OID is required"),
        F.when(blank("security_name") & blank("community"), "v2c requires community"),
        *[F.when(~F.col(c).rlike(NAME_PATTERN), f"invalid {c} name") for c in ("namespace", "target", "poller")],
    ]
    found = config.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return found.where(F.size("reasons") > 0).select("namespace", "target", "poller", "reasons")
