"""The demo tables of ``sources.demo`` as common table expressions for the SQL side."""

from __future__ import annotations

from tierlake.schemas import FIRST_MONDAY_MS, TIERS

# Name of each expression with the ones it reads and its body.
PARTS: dict[str, tuple[list[str], str]] = {
    "cust": (
        [],
        """SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n_name, r_name, r_regionkey
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "ev": (
        ["cust"],
        """SELECT event_id, epoch_us(ts) // 1000 AS ms, event_type, value, props,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, c_custkey, c_name, n_name, r_name
           FROM events JOIN cust ON user_id = c_custkey""",
    ),
    "samples_all": (
        ["ev"],
        """SELECT r_name AS namespace, n_name, c_name, event_type AS poller, ms AS timestamp_ms,
                  CASE event_type WHEN 'signup' THEN 'counter' WHEN 'error' THEN 'text' ELSE 'gauge' END AS value_type,
                  CASE WHEN event_type NOT IN ('signup', 'error') AND k % 10 <> 0 THEN value END AS value_gauge,
                  CASE WHEN event_type = 'signup' AND k % 10 <> 0 THEN event_id END AS value_counter,
                  CASE WHEN event_type = 'error' AND k % 10 <> 0 THEN props END AS value_text,
                  k % 10 <> 0 AS valid,
                  CASE WHEN k % 10 <> 0 THEN NULL WHEN k % 20 = 0 THEN 'get: request timeout'
                       ELSE 'get: connection refused' END AS error,
                  k AS poll_ms, event_id AS seq
           FROM ev""",
    ),
    "samples": (["samples_all"], "SELECT * EXCLUDE (n_name, c_name), n_name AS target FROM samples_all"),
    "csamples": (["samples_all"], "SELECT * EXCLUDE (n_name, c_name), c_name AS target FROM samples_all"),
    "numeric": (
        ["samples"],
        """SELECT *, CASE value_type WHEN 'counter' THEN CAST(value_counter AS DOUBLE) ELSE value_gauge END AS v
           FROM samples WHERE valid AND value_type <> 'text'""",
    ),
    "hsamples": (
        ["ev"],
        """SELECT r_name AS namespace, n_name AS target, 'poll' AS poller, ms AS timestamp_ms, event_id AS seq,
                  event_type <> 'error' AS valid,
                  CASE WHEN event_type = 'error' THEN 'error ' || CAST(k AS VARCHAR) END AS error, k AS poll_ms
           FROM ev""",
    ),
    "lsamples": (
        [],
        """SELECT r_name AS namespace, s_name AS target, l_returnflag AS poller,
                  epoch_us(l_shipdate) // 1000 AS timestamp_ms, l_extendedprice AS v
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey""",
    ),
    "arrivals": (
        ["samples"],
        "SELECT *, timestamp_ms + CASE WHEN seq % 50 = 0 THEN 93600000 ELSE 0 END AS arrival_ms FROM samples",
    ),
    "ns": (
        [],
        """SELECT r_name AS name, 'Region ' || r_name AS description,
                  CASE WHEN r_regionkey % 2 = 0 THEN 5000 END AS interval_ms,
                  CASE WHEN r_regionkey < 4 THEN 'ro' END AS community
           FROM region""",
    ),
    "targets": (
        ["cust"],
        """SELECT r_name AS namespace, c_name AS name, 'Customer ' || CAST(c_custkey AS VARCHAR) AS description,
                  n_name AS nation, c_mktsegment AS segment,
                  CASE WHEN c_custkey % 9 <> 0 THEN 'dc' || CAST(c_custkey % 4 AS VARCHAR) END AS site,
                  ['geo/' || r_name || '/' || n_name, 'segment/' || c_mktsegment] AS tags,
                  '10.' || CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) || '.1' AS host,
                  CASE WHEN c_custkey % 10 = 3 THEN 'ping' ELSE 'snmp' END AS protocol,
                  CASE WHEN c_custkey % 7 = 0 THEN 3000 END AS timeout_ms,
                  CASE WHEN c_custkey % 5 = 0 THEN 0 END AS retries,
                  c_custkey AS custkey
           FROM cust""",
    ),
    "pollers": (
        ["targets"],
        """SELECT namespace, name AS target, poller_name AS name, description, protocol,
                  CASE WHEN custkey % 50 <> 1 THEN '1.3.6.1.2.1.1.3.0' ELSE '' END AS oid,
                  CASE WHEN custkey % 6 = 0 THEN 1000 WHEN custkey % 6 = 1 THEN 0 END AS p_interval_ms,
                  CASE WHEN custkey % 8 = 0 THEN 600 END AS p_buffer_size,
                  CASE WHEN custkey % 4 = 0 THEN 'disabled' ELSE 'enabled' END AS admin_state,
                  CASE WHEN custkey % 4 = 0 OR custkey % 13 = 0 THEN 'stopped' ELSE 'running' END AS oper_state,
                  custkey
           FROM (SELECT *, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS poller_name FROM targets)""",
    ),
    "owned": (["pollers"], "SELECT * FROM pollers WHERE custkey % 21 <> 0"),
    "left_ns": (["ns"], "SELECT * FROM ns WHERE name <> 'ASIA'"),
    "left_targets": (["targets"], "SELECT * FROM targets WHERE custkey % 40 <> 0"),
    "nodes": (
        ["cust"],
        """SELECT r_name AS namespace, '/geo/' || r_name || '/' || n_name || '/' || c_name AS path,
                  'link_target' AS node_type, 'target:' || c_name AS link_ref FROM cust WHERE c_custkey % 3 = 0
           UNION ALL
           SELECT r_name, '/geo/' || r_name || '/' || n_name || '/' || c_name || '-errors', 'link_poller',
                  'poller:' || c_name || '/error' FROM cust WHERE c_custkey % 15 = 1
           UNION ALL
           SELECT r_name, '/geo/' || r_name || '/' || n_name, 'directory', NULL
           FROM nation JOIN region ON n_regionkey = r_regionkey
           UNION ALL
           SELECT r_name, '/geo/' || r_name, 'directory', NULL FROM region
           UNION ALL
           SELECT r_name, '/geo', 'directory', NULL FROM region
           UNION ALL
           SELECT r_name, '/geo/' || r_name || '/gone', 'link_target', 'target:gone' FROM region""",
    ),
    "stored": (
        ["targets"],
        """SELECT namespace, name, CASE WHEN custkey % 13 = 0 THEN 'changed by hand' ELSE description END AS description,
                  nation, CASE WHEN custkey % 19 <> 0 THEN segment END AS segment, site, timeout_ms, retries,
                  CASE WHEN custkey % 5 = 0 THEN 'api' ELSE 'yaml' END AS source, 3 AS version, custkey
           FROM targets WHERE custkey % 11 <> 0
           UNION ALL
           SELECT namespace, 'old-' || name, description, nation, segment, site, timeout_ms, retries,
                  CASE WHEN custkey % 5 = 0 THEN 'api' ELSE 'yaml' END, 2, custkey
           FROM targets WHERE custkey % 17 = 0""",
    ),
    "subs": (
        ["cust"],
        """SELECT 'session-' || CAST(c_custkey % 7 AS VARCHAR) AS subscriber, r_name AS namespace, c_name AS target,
                  CASE WHEN c_custkey % 10 = 1 THEN 'click' END AS poller
           FROM cust WHERE c_custkey % 10 IN (0, 1)""",
    ),
    "stats": (
        ["csamples"],
        """SELECT namespace, target, poller, count(*) AS polls_total, count(*) FILTER (valid) AS polls_success,
                  count(*) FILTER (NOT valid) AS polls_failed,
                  count(*) FILTER (error IN ('get: request timeout', 'get: context deadline exceeded',
                                             'context cancelled')) AS polls_timeout,
                  CAST(sum(poll_ms) AS BIGINT) AS poll_ms_sum, min(poll_ms) AS poll_ms_min,
                  max(poll_ms) AS poll_ms_max, count(poll_ms) AS poll_ms_count,
                  CAST(sum(poll_ms) // count(poll_ms) AS BIGINT) AS poll_ms_avg
           FROM csamples GROUP BY ALL""",
    ),
    "health": (["csamples"], None),
    "info": (
        ["pollers", "health", "stats"],
        """SELECT p.namespace, p.target, p.name AS poller, p.description, p.protocol, p.admin_state, p.oper_state,
                  coalesce(h.health, 'unknown') AS health,
                  coalesce(h.consecutive_failures, 0) AS consecutive_failures, coalesce(h.last_error, '') AS last_error,
                  h.last_poll_at, h.last_success_at, h.last_failure_at,
                  coalesce(polls_total, 0) AS polls_total, coalesce(polls_success, 0) AS polls_success,
                  coalesce(polls_failed, 0) AS polls_failed, coalesce(polls_timeout, 0) AS polls_timeout,
                  coalesce(poll_ms_sum, 0) AS poll_ms_sum, CAST(coalesce(poll_ms_min, 0) AS BIGINT) AS poll_ms_min,
                  CAST(coalesce(poll_ms_max, 0) AS BIGINT) AS poll_ms_max,
                  coalesce(poll_ms_count, 0) AS poll_ms_count, coalesce(poll_ms_avg, 0) AS poll_ms_avg
           FROM pollers p
                LEFT JOIN health h ON p.namespace = h.namespace AND p.target = h.target AND p.name = h.poller
                LEFT JOIN stats s ON p.namespace = s.namespace AND p.target = s.target AND p.name = s.poller""",
    ),
}


def timeline_sql(source: str, down_after: int = 3) -> str:
    """Health after every poll of a sample table."""

    def state(run: str) -> str:
        return (
            f"CASE WHEN {run} IS NULL THEN 'unknown' WHEN {run} = 0 THEN 'up' "
            f"WHEN {run} < {down_after} THEN 'degraded' ELSE 'down' END"
        )

    series = "PARTITION BY namespace, target, poller"
    return f"""
      SELECT namespace, target, poller, timestamp_ms, seq, valid, {state('prev_run')} AS previous,
             {state('run')} AS health, run AS consecutive_failures,
             CASE WHEN valid THEN '' ELSE coalesce(error, '') END AS last_error, last_success_at, last_failure_at
      FROM (SELECT *, lag(run) OVER ({series} ORDER BY timestamp_ms, seq) AS prev_run
            FROM (SELECT *, CAST(sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER ({series}, grp ORDER BY timestamp_ms, seq) AS BIGINT) AS run
                  FROM (SELECT *,
                               sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER ({series} ORDER BY timestamp_ms, seq) AS grp,
                               max(CASE WHEN valid THEN timestamp_ms END) OVER ({series} ORDER BY timestamp_ms, seq) AS last_success_at,
                               max(CASE WHEN NOT valid THEN timestamp_ms END) OVER ({series} ORDER BY timestamp_ms, seq) AS last_failure_at
                        FROM {source})))"""


def current_sql(source: str) -> str:
    """Health after the newest poll of each series."""
    return f"""
      SELECT namespace, target, poller, health, consecutive_failures, last_error, timestamp_ms AS last_poll_at,
             last_success_at, last_failure_at
      FROM ({timeline_sql(source)})
      QUALIFY row_number() OVER (PARTITION BY namespace, target, poller ORDER BY timestamp_ms DESC, seq DESC) = 1"""


PARTS["health"] = (["csamples"], current_sql("csamples"))


def bucket(ms: str, tier: str) -> str:
    width = TIERS[tier].width_ms
    if tier == "weekly":
        return f"(({ms} - {FIRST_MONDAY_MS}) // {width} * {width} + {FIRST_MONDAY_MS})"
    return f"({ms} // {width} * {width})"


def rollup_sql(tier: str, source: str = "numeric", exact: bool = False) -> str:
    """Rollup of a table with a value column v."""
    start = bucket("timestamp_ms", tier)
    percentiles = "".join(
        f", round(quantile_cont(v, {q}), 6) AS {name}"
        for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
    )
    return f"""
      SELECT namespace, target, poller, {start} AS bucket_start, {start} + {TIERS[tier].width_ms} AS bucket_end,
             count(*) AS count, round(sum(v), 6) AS sum, round(min(v), 6) AS min, round(max(v), 6) AS max,
             round(sum(v) / count(*), 6) AS avg, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts
             {percentiles if exact else ''}
      FROM {source} GROUP BY namespace, target, poller, {start}"""


def sql(body: str, *parts: str, recursive: bool = False, **extra: str) -> str:
    """A statement with the named expressions in front, each after those it reads."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = PARTS[name]
        for need in needs:
            add(need)
        done[name] = text

    for part in parts:
        add(part)
    done.update(extra)
    chain = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{chain}\n{body}" if chain else body
