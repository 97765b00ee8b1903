from data import KEY, rows, sample, samples

from tierlake.operators import health, stats
from tierlake.sources import demo


def test_poller_stats_and_merge(spark):
    first = samples(spark, [sample(1, 1, poll_ms=10), sample(2, valid=False, error="get: request timeout", poll_ms=31)])
    second = samples(spark, [sample(3, valid=False, error="refused", poll_ms=2), sample(4, 1, key=("n", "t", "p"), poll_ms=7)])
    a, b = stats.poller_stats(first), stats.poller_stats(second)
    whole = stats.poller_stats(first.unionByName(second))
    assert rows(stats.poller_stats_merge(a, b), *whole.columns) == rows(whole, *whole.columns)
    row = whole.where("poller = 'cpu'").first()
    assert (row["polls_total"], row["polls_success"], row["polls_failed"], row["polls_timeout"]) == (3, 1, 2, 1)
    assert (row["poll_ms_sum"], row["poll_ms_min"], row["poll_ms_max"], row["poll_ms_avg"]) == (43, 2, 31, 14)
    total = stats.stats_global(whole).first()
    assert (total["pollers"], total["polls_total"], total["avg_poll_ms"]) == (2, 4, 12.5)


def test_no_polls(spark):
    empty = stats.poller_stats(samples(spark, []))
    total = stats.stats_global(empty).first()
    assert (total["pollers"], total["polls_total"], total["avg_poll_ms"]) == (0, 0, 0.0)
    pollers = spark.createDataFrame(
        [("n", "t", "p", "", "snmp", "enabled", "stopped")],
        "namespace string, target string, name string, description string, protocol string, admin_state string, oper_state string",
    )
    info = stats.poller_full_info(pollers, health.health_current(samples(spark, [])), empty)
    assert stats.success_rate(info).first()["success_rate"] == "N/A"
    assert (info.first()["health"], info.first()["poll_ms_min"]) == ("unknown", 0)
    assert dict(stats.health_counts(info).collect()) == {"unknown": 1, "up": 0, "degraded": 0, "down": 0}


def test_success_rate_rounds_exact_values(spark):
    polls = [(1, 800), (3, 800), (1, 32), (5, 32), (1, 20_000), (3, 20_000), (0, 7), (7, 7), (2, 3), (1, 3_000_000_000)]
    polls += [(s, t) for t in (160, 400, 2_000, 20_000, 99_991) for s in range(0, t, max(1, t // 997))]
    df = spark.createDataFrame(polls, "polls_success long, polls_total long")
    got = stats.success_rate(df).collect()
    # Python formats a double by its exact value, as the SQL side does.
    assert {(r[0], r[1]): r[2] for r in got} == {(s, t): f"{s / t * 100:.2f}%" for s, t in polls}


def test_empty_parents_show_zero(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    targets = spark.createDataFrame([("a", "t1"), ("a", "t2")], "namespace string, name string")
    pollers = spark.createDataFrame([("a", "t1", "p", "enabled")], "namespace string, target string, name string, admin_state string")
    assert rows(stats.namespace_counts(names, targets, pollers), "namespace", "targets", "pollers", "pollers_enabled") == [
        ("a", 2, 1, 1), ("b", 0, 0, 0),
    ]
    assert rows(stats.target_counts(targets, pollers), "target", "pollers") == [("t1", 1), ("t2", 0)]


def test_alert_levels(spark):
    df = spark.createDataFrame(
        [("poll_success_rate", v) for v in (95.0, 94.9, 79.9, None)] + [("queue_usage_percent", v) for v in (70.0, 70.1, 90.1)] + [("other", 1.0)],
        "metric string, value double",
    )
    levels = [r["level"] for r in stats.metric_alerts(df).collect()]
    assert levels == ["ok", "warning", "critical", None, "ok", "warning", "critical", None]


def test_worst_state_moves_up(spark):
    df = spark.createDataFrame(
        [("a", "t1", "up"), ("a", "t1", "down"), ("a", "t2", "unknown"), ("b", "t3", "up")], "namespace string, target string, health string"
    )
    got = {(r["namespace"], r["target"]): (r["depth"], r["entities"], r["status"]) for r in stats.hierarchy_rollup(df, ["namespace", "target"]).collect()}
    assert got[("a", "t1")] == (2, 2, "down") and got[("a", None)] == (1, 3, "down")
    assert got[("b", None)] == (1, 1, "up") and got[(None, None)] == (0, 4, "down") and got[("a", "t2")][2] == "unknown"


def test_status_totals_agree(spark, sf):
    found = demo.samples(spark, sf, "customer")
    info = stats.poller_full_info(demo.pollers(spark, sf), health.health_current(found), stats.poller_stats(found))
    fleet = stats.fleet_status(demo.namespaces(spark, sf), demo.targets(spark, sf), info).first()
    spaces = stats.namespace_status(demo.namespaces(spark, sf), demo.targets(spark, sf), info).collect()
    assert fleet["polls_total"] == found.count() == sum(r["polls_total"] for r in spaces)
    assert fleet["pollers"] == sum(r["pollers"] for r in spaces) and fleet["namespaces"] == len(spaces)
    assert fleet["pollers_up"] == sum(r["pollers_up"] for r in spaces)
    assert KEY[0] == "prod"
