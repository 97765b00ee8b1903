import glob
from pathlib import Path

import pytest
from data import KEY, rows, sample, samples

from tierlake.operators import maintain, query, rollup
from tierlake.schemas import DAY_MS, HOUR_MS, SERIES, TIER_ORDER
from tierlake.session import scratch_path
from tierlake.sources import polls, tiers


def test_filter_is_a_conjunction_with_both_ends(spark):
    other = ("prod", "router-02", "cpu")
    df = samples(spark, [sample(t, t, key=k) for k in (KEY, other) for t in (10, 20, 30)])
    assert query.filter_samples(df).count() == 6
    assert query.filter_samples(df, "prod", "router-01").count() == 3
    assert rows(query.filter_samples(df, target="router-02", since_ms=10, until_ms=20), "timestamp_ms") == [(10,), (20,)]
    assert query.filter_samples(df, "dev").count() == 0
    assert rows(query.filter_samples(df, limit=2), "timestamp_ms") == [(10,), (10,)]


def test_history_and_display(spark):
    df = samples(
        spark,
        [sample(1, 1.5), sample(2, counter=7), sample(3, text="up"), sample(4, valid=False, error="boom")],
    )
    got = [(r["timestamp_ms"], r["display"]) for r in query.history(df, *KEY, limit=3).collect()]
    assert got == [(4, "ERROR: boom"), (3, "up"), (2, "7")]
    assert query.history(df, *KEY, since_ms=2, until_ms=3).count() == 2


def test_history_all_matches_one_series(spark):
    keys = [("n", "t", f"p{i}") for i in range(3)]
    df = samples(spark, [sample(t * 7 % 101, t, key=k, seq=t) for k in keys for t in range(50)])
    got = query.history_all(df, 5)
    assert got.count() == 15
    for key in keys:
        one = [r["seq"] for r in query.history(df, *key, limit=5).collect()]
        mine = [r["seq"] for r in got.where(f"poller = '{key[2]}'").orderBy("place").collect()]
        assert mine == one


def test_trim_keeps_ties(spark):
    df = samples(spark, [sample(t, 1, seq=i) for i, t in enumerate([1, 2, 2, 2, 3, 4])])
    assert rows(maintain.trim_latest(df, 3), "timestamp_ms") == [(2,), (2,), (2,), (3,), (4,)]
    assert maintain.trim_latest(df, 100).count() == 6


def test_latest_hot_retain_delete(spark):
    other = ("prod", "router-02", "cpu")
    df = samples(spark, [sample(t, t, key=k, seq=t) for k in (KEY, other) for t in (0, 500_000, 900_000)])
    assert rows(maintain.latest_sample(df), "timestamp_ms") == [(900_000,), (900_000,)]
    assert rows(maintain.hot_window(df, 400_000), "timestamp_ms") == [(500_000,), (500_000,), (900_000,), (900_000,)]
    assert maintain.retain_samples(df, 1_000_000, 200_000).count() == 2
    gone = spark.createDataFrame([KEY], "namespace string, target string, poller string")
    assert rows(maintain.delete_series(df, gone), "target")[0] == ("router-02",)


def test_tier_query_prunes_partitions_and_orders(spark):
    root = scratch_path(spark, "test-query")
    keys = [("n", "t", p) for p in ("b", "a")]
    df = samples(spark, [sample(h * HOUR_MS, h, key=k, seq=h) for k in keys for h in range(24 * 6)])
    tiers.write_samples(df, root)
    rollup.run_cascade(spark, root, 0, 6 * DAY_MS)
    start, end = DAY_MS, 4 * DAY_MS
    found = query.query_target(spark, root, "n", "t", start, end)
    got = [(r["bucket_start"], r["poller"], r["tier"]) for r in found.collect()]
    assert got == sorted(got) and {t for _, _, t in got} == {"5min"}
    assert got[0][0] >= start and got[-1][0] + 300_000 <= end
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_date" in plan and "bucket_date" in plan
    assert "PushedFilters" in plan and "sketch" not in plan.split("ReadSchema")[1]
    one = query.query_series(spark, root, "n", "t", "a", start, end, limit=5)
    assert [r["bucket_start"] for r in one.collect()] == [start + i * HOUR_MS for i in range(5)]


def test_hot_rows_are_not_counted_twice(spark):
    df = samples(spark, [sample(m * 60_000, 1, seq=m) for m in range(10)])
    cold = rollup.rollup_samples(samples(spark, [sample(m * 60_000, 1, seq=m) for m in range(5)]))
    merged = query.merge_hot(cold, df, 0, 600_000, "5min")
    assert sorted((r["part"], r["count"]) for r in merged.collect()) == [("cold", 5), ("hot", 5)]
    doubled = query.merge_hot(cold, df, 0, 600_000, "5min", dedupe=False)
    assert sorted((r["part"], r["count"]) for r in doubled.collect()) == [("cold", 5), ("hot", 10)]


def test_hot_rows_fill_holes_and_broken_ends(spark):
    """Three hours of samples, no cold bucket for the second one, and a span that begins and ends within an hour."""
    df = samples(spark, [sample(m * 60_000, 1, seq=m) for m in range(180)])
    cold = rollup.rollup_samples(df, "hourly").where(f"bucket_start <> {HOUR_MS}")
    whole = query.merge_hot(cold, df, 0, 3 * HOUR_MS, "hourly").collect()
    assert sorted((r["part"], r["count"]) for r in whole) == [("cold", 60), ("cold", 60), ("hot", 60)]
    cut = query.merge_hot(cold, df, 20 * 60_000, 160 * 60_000 - 1, "hourly").collect()
    assert sorted((r["part"], r["count"]) for r in cut) == [("hot", 140)]


def test_a_series_counts_each_sample_once(spark):
    root = scratch_path(spark, "test-series")
    df = samples(spark, [sample(h * HOUR_MS, 1, seq=h) for h in range(60)])
    tiers.write_tier(rollup.rollup_samples(df, "daily"), root, "daily")
    got = query.query_series(spark, root, *KEY, 0, 60 * HOUR_MS - 1, hot=df, tier="daily").collect()
    assert [r["count"] for r in got] == [24, 24, 12]


def test_many_requests_prune_partitions(spark):
    root = scratch_path(spark, "test-many")
    df = samples(spark, [sample(h * HOUR_MS, h, seq=h) for h in range(24 * 9)])
    tiers.write_samples(df, root)
    rollup.run_cascade(spark, root, 0, 9 * DAY_MS)
    requests = spark.createDataFrame(
        [(1, *KEY, 3 * DAY_MS, 4 * DAY_MS), (2, *KEY, 5 * DAY_MS, 8 * DAY_MS)],
        "request_id bigint, namespace string, target string, poller string, start_ms bigint, end_ms bigint",
    )
    found = query.query_many({t: tiers.scan_tier(spark, root, t) for t in TIER_ORDER}, requests)
    assert sorted((r["request_id"], r["tier"]) for r in found.select("request_id", "tier").distinct().collect()) == [(1, "raw"), (2, "5min")]
    assert found.groupBy("request_id").count().orderBy("request_id").collect() == [(1, 24), (2, 72)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert len(filters) >= len(TIER_ORDER) and all("bucket_date" in line.split("PartitionFilters")[1].split("]")[0] for line in filters)


def test_many_requests_leave_the_gap_between_them_unread(spark):
    """Files of the dates between two requests are broken; only a request that covers them meets that."""
    root = scratch_path(spark, "test-gap")
    df = samples(spark, [sample(h * HOUR_MS, h, seq=h) for h in range(24 * 9)])
    tiers.write_tier(rollup.rollup_samples(df, "raw"), root, "raw")
    tiers.write_tier(rollup.rollup_samples(df, "weekly"), root, "weekly")
    for day in range(3, 7):
        for file in glob.glob(f"{root}/raw/bucket_date=1970-01-0{day}/*.parquet"):
            Path(file).write_bytes(b"broken")
            Path(file).with_name(f".{Path(file).name}.crc").unlink(missing_ok=True)

    def ask(*spans):
        listed = [(n, *KEY, a, b) for n, (a, b) in enumerate(spans)]
        requests = spark.createDataFrame(
            listed, "request_id bigint, namespace string, target string, poller string, start_ms bigint, end_ms bigint"
        )
        found = query.query_many({t: tiers.scan_tier(spark, root, t) for t in ("raw", "weekly")}, requests)
        return {r["request_id"]: r["count"] for r in found.groupBy("request_id").count().collect()}

    far = (0, 4000 * DAY_MS)
    assert ask((0, DAY_MS), (8 * DAY_MS, 9 * DAY_MS), (5 * DAY_MS, 2 * DAY_MS), far) == {0: 24, 1: 24, 3: 1}
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        ask((0, DAY_MS), (3 * DAY_MS, 4 * DAY_MS))


def test_pages_cover_everything_once(spark):
    root = scratch_path(spark, "test-pages")
    keys = [("n", "t", p) for p in ("a", "b", "c")]
    df = samples(spark, [sample(h * HOUR_MS, h, key=k, seq=h) for k in keys for h in range(20)])
    tiers.write_tier(rollup.rollup_samples(df, "hourly"), root, "hourly")
    cursor, seen = None, []
    while True:
        page = query.query_preferred(spark, root, "n", "t", 0, DAY_MS, tier="hourly", limit=25, cursor=cursor).collect()
        seen += [(r["bucket_start"], r["poller"]) for r in page]
        if not page[-1]["has_more"]:
            break
        start, poller = [r["cursor"] for r in page if r["cursor"]][0].split("/")
        cursor = (int(start), poller)
    assert len(seen) == 60 and seen == sorted(set(seen))


def test_retention(spark):
    root = scratch_path(spark, "test-retention")
    df = samples(spark, [sample(h * HOUR_MS, h, seq=h) for h in range(24 * 5)])
    tiers.write_tier(rollup.rollup_samples(df, "hourly"), root, "hourly")
    policy = {"hourly": 2 * DAY_MS + 6 * HOUR_MS}
    now = 5 * DAY_MS
    report = maintain.retention_apply(spark, root, now, policy, dry_run=True).where("tier = 'hourly'").first()
    assert tiers.scan_tier(spark, root, "hourly").count() == 120
    assert (report["dates_to_drop"], report["dates_to_cut"], report["dates_to_keep"]) == (2, 1, 2)
    maintain.retention_apply(spark, root, now, policy)
    assert tiers.scan_tier(spark, root, "hourly").count() == 72
    maintain.retention_apply(spark, root, now, policy, exact=True)
    left = tiers.scan_tier(spark, root, "hourly")
    assert left.where(f"bucket_end < {now - policy['hourly']}").count() == 0
    assert left.count() == 120 - report["rows_to_drop"] == report["rows_to_keep"]


def test_poll_kinds_and_outcomes(spark):
    raw = spark.createDataFrame(
        [
            (*KEY, 1, "Counter64", str(2**64 - 1), None, 5, 1),
            (*KEY, 2, "Gauge32", "12", None, 5, 2),
            (*KEY, 3, "OctetString", "up", None, 5, 3),
            (*KEY, 4, "NoSuchObject", None, None, 5, 4),
            (*KEY, 5, "Opaque", "x", None, 5, 5),
            (*KEY, 6, "Integer", None, "get: request timeout", 5, 6),
            (*KEY, 7, "Integer", None, "connect: refused", 5, 7),
            (*KEY, 8, "Gauge32", "Infinity", None, 5, 8),
            (*KEY, 9, "Integer", "NaN", None, 5, 9),
        ],
        "namespace string, target string, poller string, timestamp_ms bigint, kind string, raw string, error string, "
        "poll_ms int, seq bigint",
    )
    got = polls.normalise_poll_results(raw).withColumn("outcome", polls.poll_outcome()).orderBy("seq").collect()
    assert [r["value_type"] for r in got] == ["counter", "gauge", "text", "gauge", "gauge", "gauge", "gauge", "gauge", "gauge"]
    assert int(got[0]["value_counter"]) == 2**64 - 1 and got[1]["value_gauge"] == 12.0 and got[2]["value_text"] == "up"
    assert [r["valid"] for r in got] == [True] * 3 + [False] * 6
    assert [r["error"] for r in got[3:]] == [
        "OID not found", "unsupported type: Opaque", "get: request timeout", "connect: refused",
        "value is not finite", "value is not finite",
    ]
    assert [r["outcome"] for r in got] == ["success"] * 3 + ["failed", "failed", "timeout", "failed", "failed", "failed"]
    summary = polls.ingest_summary(polls.normalise_poll_results(raw), 1000).first()
    assert (summary["received"], summary["ingested"], summary["invalid"], summary["text"], summary["series"]) == (9, 3, 6, 1, 1)


def test_adhoc_sql(spark):
    root = scratch_path(spark, "test-sql")
    tiers.write_samples(samples(spark, [sample(1, 2), sample(2, 4)]), root)
    rollup.ingest_range(spark, root, 0, 10)
    got = tiers.adhoc_sql(spark, root, "SELECT poller, avg FROM agg_5min UNION ALL SELECT poller, value_gauge FROM agg_samples")
    assert rows(got, "avg") == [(2.0,), (3.0,), (4.0,)]
    assert SERIES == ["namespace", "target", "poller"]
