import random

import pytest
from data import KEY, rows, sample, samples
from pyspark.sql import functions as F

from tierlake.operators import maintain, quantiles, rollup
from tierlake.schemas import AGGREGATES, DAY_MS, HOUR_MS, SERIES, TIER_ORDER
from tierlake.session import recorded, scratch_path
from tierlake.sources import tiers

EXACT = [*SERIES, "bucket_start", "count", "min", "max", "first_ts", "last_ts"]


def test_rotation(spark):
    df = samples(spark, [sample(1_000, 50), sample(301_000, 60)])
    got = rows(rollup.rollup_samples(df), "bucket_start", "bucket_end", "count", "avg")
    assert got == [(0, 300_000, 1, 50.0), (300_000, 600_000, 1, 60.0)]


def test_invalid_and_text_do_not_count(spark):
    df = samples(
        spark,
        [sample(10, 10), sample(20, 20), sample(30, 30), sample(40, 40, valid=False), sample(50, text="up")],
    )
    assert rows(rollup.rollup_samples(df), "count", "sum", "min") == [(3, 60.0, 10.0)]


def test_late_sample_goes_to_its_own_bucket(spark):
    df = samples(spark, [sample(301_000, 1, seq=1), sample(2_000, 5, seq=2)])
    assert rows(rollup.rollup_samples(df), "bucket_start", "sum") == [(0, 5.0), (300_000, 1.0)]


def test_percentiles_of_hundred(spark):
    df = samples(spark, [sample(i, i) for i in range(1, 101)])
    exact = rollup.rollup_samples(df, "5min", "exact").first()
    sketch = rollup.rollup_samples(df, "5min", True).first()
    for name, want in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99)):
        assert abs(exact[name] - want) <= 2
        assert abs(sketch[name] - want) <= 2
    assert sum(sketch["sketch"].values()) == 100


def agg(key, start, count, total, low, high, first, last):
    return (*key, start, start + 300_000, count, float(total), float(low), float(high), total / count,
            None, None, None, None, first, last, None, None)


def test_merge(spark):
    other = ("prod", "router-01", "memory")
    df = spark.createDataFrame(
        [
            agg(KEY, 600_000, 4, -6, -3, 2, 600_002, 600_090),
            agg(KEY, 3_300_000, 3, 81, 1, 64, 3_300_000, 3_599_999),
            agg(KEY, 3_600_000, 2, 5, 2, 3, 3_600_000, 3_600_001),
            agg(other, 900_000, 1, 0.5, 0.5, 0.5, 900_017, 900_017),
        ],
        AGGREGATES,
    )
    got = rows(rollup.merge_aggregates(df, "hourly"), "poller", "count", "sum", "min", "max", "avg", "first_ts", "last_ts")
    assert got == [
        ("cpu", 2, 5.0, 2.0, 3.0, 2.5, 3_600_000, 3_600_001),
        ("cpu", 7, 75.0, -3.0, 64.0, 75 / 7, 600_002, 3_599_999),
        ("memory", 1, 0.5, 0.5, 0.5, 0.5, 900_017, 900_017),
    ]
    # Sums are the same when sketches are merged along, also where there are none.
    with_sketch = rows(rollup.merge_aggregates(df, "hourly", True), "poller", "count", "sum", "min", "max", "avg", "first_ts", "last_ts")
    assert with_sketch == got


def noisy(spark, n=3000, keys=3):
    rng = random.Random(7)
    out = []
    for i in range(n):
        key = ("n", "t", f"p{rng.randrange(keys)}")
        out.append(sample(rng.randrange(20 * DAY_MS), rng.uniform(-50, 1000), rng.random() > 0.1, key, seq=i))
    return samples(spark, out)


def test_merging_equals_direct(spark):
    df = noisy(spark)
    fine = rollup.rollup_samples(df, "5min", True)
    hourly = rollup.merge_aggregates(fine, "hourly", True)
    by_steps = rollup.merge_aggregates(hourly, "daily", True)
    at_once = rollup.merge_aggregates(fine, "daily", True)
    direct = rollup.rollup_samples(df, "daily", True)
    want = rows(direct, *EXACT)
    assert rows(by_steps, *EXACT) == want == rows(at_once, *EXACT)
    ps = [*SERIES, "bucket_start", "p50", "p90", "p95", "p99"]
    assert rows(by_steps, *ps) == rows(direct, *ps) == rows(at_once, *ps)
    sums = direct.select(*SERIES, "bucket_start", F.col("sum").alias("s")).join(by_steps, [*SERIES, "bucket_start"])
    assert sums.where(F.abs(F.col("s") - F.col("sum")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("s"))).count() == 0


@pytest.mark.parametrize("alpha", [0.01, 0.05])
def test_relative_error_bound(spark, alpha):
    rng = random.Random(3)
    values = sorted([rng.lognormvariate(2, 3) for _ in range(1500)] + [0.0] * 40 + [-rng.expovariate(0.1) for _ in range(300)])
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    sketch = quantiles.percentiles_relative(df, ["k"], "v", alpha)
    row = quantiles.sketch_quantiles(sketch, {"p01": 0.01, "p15": 0.15}, alpha).first()
    for name, q in {**quantiles.QUANTILES, "p01": 0.01, "p15": 0.15}.items():
        exact = values[int((len(values) - 1) * q)]
        assert abs(row[name] - exact) <= alpha * abs(exact) + 1e-12, name


def test_exact_percentiles_against_sorted_values(spark):
    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 10) for _ in range(801)], "b": [4.0] * 50 + [5.0], "c": [1e9 + i for i in range(500)], "d": [2.5],
              "e": [50 + rng.random() / 500 for _ in range(9000)], "f": [50.0, 50.0 + 2**-40] * 300}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in quantiles.percentiles_exact(df, ["k"], "v").collect()}
    for key, values in groups.items():
        ordered = sorted(values)
        for name, q in quantiles.QUANTILES.items():
            pos = (len(ordered) - 1) * q
            low = int(pos)
            high = min(low + 1, len(ordered) - 1)
            want = ordered[low] + (ordered[high] - ordered[low]) * (pos - low)
            assert got[key][name] == pytest.approx(want, rel=1e-12), (key, name)


def test_exact_percentiles_keep_groups_without_a_key_and_read_once(spark, tmp_path):
    rows = [(None, float(v)) for v in range(11)] + [("a", 1.0), ("a", 3.0), ("b", float("nan")), (None, None)]
    spark.createDataFrame(rows, "k string, v double").write.parquet(str(tmp_path / "facts"))
    found = quantiles.percentiles_exact(spark.read.parquet(str(tmp_path / "facts")), ["k"], "v", {"p50": 0.5})
    assert {r["k"]: r["p50"] for r in found.collect()} == {None: 5.0, "a": 2.0}
    assert not any(str(tmp_path) in f for f in found.inputFiles())
    empty = quantiles.percentiles_exact(spark.createDataFrame([], "k string, v double"), ["k"], "v")
    assert empty.count() == 0 and empty.columns == ["k", *quantiles.QUANTILES]


def test_exact_percentiles_of_small_and_large_groups_agree(spark, monkeypatch):
    """Small groups are shuffled once after they are counted, whatever the number of quantiles and measures."""
    rows = [(None, "x", float(v % 7)) for v in range(40)] + [("a", None, v * 0.5) for v in range(9)] + [("b", "y", -1.0)]
    df = spark.createDataFrame(rows, "k string, l string, v double")
    riding = [quantiles.Measure("v_sum", F.sum("v"), F.sum, ("v",)), quantiles.Measure("l_max", F.max("l"), F.max, ("l",))]

    def found():
        return quantiles.percentiles_exact(df, ["k"], "v", measures=riding)

    small = found()
    assert small._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, small.collect()), key=repr)
    for size in (0, 5, 20):
        monkeypatch.setattr(quantiles, "SMALL_GROUP", size)
        assert sorted(map(tuple, found().collect()), key=repr) == want


def test_approximate_rank_error(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10_000_000)).cast("double").alias("v"))
    ordered = sorted(r["v"] for r in df.collect())
    approx = quantiles.percentiles_approx(df, ["k"], "v", 1000).first()
    halves = quantiles.kll_sketch(df.withColumn("h", F.col("v") % 4), ["k", "h"], "v")
    kll = quantiles.kll_quantiles(quantiles.merge_kll(halves, ["k"])).first()
    for name, q in quantiles.QUANTILES.items():
        for row, bound in ((approx, 1 / 1000), (kll, 3 * quantiles.rank_error_bound(400))):
            rank = sum(1 for v in ordered if v <= row[name]) / len(ordered)
            assert abs(rank - q) <= bound + 1e-3, name


@pytest.mark.parametrize("kll_k", [None, 8000])
def test_order_statistics_of_groups_larger_than_the_summary(spark, kll_k):
    n = 300_000
    value = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, "k").alias("k"), value.alias("v"))
    odd = [("small", 2.0), ("small", 1.0), ("small", float("inf")), ("none", None), *[("equal", 7.0)] * 50]
    df = df.unionByName(spark.createDataFrame(odd, "k string, v double")).persist()
    table = df.where("v < 1e9").toPandas()
    names = quantiles.QUANTILES
    want = {}
    for key in (None, "k", "small", "equal"):
        ordered = sorted(table["v"][table["k"].isna() if key is None else table["k"] == key])
        want[key] = [ordered[-(-len(ordered) * round(q * 100) // 100) - 1] for q in names.values()]
    got = quantiles.percentiles_discrete(df, ["k"], "v", kll_k=kll_k).collect()
    assert {r["k"]: [r[p] for p in names] for r in got} == want
    # Ends that miss the wanted ranks cost a second pass, not the result.
    got = quantiles.percentiles_discrete(df, ["k"], "v", accuracy=20, kll_k=kll_k and 20, margin=0.0).collect()
    assert {r["k"]: [r[p] for p in names] for r in got} == want


def test_span(spark):
    df = samples(spark, [sample(i * 100, i * 10) for i in range(10)] + [sample(5_000, 999)])
    row = rollup.aggregate_span(df, 0, 900).first()
    assert (row["count"], row["sum"], row["min"], row["max"]) == (10, 450.0, 0.0, 90.0)
    assert (row["bucket_start"], row["bucket_end"]) == (0, 900)
    none = samples(spark, [sample(1, 5, valid=False)])
    assert rollup.aggregate_span(none, 0, 10).count() == 0


def test_cascade_is_repeatable_and_complete(spark):
    root = scratch_path(spark, "test-cascade")
    df = noisy(spark)
    tiers.write_samples(df, root)
    rollup.run_cascade(spark, root, 0, 20 * DAY_MS)
    first = {t: rows(tiers.scan_tier(spark, root, t), *EXACT, "p95") for t in ("5min", "hourly", "daily", "weekly")}
    for tier, got in first.items():
        assert got == rows(rollup.rollup_samples(df, tier, True), *EXACT, "p95"), tier
    rollup.run_cascade(spark, root, 0, 20 * DAY_MS)
    rollup.compact(spark, root, "5min", "hourly", 3 * DAY_MS + HOUR_MS, 3 * DAY_MS + 2 * HOUR_MS)
    for tier, want in first.items():
        assert rows(tiers.scan_tier(spark, root, tier), *EXACT, "p95") == want, tier


def test_compaction_after_retention_keeps_what_was_made(spark):
    root = scratch_path(spark, "test-lifecycle")
    df = samples(spark, [sample(h * HOUR_MS, h, seq=h) for h in range(24 * 20)])
    tiers.write_samples(df, root)
    rollup.run_cascade(spark, root, 0, 20 * DAY_MS)
    want = {t: rows(tiers.scan_tier(spark, root, t), *EXACT) for t in ("hourly", "daily", "weekly")}
    now = 20 * DAY_MS
    # The edges lie within a day and within a week.
    policy = {"raw": DAY_MS, "5min": 3 * DAY_MS + 7 * HOUR_MS, "hourly": 8 * DAY_MS + HOUR_MS}
    maintain.retention_apply(spark, root, now, policy, exact=True, samples_age_ms=2 * DAY_MS + 5 * HOUR_MS)
    assert tiers.scan_samples(spark, root).count() == 53
    left = {t: rows(tiers.scan_tier(spark, root, t), *EXACT) for t in TIER_ORDER}
    for _ in range(2):
        rollup.run_cascade(spark, root, 0, 20 * DAY_MS)
    for tier in ("daily", "weekly"):
        assert rows(tiers.scan_tier(spark, root, tier), *EXACT) == want[tier], tier
    for tier in ("raw", "5min", "hourly"):
        assert set(left[tier]) <= set(rows(tiers.scan_tier(spark, root, tier), *EXACT)), tier
    assert set(rows(tiers.scan_tier(spark, root, "hourly"), *EXACT)) <= set(want["hourly"])


def test_buckets_without_samples_go(spark):
    root = scratch_path(spark, "test-stale")
    df = samples(spark, [sample(h * HOUR_MS, h, seq=h) for h in range(48)])
    tiers.write_samples(df, root)
    rollup.run_cascade(spark, root, 0, 2 * DAY_MS)
    invalid = tiers.scan_samples(spark, root).withColumn("valid", F.col("timestamp_ms") >= DAY_MS)
    tiers.rewrite_dates(spark, root, "samples", invalid, [tiers.utc_day(0), tiers.utc_day(DAY_MS)])
    rollup.run_cascade(spark, root, 0, 2 * DAY_MS)
    assert {t: tiers.scan_tier(spark, root, t).count() for t in TIER_ORDER} == {"raw": 24, "5min": 24, "hourly": 24, "daily": 1, "weekly": 1}
    none = tiers.scan_samples(spark, root).withColumn("valid", F.lit(False))
    tiers.rewrite_dates(spark, root, "samples", none, [tiers.utc_day(0), tiers.utc_day(DAY_MS)])
    rollup.run_cascade(spark, root, 0, 2 * DAY_MS)
    assert all(tiers.scan_tier(spark, root, t).count() == 0 for t in TIER_ORDER)


def test_stored_series_are_deleted(spark):
    root = scratch_path(spark, "test-delete")
    keys = [("n", "t", p) for p in "ab"]
    df = samples(spark, [sample(h * DAY_MS, h, key=k, seq=h) for k in keys for h in range(5)])
    df = df.union(samples(spark, [sample(9 * DAY_MS, 1, key=keys[0])]))
    tiers.write_samples(df, root)
    rollup.run_cascade(spark, root, 0, 10 * DAY_MS)
    maintain.delete_series_stored(spark, root, spark.createDataFrame(keys[:1], "namespace string, target string, poller string"))
    assert rows(tiers.scan_samples(spark, root).select("poller").distinct(), "poller") == [("b",)]
    for tier in TIER_ORDER:
        got = tiers.scan_tier(spark, root, tier)
        assert rows(got.select("poller").distinct(), "poller") == [("b",)] and got.agg(F.sum("count")).first()[0] == 5


def test_rewritten_dates_move_once(spark):
    """Rows that come from the dates they replace are not copied aside; rows of other dates stay."""
    root = scratch_path(spark, "test-rewrite")
    tiers.write_samples(samples(spark, [sample(d * DAY_MS + s, s, seq=10 * d + s) for d in range(3) for s in range(10)]), root)
    kept = tiers.scan_samples(spark, root, 0, 2 * DAY_MS - 1).where("seq % 2 = 0 AND seq < 10")
    with recorded() as made:
        tiers.rewrite_dates(spark, root, "samples", kept, [tiers.utc_day(0), tiers.utc_day(DAY_MS)])
    assert made == []
    assert rows(tiers.scan_samples(spark, root), "seq") == sorted([(s,) for s in [0, 2, 4, 6, 8, *range(20, 30)]], key=repr)


@pytest.mark.parametrize("odd", [float("inf"), float("-inf"), float("nan")])
def test_values_that_are_not_finite(spark, odd):
    """They neither abort a cascade nor move a percentile."""
    values = [float(i) for i in range(1, 101)]
    df = samples(spark, [sample(i, v, seq=i) for i, v in enumerate([*values, odd])])
    for percentiles in (True, "exact"):
        row = rollup.rollup_samples(df, "5min", percentiles).first()
        assert (row["count"], row["max"]) == (100, 100.0) and abs(row["p50"] - 50.5) < 1
    raw = spark.createDataFrame([(v,) for v in [*values, odd, None]], "v double").withColumn("k", F.lit("k"))
    for found in (quantiles.percentiles_exact(raw, ["k"], "v"), quantiles.percentiles_relative(raw, ["k"], "v")):
        assert abs(found.first()["p50"] - 50.5) < 1
    root = scratch_path(spark, "test-finite")
    tiers.write_samples(df, root)
    rollup.run_cascade(spark, root, 0, 1)
    assert tiers.scan_tier(spark, root, "weekly").first()["count"] == 100


def test_tier_io(spark):
    root = scratch_path(spark, "test-io")
    assert tiers.scan_tier(spark, root, "daily").count() == 0
    assert tiers.tier_stats(spark, root).count() == 0
    daily = rollup.rollup_samples(noisy(spark), "daily")
    with pytest.raises(ValueError):
        tiers.write_tier(daily, root, "daily", "brotli")
    for codec in tiers.CODECS:
        tiers.write_tier(daily, root, "daily", codec)
        assert rows(tiers.scan_tier(spark, root, "daily"), *EXACT) == rows(daily, *EXACT)
    found = tiers.tier_stats(spark, root)
    assert found.agg(F.sum("rows")).first()[0] == daily.count()
    assert found.where("files < 1 or bytes < 1").count() == 0


def test_unset_percentiles_stay_null(spark):
    root = scratch_path(spark, "test-null")
    zeros = samples(spark, [sample(i, 0) for i in range(5)])
    tiers.write_tier(rollup.rollup_samples(zeros, "5min"), root, "5min")
    assert rows(tiers.scan_tier(spark, root, "5min"), "p50") == [(None,)]
    tiers.write_tier(rollup.rollup_samples(zeros, "5min", True), root, "5min")
    assert rows(tiers.scan_tier(spark, root, "5min"), "p50") == [(0.0,)]
