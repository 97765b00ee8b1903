"""Operators that follow a series in time, against plain loops and for any chunk width."""

import random
from decimal import Decimal

import numpy as np
import pytest
from data import KEY, sample, samples
from pyspark.sql import functions as F

from tierlake.operators import chunks, health, levels, live, rates
from tierlake.schemas import HOUR_MS, LEVELS

WIDTHS = [chunks.CHUNK_MS, 7_000, 60_000, HOUR_MS]


def fleet(spark, seed=1, n=400, fail=0.45):
    rng = random.Random(seed)
    out, seq = [], 0
    for key in (KEY, ("prod", "router-01", "mem"), ("dev", "sw", "cpu")):
        at = 0
        for _ in range(n):
            at += rng.choice([0, 500, 1_000, 5_000, 30_000, 400_000])
            good = rng.random() > fail
            out.append(sample(at, 1 if good else None, good, key, error=None if good else f"e{seq}", seq=seq))
            seq += 1
    return out


def by_series(rows):
    series = {}
    for r in rows:
        series.setdefault(r[:3], []).append(r)
    return {k: sorted(v, key=lambda r: (r[3], r[11])) for k, v in series.items()}


def expected_health(rows, down_after=3):
    out = {}
    for polls in by_series(rows).values():
        run, state, success, failure = 0, "unknown", None, None
        for r in polls:
            before = state
            if r[8]:
                run, state, success, error = 0, "up", r[3], ""
            else:
                run, failure, error = run + 1, r[3], r[9]
                state = "down" if run >= down_after else "degraded"
            out[r[11]] = (before, state, run, error, success, failure)
    return out


def timeline_rows(df):
    names = ["previous", "health", "consecutive_failures", "last_error", "last_success_at", "last_failure_at"]
    return {r["seq"]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("chunk_ms", WIDTHS)
def test_health_timeline(spark, chunk_ms):
    rows = fleet(spark)
    got = timeline_rows(health.health_timeline(samples(spark, rows), chunk_ms=chunk_ms))
    assert got == expected_health(rows)


def test_health_carried_over_days(spark):
    rows = fleet(spark, 2)
    want, got, carry = expected_health(rows), {}, None
    for low, high in ((0, 5_000_000), (5_000_000, 5_600_000), (5_600_000, 10**12)):
        part = samples(spark, [r for r in rows if low <= r[3] < high])
        got.update(timeline_rows(health.health_timeline(part, carry=carry, chunk_ms=60_000)))
        carry = health.health_current(part, carry=carry)
    assert got == want
    last = {polls[-1][:3]: want[polls[-1][11]] for polls in by_series(rows).values()}
    for r in carry.collect():
        assert (r["health"], r["consecutive_failures"]) == last[(r["namespace"], r["target"], r["poller"])][1:3]


def test_unpolled_pollers_are_unknown(spark):
    pollers = spark.createDataFrame(
        [("prod", "router-01", "cpu"), ("prod", "router-09", "cpu")], "namespace string, target string, name string"
    )
    df = samples(spark, [sample(1, valid=False, error="x"), sample(2, valid=False, error="y")])
    got = {r["target"]: (r["health"], r["consecutive_failures"], r["last_error"]) for r in health.health_current(df, pollers).collect()}
    assert got == {"router-01": ("degraded", 2, "y"), "router-09": ("unknown", 0, "")}


def test_reachability_and_transitions(spark):
    rows = fleet(spark, 3)
    timeline = health.health_timeline(samples(spark, rows))
    got = {r["seq"]: r["state"] for r in health.reachability_sticky(timeline).collect()}
    changes = {r["seq"]: (r["old_state"], r["new_state"]) for r in health.health_transitions(timeline).collect()}
    for polls in by_series(rows).values():
        state, errors = "polling", 0
        for r in polls:
            errors = 0 if r[8] else errors + 1
            state = "polling" if r[8] else "unreachable" if errors >= 3 else state
            assert got[r[11]] == state
    assert changes == {s: (a, b) for s, (a, b, *_) in expected_health(rows).items() if a != b}


def ratios(spark, seed, n=500):
    rng = random.Random(seed)
    out, seq = [], 0
    for key in (KEY, ("dev", "sw", "cpu")):
        at, load = 0, 0.5
        for _ in range(n):
            at += rng.choice([0, 1_000, 4_000, 9_000, 30_000, 300_000])
            load = min(1.0, max(0.0, load + rng.uniform(-0.2, 0.19)))
            out.append((*key, at, seq, load if rng.random() > 0.02 else None))
            seq += 1
    return out


SCHEMA = "namespace string, target string, poller string, timestamp_ms bigint, seq bigint, ratio double"


def step(level, u, rule):
    for code, limit in ((3, rule.emergency), (2, rule.critical), (1, rule.warning)):
        if u >= limit:
            return code
    limit = (None, rule.warning, rule.critical, rule.emergency)[level]
    return level - 1 if level and u < limit - rule.hysteresis else level


def expected_levels(rows, rule, cooldown=0):
    out = {}
    series = {}
    for r in rows:
        series.setdefault(r[:3], []).append(r)
    for polls in series.values():
        level, checked = 0, None
        for r in sorted(polls, key=lambda r: (r[3], r[4])):
            before = level
            due = not cooldown or checked is None or r[3] - checked >= cooldown
            if due:
                checked = r[3]
                level = level if r[5] is None else step(level, r[5], rule)
            out[r[4]] = (due, LEVELS[before], LEVELS[level])
    return out


def level_rows(df):
    return {r["seq"]: (r["evaluated"], r["previous"], r["level"]) for r in df.collect()}


RULES = [levels.LevelRule(), levels.LevelRule(0.3, 0.5, 0.6, 0.35), levels.LevelRule(0.4, 0.45, 0.9, 0.0)]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("chunk_ms", [chunks.CHUNK_MS, 50_000])
def test_levels(spark, rule, chunk_ms):
    rows = ratios(spark, 4)
    got = level_rows(levels.level_hysteresis(spark.createDataFrame(rows, SCHEMA), rule=rule, chunk_ms=chunk_ms))
    assert got == expected_levels(rows, rule)


@pytest.mark.parametrize("cooldown", [5_000, 30_000, 700_000])
def test_levels_with_cooldown(spark, cooldown):
    rows = ratios(spark, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected_levels(rows, RULES[0], cooldown)
    for chunk_ms in (chunks.CHUNK_MS, 20_000, 600_000):
        assert level_rows(levels.level_hysteresis(df, cooldown_ms=cooldown, chunk_ms=chunk_ms)) == want


def with_nulls(seed=7):
    """Series with a null key, null times and sequence numbers, and rows that repeat."""
    rng = random.Random(seed)
    out = []
    for key in (KEY, ("dev", None, "cpu"), (None, None, None)):
        at = 0
        for i in range(60):
            at += rng.choice([0, 0, 2_000, 9_000, 40_000])
            seq = rng.choice([i, i, None])
            row = (*key, at, seq, rng.choice([0.2, 0.3, 0.6, 0.85, 0.97]))
            out += [row] * rng.choice([1, 1, 3])
        out += [(*key, None, 900, 0.9), (*key, None, None, 0.1)]
    return out


def loop_with_nulls(rows, rule, cooldown):
    """All rows in order of time and seq, nulls first; a row without a time is not evaluated under a cooldown."""
    rank = lambda v: (v is not None, v or 0)
    out = []
    for key in {r[:3] for r in rows}:
        level, checked = 0, None
        for r in sorted((r for r in rows if r[:3] == key), key=lambda r: (rank(r[3]), rank(r[4]), r[5])):
            before = level
            due = not cooldown or (r[3] is not None and (checked is None or r[3] - checked >= cooldown))
            if due:
                checked, level = r[3], step(level, r[5], rule)
            out.append((*r, due, LEVELS[before], LEVELS[level]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cooldown", [0, 5_000, 30_000])
@pytest.mark.parametrize("chunk_ms", [chunks.CHUNK_MS, 20_000])
def test_no_row_is_lost(spark, cooldown, chunk_ms):
    # Of rows with one time and seq the order is open: they have the same ratio here.
    rows, seen = [], {}
    for r in with_nulls():
        rows.append((*r[:5], seen.setdefault(r[:5], r[5])))
    got = levels.level_hysteresis(spark.createDataFrame(rows, SCHEMA).repartition(4), cooldown_ms=cooldown, chunk_ms=chunk_ms)
    assert sorted(map(tuple, got.collect()), key=repr) == loop_with_nulls(rows, RULES[0], cooldown)


def test_cooldown_carried_over(spark):
    rows = [r for r in ratios(spark, 12) if r[5] is not None]
    want, got, carry = expected_levels(rows, RULES[0], 30_000), {}, None
    for low, high in ((0, 3_000_000), (3_000_000, 9_000_000), (9_000_000, 10**12)):
        part = spark.createDataFrame([r for r in rows if low <= r[3] < high], SCHEMA)
        done = levels.level_hysteresis(part, cooldown_ms=30_000, carry=carry, chunk_ms=600_000)
        got.update(level_rows(done))
        carry = levels.level_final(done)
    assert got == want


@pytest.mark.parametrize("cooldown", [1, 7, 1_000])
def test_step_functions(cooldown):
    """Slices composed in any grouping lead where a plain walk leads, from any allowed time."""
    rng = random.Random(cooldown)
    times = np.unique([rng.randrange(6_000) for _ in range(400)])
    cut = [times[(times >= a) & (times < a + 500)] for a in range(0, 6_000, 500)]
    for allowed in [np.iinfo(np.int64).min, 0, 3, 400, 1_200]:
        now, walked = allowed, []
        for t in times:
            if t >= now:
                walked.append(t)
                now = t + cooldown
        after, found = allowed, []
        for part in cut:
            # A chain begins within a cooldown of the first sample, or with the next sample after that.
            found += list(levels._chain(part, cooldown, after))
            after = int(levels.step_applied(np.array([after]), *levels._slice_function(part, cooldown))[0])
        if allowed <= times[0] + cooldown:
            assert found == walked and after == now


def test_cooldown_spreads_a_hot_series(spark):
    """A day of one series is many slices, each a group of its own, and only step functions meet."""
    df = spark.range(200_000).select(
        F.lit("n").alias("namespace"), F.lit("t").alias("target"), F.lit("p").alias("poller"),
        (F.col("id") * 432).alias("timestamp_ms"), F.col("id").alias("seq"), F.lit(0.6).alias("ratio"),
    )
    picks = levels.cooldown_picks(df, list(levels.SERIES), 300_000)
    at = sorted(r.timestamp_ms for r in picks.collect())
    want = [0]
    while want[-1] + 300_000 <= 199_999 * 432:
        want.append(-(-(want[-1] + 300_000) // 432) * 432)
    assert at == want
    plan = picks._jdf.queryExecution().executedPlan().toString()
    assert "place" in plan and "CartesianProduct" not in plan


def test_documented_levels(spark):
    df = spark.createDataFrame([(*KEY, i, i, u) for i, u in enumerate((0.55, 0.45, 0.35))], SCHEMA)
    got = levels.level_hysteresis(df).orderBy("seq").collect()
    assert [r["level"] for r in got] == ["warning", "warning", "normal"]
    # A fall from emergency to above critical lands there at once.
    df = spark.createDataFrame([(*KEY, i, i, u) for i, u in enumerate((0.99, 0.85, 0.2, 0.2, 0.2))], SCHEMA)
    done = levels.level_hysteresis(df)
    assert [r["level"] for r in done.orderBy("seq").collect()] == ["emergency", "critical", "warning", "normal", "normal"]
    counts = levels.level_change_counts(done).first()
    assert (counts["level_changes"], counts["warning_count"], counts["critical_count"], counts["emergency_count"]) == (4, 1, 1, 1)
    with pytest.raises(ValueError):
        levels.LevelRule(0.9, 0.5, 0.95)


@pytest.mark.parametrize("bits", [32, 64])
@pytest.mark.parametrize("chunk_ms", [chunks.CHUNK_MS, 40_000])
def test_counter_rate(spark, bits, chunk_ms):
    rng = random.Random(6)
    modulus, at, value, rows = 2**bits, 0, 2**bits - 5_000, []
    for seq in range(300):
        at += rng.choice([0, 1_000, 10_000, 60_000])
        jump = rng.random()
        near_end = modulus - 1 - rng.randrange(2_000)
        value = rng.choice([0, near_end]) if jump < 0.1 else (value + rng.randrange(3_000)) % modulus
        rows.append(sample(at, counter=value if jump < 0.97 else 5, valid=jump < 0.97, seq=seq))
    want, before = {}, None
    for r in sorted(rows, key=lambda r: (r[3], r[11])):
        if not r[8]:
            continue
        kind, delta, rate = "first", None, None
        if before:
            elapsed, change = r[3] - before[3], int(r[6]) - int(before[6])
            if elapsed == 0:
                kind = "same_time"
            elif change >= 0:
                kind, delta = "step", change
            elif (change + modulus) / (elapsed / 1000) <= 10_000:
                kind, delta = "wrap", change + modulus
            else:
                kind = "reset"
            rate = delta / (elapsed / 1000) if delta is not None else None
        want[r[11]] = (kind, delta, rate)
        before = r
    got = {r["seq"]: r for r in rates.counter_rate(samples(spark, rows), bits, 10_000, chunk_ms).collect()}
    assert set(got) == set(want)
    for seq, (kind, delta, rate) in want.items():
        r = got[seq]
        assert (r["kind"], None if r["delta"] is None else int(r["delta"])) == (kind, delta)
        assert r["rate"] == (None if rate is None else pytest.approx(rate, rel=1e-12))
    assert {k for k, _, _ in want.values()} >= {"first", "step", "wrap", "reset"}


def test_counters_above_signed_range(spark):
    top = 2**64
    df = samples(spark, [sample(0, counter=top - 10), sample(1_000, counter=top - 4), sample(2_000, counter=6)])
    got = [(r["kind"], r["delta"]) for r in rates.counter_rate(df).orderBy("seq").collect()]
    assert got == [("first", None), ("step", Decimal(6)), ("wrap", Decimal(10))]


@pytest.mark.parametrize("chunk_ms", [chunks.CHUNK_MS, 100_000, HOUR_MS])
def test_lateness(spark, chunk_ms):
    rng = random.Random(8)
    rows = [
        (*r, r[3] + rng.choice([0, 0, 0, 400_000, 3 * HOUR_MS])) for r in fleet(spark, 9, 300)
    ]
    schema = "namespace string, target string, poller string, timestamp_ms bigint, value_type string, value_gauge double, " \
        "value_counter decimal(20,0), value_text string, valid boolean, error string, poll_ms int, seq bigint, arrival_ms bigint"
    df = spark.createDataFrame(rows, schema)
    want = {}
    for key in {r[:3] for r in rows}:
        newest = None
        for r in sorted((r for r in rows if r[:3] == key), key=lambda r: (r[12], r[11])):
            bucket = r[3] // 300_000 * 300_000
            if newest is not None and bucket < newest:
                want[r[11]] = newest - bucket
            newest = bucket if newest is None else max(newest, bucket)
    got = {r["seq"]: r["late_by_ms"] for r in live.late_audit(df, chunk_ms=chunk_ms).collect()}
    assert got == want and len(want) > 20


def test_current_state_needs_no_order(spark):
    rows = fleet(spark, 11)
    found = health.health_current(samples(spark, rows))
    want = {polls[-1][:3]: expected_health(rows)[polls[-1][11]] for polls in by_series(rows).values()}
    names = ["health", "consecutive_failures", "last_error", "last_success_at", "last_failure_at"]
    assert {tuple(r[c] for c in ("namespace", "target", "poller")): tuple(r[n] for n in names) for r in found.collect()} == {
        k: w[1:] for k, w in want.items()
    }
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_job_runs_while_an_operator_is_built(spark):
    df = samples(spark, fleet(spark, 1, 20))
    ratio = df.withColumn("ratio", F.col("poll_ms") / 100)
    arrivals = df.withColumn("arrival_ms", F.col("timestamp_ms"))
    spark.sparkContext.setJobGroup("building", "operators")
    try:
        health.health_timeline(df)
        health.health_current(df)
        rates.counter_rate(df)
        live.late_audit(arrivals)
        levels.level_hysteresis(ratio, cooldown_ms=5_000)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_levels_over_very_many_chunks(spark):
    """One series of 30 000 chunks, each with one sample: more than FAN runs of chunks are walked."""
    n = 30_000
    df = spark.range(n).select(
        F.lit("n").alias("namespace"), F.lit("t").alias("target"), F.lit("p").alias("poller"),
        (F.col("id") * 1_000).alias("timestamp_ms"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("ratio"),
    )
    rows = [tuple(r) for r in df.collect()]
    assert level_rows(levels.level_hysteresis(df, chunk_ms=1_000)) == expected_levels(rows, RULES[0])


def test_no_window_without_a_chunk(spark):
    """Every window over samples is partitioned by series and chunk, none runs in a single partition."""
    df = samples(spark, fleet(spark, 1, 20))
    for out in (health.health_timeline(df, chunk_ms=HOUR_MS), rates.counter_rate(df, chunk_ms=HOUR_MS)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in plan
        sorts = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert any(chunks.CHUNK in line for line in sorts)
