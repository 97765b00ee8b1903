import datetime as dt

import pytest
from pyspark.sql import functions as F

from tierlake.functions.buckets import ntz_millis, select_tier, tier_bucket, tier_for_span, utc_date
from tierlake.schemas import DAY_MS, HOUR_MS, TIER_ORDER, TIERS


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("at", [ms(2031, 8, 20, 23, 59, 59) + 999, ms(1999, 12, 31), ms(2024, 2, 29, 12, 4, 59)])
def test_truncation(spark, at):
    day = at // DAY_MS * DAY_MS
    moment = dt.datetime.fromtimestamp(at / 1000, dt.timezone.utc)
    want = {
        "raw": at // 25_000 * 25_000,
        "5min": at // 300_000 * 300_000,
        "hourly": at // HOUR_MS * HOUR_MS,
        "daily": day,
        "weekly": day - moment.weekday() * DAY_MS,
    }
    df = spark.range(1).select(*[c.alias(t + s) for t in TIER_ORDER for c, s in zip(tier_bucket(F.lit(at), t), "se")])
    row = df.first()
    for tier, start in want.items():
        assert (row[tier + "s"], row[tier + "e"]) == (start, start + TIERS[tier].width_ms)


def test_weekly_is_monday_at_both_edges(spark):
    monday = ms(2029, 5, 14)
    df = spark.createDataFrame([(monday - 1,), (monday,), (monday + 7 * DAY_MS - 1,)], "t bigint")
    got = [r[0] for r in df.select(tier_bucket("t", "weekly")[0]).collect()]
    assert got == [monday - 7 * DAY_MS, monday, monday]


@pytest.mark.parametrize("place", range(len(TIER_ORDER) - 1))
def test_tier_choice(spark, place):
    """A tier answers spans up to its limit, the next one those a millisecond longer."""
    longest = TIERS[TIER_ORDER[place]].max_span_ms
    for span, tier in ((longest, TIER_ORDER[place]), (longest + 1, TIER_ORDER[place + 1])):
        assert tier_for_span(span) == tier
        assert spark.range(1).select(select_tier(F.lit(7).cast("bigint"), F.lit(7 + span))).first()[0] == tier


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.179575' as ts")
            row = df.select(ntz_millis("ts").alias("ms")).select("ms", F.unix_date(utc_date("ms")).alias("d")).first()
            assert row["ms"] == ms(2024, 3, 10, 2, 30) + 179
            assert row["d"] == row["ms"] // DAY_MS
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
