"""Small literal tables."""

from decimal import Decimal

from tierlake.schemas import SAMPLES

KEY = ("prod", "router-01", "cpu")


def sample(ts, value=None, valid=True, key=KEY, counter=None, text=None, error=None, poll_ms=1, seq=None):
    kind = "counter" if counter is not None else "text" if text is not None else "gauge"
    return (
        *key,
        ts,
        kind,
        float(value) if value is not None else None,
        Decimal(counter) if counter is not None else None,
        text,
        valid,
        error,
        poll_ms,
        ts if seq is None else seq,
    )


def samples(spark, rows):
    return spark.createDataFrame(rows, SAMPLES)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
