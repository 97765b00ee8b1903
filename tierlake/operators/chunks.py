"""Ordered work on series of any size.

A window over a whole series would put a series that holds a third of all
rows into one task.  The ordered operators cut each series into time chunks
of a fixed width instead, work inside the chunks, and carry the little that
passes from one chunk to the next: one row per series and chunk, combined by
a window over those rows only.  The width is an argument of the operators;
the rows do not depend on it.  A day suits series with up to some millions
of samples a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from tierlake.functions.buckets import floor_to
from tierlake.schemas import DAY_MS

CHUNK_MS = DAY_MS
CHUNK = "_chunk"


def with_chunk(df: DataFrame, ts: str, chunk_ms: int) -> DataFrame:
    """Add the chunk of each row: the start of its time slice."""
    return df.withColumn(CHUNK, floor_to(ts, chunk_ms))


def inside(keys: list[str], *order: Column | str) -> Window:
    """Window over one chunk of one series."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def running(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def earlier_chunks(keys: list[str]) -> Window:
    """Window over the summaries of the chunks before this one."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the carried state of each chunk; both sides are keyed by series and chunk."""
    return rows.join(carry, [*keys, CHUNK], "left")
