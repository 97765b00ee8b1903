"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.session import materialise

#: Places that one partition can number, see `monotonically_increasing_id`.
PARTITION = 1 << 33


@dataclass(frozen=True)
class Ring:
    """Points of the virtual nodes in ascending order, and the shard of each."""

    points: np.ndarray
    shards: np.ndarray

    @classmethod
    def of(cls, shards: int, virtual: int = 64) -> Ring:
        """The points of a shard depend on its number alone, so that a further shard moves none of the others'."""
        placed = sorted(
            (int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
            for s in range(shards)
            for v in range(virtual)
        )
        return cls(np.array([p for p, _ in placed], dtype=np.int64), np.array([s for _, s in placed], dtype=np.int64))

    def arc(self, key: Column) -> Column:
        """The number of the first virtual node at or clockwise of a 64-bit key."""
        points = self.points

        @F.pandas_udf("int")
        def found(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(points, keys.to_numpy(dtype=np.int64)) % len(points), dtype="int32")

        return found(key)


def fill(ring: Ring, capacity: list[int], loads: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of rows with their shard: `(partition, arc, from, until, shard, first slot)`.

    `loads` has `(partition, arc, first place, rows)` in ring order. Every arc first fills its own shard, in ring
    order; what is left over then goes on clockwise to the next virtual nodes whose shard has room.
    """
    room, slots, runs, over = list(capacity), [0] * len(capacity), [], []

    def place(partition: int, arc: int, at: int, n: int, shard: int) -> int:
        took = min(n, room[shard])
        if took:
            runs.append((partition, arc, at, at + took, shard, slots[shard]))
            room[shard] -= took
            slots[shard] += took
        return took

    for partition, arc, at, n in loads:
        took = place(partition, arc, at, n, int(ring.shards[arc]))
        if took < n:
            over.append((partition, arc, at + took, n - took))
    for partition, arc, at, n in over:
        node = arc
        while n:
            node = (node + 1) % len(ring.shards)
            took = place(partition, arc, at, n, int(ring.shards[node]))
            at, n = at + took, n - took
    return runs


def shard(docs: DataFrame, shards: int = 24, virtual: int = 64, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` for every row of `docs`.

    The key is the hash of the text, so equal texts lie together on the ring and stay together while their shard has
    room. A shard takes at most its even share of the rows (the first shards one more), or `1 + slack` times that;
    rows beyond it continue clockwise. Without slack the law is `rows`: counts differ by one at most. `grown_shard`
    is null, since it belongs to another law. Slots count from 0 in each shard, in ring order.

    Rows are sorted by ring position once, a large group of equal texts over many partitions. The driver sees one count
    for each partition and arc (at most partitions plus virtual nodes), walks the ring over them, and sends as many
    runs back. Null texts have size 8 and lie with empty ones; rows that repeat, also in their id, or have no id are
    rows like others. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ring = Ring.of(shards, virtual)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    around = rows.withColumn("arc", ring.arc(F.col("key")))
    # The last arc's keys beyond its point belong to the first virtual node; all its rows are counted there.
    placed = around.orderBy("key", "doc_id", "row").drop("key", "row").withColumn("place", F.monotonically_increasing_id())
    placed = materialise(spark, placed, "ring")
    partition = F.floor(F.col("place") / PARTITION).cast("int")
    # Keys past the last point wrap around to arc 0 and may share a partition with arc 0 proper: two runs, told apart.
    wrapped = placed.withColumn("partition", partition)
    counted = wrapped.groupBy("partition", "arc").agg(F.min("place"), F.max("place"), F.count("*")).collect()
    loads, total = [], 0
    for p, arc, first, last, n in sorted(counted, key=lambda c: c[2]):
        total += n
        if last - first + 1 == n:
            loads.append((p, arc, first, n))
        else:  # only arc 0 can lie at both ends of one partition
            ends = _ends(wrapped, p, arc, first)
            loads += [(p, arc, first, ends), (p, arc, last - (n - ends) + 1, n - ends)]
    loads.sort(key=lambda c: c[2])
    even, more = divmod(total, shards)
    capacity = [max(even + (s < more), int((1 + slack) * total / shards)) for s in range(shards)]
    runs = spark.createDataFrame(
        fill(ring, capacity, loads), "partition int, arc int, first long, until long, shard int, slot long"
    )
    # At most partitions + virtual nodes + shards runs.
    joined = wrapped.join(F.broadcast(runs), ["partition", "arc"]).where("place >= first and place < until")
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot") + F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _ends(wrapped: DataFrame, partition: int, arc: int, first: int) -> int:
    """How many rows of an arc lie at the start of a partition whose end has rows of it as well."""
    other = wrapped.where(f"partition = {partition} and arc <> {arc} and place > {first}")
    return other.agg(F.min("place")).first()[0] - first
