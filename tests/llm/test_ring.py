import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlake.llm import ring
from tierlake.llm.ring import Ring


def check(df, shards):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = ring.shard(df, shards).collect()
    size = lambda t: 8 + len((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, size(t), zlib.crc32((t or "").encode())) for d, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_whole_table(documents, shards):
    check(documents, shards)


def test_odd_rows(odd):
    check(odd, 4)


def test_empty(empty):
    assert ring.shard(empty).count() == 0


def test_hot_text_overflows(spark):
    """A text with half of all rows fills what the others leave; those whose shard has room stay in it."""
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")
    )
    check(df, 10)
    others = ring.shard(df, 10).join(df.where("text <> 'hot'"), "doc_id")
    own = others.withColumn("own", F.element_at(F.lit(Ring.of(10).shards.tolist()), Ring.of(10).arc(F.xxhash64("text")) + 1))
    assert own.where("shard = own").count() > 0.8 * 2000


def test_few_keys_move_when_a_shard_joins(documents):
    """With slack, growing from 10 to 11 shards moves a small part of the rows."""
    few, more = (ring.shard(documents, n, slack=0.5).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (10, 11))
    both = few.join(more, "doc_id")
    assert both.where("s10 <> s11").count() < 0.4 * both.count()


def test_virtual_nodes_stay():
    a, b = Ring.of(6), Ring.of(7)
    assert set(zip(a.points.tolist(), a.shards.tolist())) == {p for p in zip(b.points.tolist(), b.shards.tolist()) if p[1] < 6}


def test_fill_goes_clockwise():
    three = Ring(points=np.array([0, 10, 20]), shards=np.array([0, 1, 2]))
    runs = ring.fill(three, [2, 2, 2], [(0, 0, 0, 1), (0, 1, 1, 4), (0, 2, 5, 1)])
    assert runs == [(0, 0, 0, 1, 0, 0), (0, 1, 1, 3, 1, 0), (0, 2, 5, 6, 2, 0), (0, 1, 3, 4, 2, 1), (0, 1, 4, 5, 0, 1)]
