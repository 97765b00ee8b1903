"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm.graph import components
from tierlake.llm.words import HASHES, mixed, windows
from tierlake.session import materialise

#: Positions that the two permutations reorder.
UNIVERSE = 1 << 20
#: Counters of shingle frequencies; more of them make the prefix filter sharper, none make it wrong.
SLOTS = 1 << 20
#: Shingles signed at a time, which bounds the memory of a very long text.
BLOCK = 2048


@dataclass(frozen=True)
class Settings:
    """Shingle width in words, the least similarity in per cent, and the bands.

    With 32 bands of 5 rows a pair of similarity 0.8 shares no band once in 300 000 times.
    """

    width: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 5


@functools.cache
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all windows of the second one: row p holds it at p, p + 1, ..., one shift each."""
    rng = np.random.default_rng(20)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    ring = np.concatenate([second, second[: coordinates - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second permutation, shifted by k, over first permutation's places."""
    first, shifted = _permutations(coordinates)
    places = first[(shingles % np.uint64(UNIVERSE)).astype(np.int64)]
    least = np.full(coordinates, UNIVERSE, dtype=np.int32)
    for at in range(0, len(places), BLOCK):
        np.minimum(least, shifted[places[at : at + BLOCK]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit bucket for each band; the band's number is part of it."""
    parts = least.astype(np.uint64).reshape(settings.bands, settings.rows)
    total = np.arange(1, settings.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(settings.rows):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, k] + np.uint64(1))
    return total.astype(np.int64)


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The distinct shingles of a word sequence, sorted; a shorter sequence is one shingle of its own."""
    if len(words) < width:
        return HASHES.of([b"\x00" + b" ".join(words)]) if words else np.empty(0, dtype=np.uint64)
    return np.unique(windows(HASHES.of(words), width))


def content_key(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def content(text: Column) -> Column:
    """The key that `near_duplicates` has for a text's word sequence; null without words."""

    @F.pandas_udf("binary")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([content_key(_words(t)) for t in texts], dtype=object)

    return keys(text.cast("binary"))


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _fingerprints(settings: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, bands, ends = [], [], [np.empty(0, dtype=np.int64)], [0]
        for text in batch.column(1):
            words = _words(text.as_py())
            shingles = shingle_set(words, settings.width)
            counts.append(len(shingles))
            keys.append(content_key(words))
            # A sequence below the width is alike only to itself, which its key already tells.
            if len(words) >= settings.width:
                bands.append(band_keys(signature(shingles, settings.bands * settings.rows), settings))
            ends.append(ends[-1] + (settings.bands if len(words) >= settings.width else 0))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands))),
            ],
            names=["doc_id", "n_shingles", "content", "bands"],
        )


def fingerprints(docs: DataFrame, settings: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_shingles, content, bands` for every row: set size, 128-bit key of the word sequence, LSH buckets."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(
        functools.partial(_fingerprints, settings),
        "doc_id long, n_shingles long, content binary, bands array<long>",
    )


def _sets(settings: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sets = [], []
        for node, content, text in zip(*(batch.column(k) for k in range(3))):
            words = _words(text.as_py())
            if content_key(words) == content.as_py():
                nodes.append(node.as_py())
                sets.append(shingle_set(words, settings.width).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _confirm(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (left, right))
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def shingle_sets(
    docs: DataFrame, nodes: DataFrame, wanted: DataFrame, settings: Settings, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`node, shingles` for the wanted nodes, from a document of each class; written, since every later step reads it."""
    named = nodes.select("node", "content", F.col("rep").alias("_id")).join(wanted, "node", "left_semi")
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    sets = (
        texts.join(named, texts["_id"].eqNullSafe(named["_id"]))
        .select("node", "content", "_text")
        .mapInArrow(functools.partial(_sets, settings), "node long, shingles binary")
        .dropDuplicates(["node"])
    )
    return materialise(docs.sparkSession, sets, "shingles")


def confirmed(sets: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs `a, b` of nodes whose full shingle sets are similar enough."""
    both = pairs.join(sets.toDF("b", "right"), "b").join(sets.toDF("a", "left"), "a").select("a", "b", "left", "right")
    return both.mapInArrow(functools.partial(_confirm, settings.percent), "a long, b long")


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for blob in batch.column(0):
            np.add.at(total, (np.frombuffer(blob.as_py(), dtype=np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "total"])


def _prefixes(percent: int, counts: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of a set: so many that two similar sets cannot both do without a common one among theirs."""
    for batch in batches:
        at, places, shingles = [], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
        for k, blob in enumerate(batch.column(0)):
            values = np.frombuffer(blob.as_py(), dtype=np.uint64)
            common = counts.value[(values % np.uint64(SLOTS)).astype(np.int64)]
            length = len(values) - (-(-percent * len(values) // 100)) + 1
            first = np.lexsort((values, common))[:length]
            shared = np.flatnonzero(common[first] > 1)
            places.append(shared)
            first = first[shared]
            shingles.append(values[first])
            at.append(np.full(len(first), k))
        rows = batch.select([1, 2, 3]).take(pa.array(np.concatenate(at) if at else [], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(np.concatenate(places)), pa.array(np.concatenate(shingles).astype(np.int64))],
            names=["node", "n", "component", "place", "shingle"],
        )


def pairs_across(spark: SparkSession, sets: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs `a, b` of nodes in different components that may be similar; no similar pair of `nodes` is left out.

    `nodes` has `node, n, component`. A prefix filter: in any fixed order of all shingles, two similar sets share one
    within their first few. Rare shingles come first, so that texts with many edits of their own meet nobody. The
    frequencies that make the order are counted over all sets into a table of `SLOTS` numbers. Nodes of a shingle's
    largest component only wait for the others, so that a large component is never paired with itself. Of the shingles
    that two nodes share, the first one must leave enough of both sets behind it.
    """
    held = materialise(spark, sets.join(nodes, "node").select("shingles", "node", "n", "component"), "held")
    counted = held.select("shingles").mapInArrow(_slot_counts, "slot long, total long").groupBy("slot").agg(F.sum("total"))
    counts = np.zeros(SLOTS, dtype=np.int64)
    rows = counted.toDF("slot", "total").toArrow()  # SLOTS rows at most
    counts[rows["slot"].to_numpy()] = rows["total"].to_numpy()
    firsts = held.mapInArrow(
        functools.partial(_prefixes, settings.percent, spark.sparkContext.broadcast(counts)),
        "node long, n long, component long, place long, shingle long",
    )
    firsts = materialise(spark, firsts, "prefixes")
    sizes = firsts.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("shingle").agg(F.count("*").alias("components"), F.max(F.struct("size", "component")).alias("top"))
    largest = largest.where("components > 1").select("shingle", F.col("top.component").alias("top"))
    meeting = firsts.join(largest, "shingle")
    left, right = (
        meeting.select("shingle", "top", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "component", "place")))
        for side in "ab"
    )
    # What two sets have in common from their first common shingle on, at most, against what they need.
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    enough = rest * (100 + settings.percent) >= (F.col("n_a") + F.col("n_b")) * settings.percent
    met = (
        left.where("component_a <> top")
        .join(right.drop("top"), "shingle")
        .where("component_b = top OR component_a < component_b")
        .where(_may_link("n_a", "n_b", settings.percent) & enough)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _may_link(n: str, m: str, percent: int):
    """Sets of these sizes can be similar enough."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def near_duplicates(
    docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for every row of `docs`, and `content`, the key of its word sequence.

    Equal word sequences form one class, and the classes are the nodes. Classes that share a bucket are linked in three
    steps: every class is held against the hub of each of its buckets (the member with most neighbours); the links
    give components; then the members of buckets with several components are joined across components by a prefix
    filter, so that no link between components is lost while large groups never become all pairs. Links are confirmed
    on full sets.

    Null and empty texts have no shingles and link with nothing: their `component_id` is their own `doc_id`. Rows that
    repeat a `doc_id` each get a row. Rows without a `doc_id` take part; `component_id` is null where a component has
    no id, and then its rows are kept. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    rows = materialise(spark, fingerprints(docs, settings, doc_id, text), "fingerprints")
    nodes = (
        rows.where("content is not null")
        .groupBy("content")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = materialise(spark, nodes, "classes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(spark, buckets.join(sizes, "bucket"), "shared")

    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = (
        shared.join(weights, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
        .select("bucket", F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
    )
    star = shared.join(hubs, "bucket").where("node <> a").where(_may_link("n", "n_a", settings.percent))
    star = materialise(spark, star.select("a", F.col("node").alias("b")).distinct(), "star")
    wanted = shared.select("node").distinct()
    sets = shingle_sets(docs, nodes, wanted, settings, doc_id, text)
    links = materialise(spark, confirmed(sets, star, settings), "links")

    first = components(spark, links)
    placed = shared.join(first, "node", "left").select(
        "bucket", "node", "n", F.coalesce("component", "node").alias("component")
    )
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart = placed.join(split, "bucket", "left_semi").select("node", "n", "component").distinct()
    tried = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    across = pairs_across(spark, sets, apart, settings).join(tried, ["a", "b"], "left_anti")
    more = confirmed(sets, materialise(spark, across, "across"), settings)
    final = components(spark, links.union(more))

    members = nodes.join(final, "node", "left").select("content", "rep", F.coalesce("component", "node").alias("component"))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = members.join(least, "component").select(F.col("content").alias("_content"), "component_id")
    out = rows.join(named, rows["content"] == named["_content"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "content",
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
