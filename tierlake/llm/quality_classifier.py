"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words remembered per Python worker; the memory is emptied when a document begins with more.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Settings:
    """Table of 2**bits (at most 2**16) vectors of `dim` numbers, character n-gram sizes, and how the training goes.

    `train_rows` bounds the sample that the driver trains on: the labelled rows with the smallest hash of their id.
    """

    bits: int = 16
    dim: int = 16
    char_sizes: tuple[int, ...] = (3, 4)
    train_rows: int = 1500
    epochs: int = 6
    rate: float = 1.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """What scoring needs: with two classes each vector matters only by its product with the difference of outputs."""

    settings: Settings
    weights: np.ndarray
    bias: float


def _features(word: bytes, settings: Settings) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    mask = (1 << settings.bits) - 1
    marked = b"<" + word + b">"
    found = [xxhash.xxh3_64_intdigest(marked) & mask]
    for size in settings.char_sizes:
        found += [xxhash.xxh3_64_intdigest(marked[k : k + size], 1) & mask for k in range(len(marked) - size + 1)]
    return found


def _pairs(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """Buckets of neighbouring words; a word after itself has one bucket, whatever the word."""
    left, right = hashes[:-1], hashes[1:]
    mixed = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(left == right, np.uint64(1), mixed >> np.uint64(64 - settings.bits)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, 2) for w in words), dtype=np.uint64, count=len(words))


def _bag(text: bytes | None, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and how often each comes.

    Both are in 16 bits to keep the sample small, counts in 32 or 64 where a text has one that needs them.
    """
    words = text.split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint16), np.empty(0, dtype=np.uint16)
    total = _pairs(_hashes(words), settings)
    times = [np.ones(len(total), dtype=np.int64)]
    buckets = [total]
    for word, count in Counter(words).items():
        own = _features(word, settings)
        buckets.append(np.array(own, dtype=np.int64))
        times.append(np.full(len(own), count, dtype=np.int64))
    summed = np.bincount(np.concatenate(buckets), weights=np.concatenate(times), minlength=1 << settings.bits)
    used = np.flatnonzero(summed)
    counts = summed[used].astype(np.int64)
    return used.astype(np.uint16), counts.astype(max(np.dtype(np.uint16), np.min_scalar_type(counts.max())))


def _unpacked(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A bag from its bytes; the width of the counts follows from their number."""
    used = np.frombuffer(buckets, dtype=np.uint16)
    return used, np.frombuffer(counts, dtype=f"u{len(counts) // max(1, len(used)) or 2}")


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> Model:
    """Stochastic gradient descent, a document at a time, with a rate that falls to zero.

    Without labels of both kinds there is nothing to learn: the score is then the smoothed share of label 1.
    """
    good = int(labels.sum())
    prior = np.log((good + 1) / (len(labels) - good + 1))
    if good in (0, len(labels)):
        return Model(settings, np.zeros(1 << settings.bits), float(prior))
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (1 << settings.bits, settings.dim)) / settings.dim
    output = np.zeros((settings.dim, 2))
    bias = np.array([0.0, prior])
    steps, done = settings.epochs * len(labels), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(labels)):
            rate = settings.rate * (1 - done / steps)
            done += 1
            buckets, counts = bags[k]
            share = counts / max(1, counts.sum(dtype=np.int64))
            mean = share @ vectors[buckets]
            scores = mean @ output + bias
            chance = np.exp(scores - scores.max())
            chance /= chance.sum()
            chance[int(labels[k])] -= 1
            back = output @ chance
            output -= rate * np.outer(mean, chance)
            bias -= 0.01 * rate * chance
            vectors[buckets] -= rate * share[:, None] * back * len(share) ** 0.5
    return Model(settings, vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "label"
) -> Model:
    """Learn from at most `train_rows` rows of `labels` (`doc_id, label`; label 0 or 1, others don't count).

    The sample's documents become bags of buckets in Spark; the bags come to the driver, which trains on them.
    """
    sample = (
        labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id is not null and _label in (0, 1)")
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(settings.train_rows)
    )

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_bag(t, settings) for t in batch["_text"]]
            yield pd.DataFrame(
                {"id": batch["_id"], "label": batch["_label"], "buckets": [m[0].tobytes() for m in made], "counts": [m[1].tobytes() for m in made]}
            )

    # The sample has at most train_rows rows of two numbers.
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    rows = (
        texts.join(F.broadcast(sample), "_id")
        .mapInPandas(bags, "id long, label int, buckets binary, counts binary")
        .orderBy("id", "label", F.xxhash64("buckets"))
        .limit(settings.train_rows)
        .toArrow()
    )
    found = [_unpacked(b.as_py(), c.as_py()) for b, c in zip(rows["buckets"], rows["counts"])]
    return fit(found, rows["label"].to_numpy().astype(np.int64), settings)


class _Words(dict):
    """Word to row of three growing columns: summed weight of its buckets, their number, and its hash."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.weights = model, model.weights.tolist()
        self.sums, self.sizes, self.hashes = np.zeros(1024), np.zeros(1024), np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.sums):
            self.sums, self.sizes, self.hashes = (np.concatenate([c, np.zeros_like(c)]) for c in (self.sums, self.sizes, self.hashes))
        buckets = _features(word, self.model.settings)
        self.sums[row] = sum(map(self.weights.__getitem__, buckets))
        self.sizes[row] = len(buckets)
        self.hashes[row] = xxhash.xxh3_64_intdigest(word, 2)
        self[word] = row
        return row

    def score(self, text: bytes | None) -> float:
        """Chance of label 1; the bias alone for a text without words."""
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split() if text else []
        if not words:
            return float(1 / (1 + np.exp(-self.model.bias)))
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        pairs = _pairs(self.hashes[rows], self.model.settings)
        total = self.sums[rows].sum() + self.model.weights[pairs].sum()
        mean = total / (self.sizes[rows].sum() + len(pairs))
        return float(1 / (1 + np.exp(-np.clip(mean + self.model.bias, -500, 500))))


def score(model: Model, text: Column) -> Column:
    """The score of a text column, from 0 to 1: the larger, the likelier label 1. Null texts score as empty ones."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words(model)
        for texts in batches:
            yield pd.Series([words.score(t) for t in texts], dtype="float64")

    return scored(text.cast("binary"))


def in_fold(doc_id: Column, fold: int, folds: int) -> Column:
    """Whether the checksum of an id leaves this remainder; ids that are null lie in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_documents(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "label"
) -> DataFrame:
    """`docs` with `held_out` and `score`, learned from the labels whose id is not held out (a fifth is).

    The texts alone are scored, whole and as they are. Null and empty texts get the score of no evidence. Repeated rows
    get equal scores; a document with both labels counts with both. With no usable label every score is 0.5. Columns
    of `docs` named `held_out` or `score` are replaced; others stay and are not looked at. An empty table stays empty.
    """
    model = train(docs, labels.where(~in_fold(F.col(doc_id), 0, 5)), settings, doc_id, text, label)
    return docs.withColumn("held_out", in_fold(F.col(doc_id), 0, 5)).withColumn("score", score(model, F.col(text)))
