"""Toxicity by class-conditional Kneser-Ney models with a shared backoff.

Each class, toxic and ordinary, has a model of its words in two orders. The higher one conditions on the word before: from
the count of each pair of words an absolute discount is taken, and what that frees behind a word goes to the lower order.
There a word counts as often as it follows different words, so a phrase that is copied many times counts once. These
counts are discounted too, and what that frees goes to one backoff that both classes share: in how many texts of the whole
corpus, labelled or not, a word stands. A word that a class has seen in few contexts therefore has nearly the same
likelihood in both classes, and only words that one class really prefers tell them apart.

A document is compared by length-normalised log-likelihood ratios: of its most toxic passages of 1, 2, 4 and 16 words, and
of the whole text, under the whole model and under its lower order alone, since behind a word that one class has seen
far more often the freed shares differ too. A logistic curve over these ten numbers, fitted on labelled rows that the
models did not count, makes them a score from 0 to 1.

Words and pairs are hashed into a fixed number of cells. Counts come from all documents and all labelled rows for training; the
tables that leave the cluster have one number for each cell, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.llm.words import HASHES, windows

#: Lower-case letters stay, and so do all bytes of other alphabets; anything else parts words.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text that a task looks at together.
_HELD = 1 << 20
_BITS = 20
CELLS = 1 << _BITS
#: Cells that travel as one row.
_CHUNK = 1 << 12
#: Bits of the screen that keeps unlabelled texts out of the join with the labels.
_SCREEN = 1 << 24


@dataclass(frozen=True)
class Settings:
    """Discounts of the classes' lower order and of their pairs, lengths of passages, and what the curve is fitted on.

    One in `calibration` of the rows for training is left out of the counts and used for the curve, at most
    `calibration_rows` of them, those with the smallest hashes of their id.
    """

    discount: float = 3.0
    pair_discount: float = 3.0
    passages: tuple[int, ...] = (1, 2, 4, 16)
    calibration: int = 4
    calibration_rows: int = 20_000
    ridge: float = 0.1


@dataclass(frozen=True)
class Counts:
    """Counts of a class by cell: contexts of a word; behind a word the pairs and what the discount takes of them; what it
    leaves of a pair."""

    contexts: np.ndarray
    behind: np.ndarray
    freed: np.ndarray
    kept: np.ndarray


@dataclass(frozen=True)
class Likelihood:
    """A class's model by cell: likelihood of a word in the lower order; share of one pair, and of the lower order, behind
    a word; discounted count of a pair."""

    lower: np.ndarray
    single: np.ndarray
    backoff: np.ndarray
    kept: np.ndarray

    def of(self, first: np.ndarray, second: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Likelihood of words behind others; where the class has not seen the word before, that of the lower order."""
        return self.kept[pair] * self.single[first] + self.backoff[first] * self.lower[second]


@dataclass(frozen=True)
class Model:
    """Likelihoods of ordinary and toxic words, and the curve: a weight for each passage length and the text, first of the
    lower order and then of the whole model, and a constant. Without likelihoods all words are neutral."""

    classes: tuple[Likelihood, ...]
    weights: np.ndarray
    settings: Settings


def in_fold(doc_id: Column, fold: int, folds: int) -> Column:
    """Whether the unsigned crc32 of the decimal id leaves this remainder; an id that is null is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, each text behind a 0, and where the texts begin."""
    parts, starts, at = [], [], 0
    for text in texts:
        tokens = (text or b"").lower().translate(_LETTERS).split()
        starts.append(at)
        part = np.zeros(len(tokens) + 1, dtype=np.uint64)
        part[1:] = HASHES.of(tokens)
        parts.append(part)
        at += len(part)
    return np.concatenate(parts), np.array(starts, dtype=np.int64)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has a bounded number of bytes, or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            begun = sizes[first - 1] if first else 0
            until = max(first + 1, int(np.searchsorted(sizes, begun + _HELD, side="right")))
            yield batch.slice(first, until - first)
            first = until


def shared_counts(texts: DataFrame) -> np.ndarray:
    """In how many texts the words of each cell stand, over all rows of `text` (bytes): 8 MB."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, dtype=np.int64)
        for batch in _held(batches):
            hashes, starts = _words(batch.column("text").to_pylist())
            document = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
            real = hashes != 0
            once = np.unique(document[real] << _BITS | _cell(hashes[real]))
            seen += np.bincount(once & (CELLS - 1), minlength=CELLS)
        for chunk in range(CELLS // _CHUNK):
            part = seen[chunk * _CHUNK : (chunk + 1) * _CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                narrow = part[at].astype(np.uint32) if part.max() < 1 << 32 else part[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int32()),
                        pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([narrow.tobytes()], pa.binary()),
                    ],
                    ["chunk", "cells", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "cells", "counts"))):
                at = np.frombuffer(at, dtype=np.uint16)
                kind = np.uint32 if len(counts) == 4 * len(at) else np.int64
                sums.setdefault(chunk, np.zeros(_CHUNK, dtype=np.int64))[at] += np.frombuffer(counts, dtype=kind)
        rows = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, ["chunk", "counts"])

    counted = texts.select("text").mapInArrow(count, "chunk int, cells binary, counts binary").repartition("chunk")
    total = np.zeros(CELLS, dtype=np.int64)
    for row in counted.mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        total[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, dtype=np.int64)
    return total


def labelled(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, text, label` of the texts that have a label.

    The ids with a label set bits in 2 MB; texts whose id meets no bit stay where they are, the others are joined. Of
    several labels for an id the largest counts.
    """
    spark = texts.sparkSession
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(_SCREEN))
    bits = one.select((bit + 1).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
    screen = np.zeros(_SCREEN // 8, dtype=np.uint8)
    for row in bits.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).toLocalIterator():
        part = np.frombuffer(row.bits, dtype=np.uint8)
        screen[(row.bucket - 1) * len(part) : row.bucket * len(part)] = part
    shared = spark.sparkContext.broadcast(screen)

    @F.pandas_udf("boolean")
    def may_have(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    # Labels grow with the corpus: never a broadcast, so that the plan is the same at every size.
    return texts.where("doc_id is not null").where(may_have(bit)).join(one.hint("merge"), "doc_id")


def _pair_cell(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def class_tables(rows: DataFrame, discount: float) -> tuple[Counts, Counts]:
    """What both orders count in ordinary and in toxic rows (`text, label`)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            labels = np.array(batch.column("label").to_pylist(), dtype=np.int64)
            texts = batch.column("text").to_pylist()
            for label in np.unique(labels):
                hashes, _ = _words([t for t, x in zip(texts, labels) if x == label])
                at = np.flatnonzero(hashes[1:] != 0)
                # A pair's number: the cells of its second and of its first word, and 24 bits of its hash.
                second, first = _cell(hashes[1:][at]), _cell(hashes[:-1][at])
                number = second << 44 | first << 24 | (windows(hashes, 2)[at] >> np.uint64(40)).astype(np.int64)
                keys, times = np.unique(number, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(int(label), pa.int32()), len(keys)), pa.array(keys, pa.int64()), pa.array(times, pa.int64())],
                    ["label", "pair", "n"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            table, cell, n, freed = (batch.column(c).to_numpy() for c in ("table", "cell", "n", "freed"))
            for which in np.unique(place := table.astype(np.int64) << _BITS | cell & -_CHUNK):
                here = place == which
                key = int(which) >> _BITS, int(which & (CELLS - 1)) // _CHUNK
                both = sums.setdefault(key, np.zeros((2, _CHUNK)))
                both[0, cell[here] % _CHUNK], both[1, cell[here] % _CHUNK] = n[here], freed[here]
        for (table, chunk), both in sums.items():
            parts = [pa.array([x], t) for x, t in ((table, pa.int32()), (chunk, pa.int32()))]
            parts += [pa.array([half.tobytes() if half.any() else b""], pa.binary()) for half in both]
            yield pa.RecordBatch.from_arrays(parts, ["table", "chunk", "n", "freed"])

    def entry(kind: int, cell: Column, n: Column, freed: Column) -> Column:
        return F.struct(
            (F.col("label") * 3 + kind).cast("int").alias("table"), cell.cast("int").alias("cell"), n.alias("n"), freed.alias("freed")
        )

    pair, n, none = F.col("pair"), F.col("n").cast("double"), F.lit(0.0)
    second, first = F.shiftrightunsigned("pair", 64 - _BITS), F.shiftrightunsigned("pair", 64 - 2 * _BITS).bitwiseAND(CELLS - 1)
    taken = F.least(n, F.lit(discount))
    entries = F.array(
        entry(0, second, F.lit(1.0), none), entry(1, first, n, taken), entry(2, pair.bitwiseAND(CELLS - 1), n - taken, none)
    )
    counted = (
        rows.select("text", F.col("label").cast("int").alias("label"))
        .where("label in (0, 1)")
        .mapInArrow(pairs, "label int, pair bigint, n bigint")
        .groupBy("label", "pair")
        .agg(F.sum("n").alias("n"))
        .select(F.inline(entries))
        .where("n > 0")
        .groupBy("table", "cell")
        .agg(F.sum("n").alias("n"), F.sum("freed").alias("freed"))
    )
    out = np.zeros((2, 3, 2, CELLS))
    chunked = counted.repartition("table", F.shiftright("cell", _CHUNK.bit_length() - 1))
    for row in chunked.mapInArrow(add, "table int, chunk int, n binary, freed binary").toLocalIterator():
        for half, values in enumerate((row.n, row.freed)):
            if values:
                out[row.table // 3, row.table % 3, half, row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(values)
    ordinary, toxic = (Counts(t[0, 0].astype(np.int64), t[1, 0], t[1, 1], t[2, 0]) for t in out)
    return ordinary, toxic


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many different words the words of each cell follow, in ordinary and in toxic rows (`text, label`)."""
    ordinary, toxic = class_tables(rows, Settings().pair_discount)
    return ordinary.contexts, toxic.contexts


def likelihood(counts: Counts, shared: np.ndarray, discount: float) -> Likelihood:
    """Both orders of a class from its counts; the pairs are discounted already."""
    seen = counts.behind > 0
    total = np.where(seen, counts.behind, 1)
    lower = np.exp(log_likelihood(counts.contexts, shared, discount))
    parts = lower, seen / total, np.where(seen, counts.freed / total, 1), counts.kept
    return Likelihood(*(p.astype(np.float32) for p in parts))


def log_likelihood(counts: np.ndarray, shared: np.ndarray, discount: float) -> np.ndarray:
    """Log-likelihood of each cell in a class: discounted counts, and the freed share dealt out by the shared counts.

    A class without counts has the shared likelihoods. Half a text more than counted makes cells that stand in no text
    possible.
    """
    backoff = (shared + 0.5) / (shared.sum() + 0.5 * len(shared))
    total = counts.sum()
    if total == 0:
        return np.log(backoff)
    kept, freed = np.maximum(counts - discount, 0), np.minimum(counts, discount).sum()
    return np.log(kept / total + freed / total * backoff)


def passage_ratios(ratios: np.ndarray, lengths: tuple[int, ...]) -> list[float]:
    """The largest mean ratio of a passage of each length (of the whole text, if it is shorter), and the text's mean."""
    if not len(ratios):
        return [0.0] * (len(lengths) + 1)
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    spans = [min(length, len(ratios)) for length in lengths]
    return [float((sums[s:] - sums[:-s]).max() / s) for s in spans] + [float(sums[-1] / len(ratios))]


def word_ratios(classes: tuple[Likelihood, ...], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio, toxic to ordinary, of each word of some texts as `_words` gives them, under the lower order
    and under the whole model. The zeros between texts have ratios that mean nothing."""
    if not classes:
        return np.zeros(len(hashes)), np.zeros(len(hashes))
    before = np.concatenate([hashes[:1], hashes[:-1]])
    first, second = _cell(before), _cell(hashes)
    pair = np.concatenate([np.zeros(1, dtype=np.int64), _pair_cell(windows(hashes, 2))])
    ordinary, toxic = classes
    lower = np.log(toxic.lower[second]) - np.log(ordinary.lower[second])
    return lower, np.log(toxic.of(first, second, pair)) - np.log(ordinary.of(first, second, pair))


def measured(rows: DataFrame, classes: tuple[Likelihood, ...], settings: Settings) -> DataFrame:
    """`rows` with `x`, the length-normalised log-likelihood ratios of `text` (bytes), in its place; zeros without words."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)
    lengths = settings.passages
    others = [c for c in rows.columns if c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            hashes, starts = _words(batch.column("text").to_pylist())
            orders = word_ratios(shared.value, hashes)
            ends = np.append(starts[1:], len(hashes))
            x = [
                [number for known in orders for number in passage_ratios(known[begin:end], lengths)]
                for begin, end in zip(starts + 1, ends)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(x, pa.list_(pa.float64()))], [*others, "x"]
            )

    types = dict(rows.dtypes)
    return rows.mapInArrow(measure, ", ".join([*(f"{c} {types[c]}" for c in others), "x array<double>"]))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic curve with a constant at the end, by Newton's method on standardised columns.

    Without rows the curve is zero everywhere (a score of 0.5 at every text); with rows of one class it stays finite.
    """
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
    slope = w[:-1] / spread
    return np.append(slope, w[-1] - slope @ mean)


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """The models and curve from `labels` (`doc_id, label` 0 or 1) and the texts of all documents."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    shared = shared_counts(texts)
    held = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(settings.calibration)) == 0
    both = class_tables(labelled(texts.where(~held), labels.where(~held)), settings.pair_discount)
    classes = tuple(likelihood(c, shared, settings.discount) for c in both) if all(c.contexts.any() for c in both) else ()
    left = labelled(texts.where(held), labels.where(held)).select(F.xxhash64("doc_id").alias("hash"), "text", "label")
    fitted = measured(left, classes, settings)
    rows = fitted.orderBy("hash", "x", "label").limit(settings.calibration_rows).toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, 2 * (len(settings.passages) + 1))
    return Model(classes, fit_curve(x, rows["label"].to_numpy().astype(float), settings.ridge), settings)


def score(model: Model, x: Column) -> Column:
    """The score from 0 to 1 that the curve gives to the ratios of a text: higher is more likely toxic."""
    weights = F.array(*[F.lit(float(w)) for w in model.weights[:-1]])
    products = F.zip_with(x, weights, lambda a, b: a * b)
    total = F.aggregate(products, F.lit(float(model.weights[-1])), lambda a, b: a + b)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    fold: int = 2,
    folds: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`doc_id, held_out, score` for every row of `docs`.

    Labels of ids in the held-out fold are not used; null ids are in no fold and have no label. Texts are scored whole by
    their words alone. Null and empty texts, and texts without letters, have the score of no words. Rows that repeat are
    scored each, and count each in the shared counts, once in the classes'. Without labels, or with labels of one class
    only, all words are neutral and every text has the same score. Other columns are ignored. An empty table gives no
    rows.
    """
    number = F.col("doc_id")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where(~in_fold(number, fold, folds))
    model = train(docs, known, settings, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return measured(rows, model.classes, settings).select(
        "doc_id", in_fold(number, fold, folds).alias("held_out"), score(model, F.col("x")).alias("score")
    )
