"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm.words import HASHES, windows
from tierlake.session import materialise

#: Words of a window that counts as repeated.
WINDOW = 5
#: Strata up to which the table of cutoffs is broadcast.
BROADCAST_STRATA = 10_000

# Bytes that are no character of a word: continuations of UTF-8 characters, and white space.
_NO_CHARACTER = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])
# The symbols that are counted.
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails if the value is above the cutoff; cutoffs run from lenient to strict."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


#: Values are SQL over the measures of a document with at least one word.
RULES = (
    Rule("symbols", "try_divide(n_symbols, n_words)", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", (0.9, 0.7, 0.5, 0.3, 0.2, 0.1)),
    Rule("repeated_words", "try_divide(n_repeat_words, n_words)", (0.18, 0.15, 0.1, 0.05, 0.02)),
    Rule("long_words", "try_divide(word_chars, n_words)", (40.0, 30.0, 20.0, 15.0, 12.0, 10.0)),
    Rule("short_words", "-try_divide(word_chars, n_words)", (-1.2, -1.5, -2.0, -2.5, -3.0)),
)


@dataclass(frozen=True)
class Settings:
    """At most `risk` of a stratum's good documents are rejected by all rules together, with chance 1 - `error`."""

    risk: float = 0.02
    error: float = 0.05


def measures(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) > WINDOW:
        _, which, counts = np.unique(windows(HASHES.of(words), WINDOW), return_inverse=True, return_counts=True)
        twice = (counts[which] > 1).astype(np.int64)
        begun = np.zeros(len(words) + 1, dtype=np.int64)
        begun[: len(twice)] += twice
        begun[WINDOW : WINDOW + len(twice)] -= twice
        repeated = int((np.cumsum(begun) > 0).sum())
    return (
        len(words),
        len(text.translate(None, _NO_CHARACTER)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        found = np.array([measures(t.as_py()) for t in batch.column(2)], dtype=np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(6))], names=["doc_id", "stratum", *names]
        )


def log_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of at most `k` successes in `n` trials."""
    i = np.arange(k + 1)
    terms = np.concatenate([[0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[1:]))]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(terms.max() + np.log(np.exp(terms - terms.max()).sum()))


def strictest(good: int, rejected: list[int], risk: float, error: float) -> int | None:
    """The last cutoff whose exact upper bound on the rejected share of the good is at most `risk`; none if no cutoff's is.

    The bound of `k` of `n` is at most `risk` exactly if as few as `k` have a chance of at most `error` at that risk.
    """
    safe = [c for c, k in enumerate(rejected) if good and k < risk * good and log_tail(k, good, risk) <= math.log(error)]
    return max(safe, default=None)


def _cutoffs(rules: tuple[Rule, ...], settings: Settings, tests: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {"_stratum": batch["stratum"]}
        for r, rule in enumerate(rules):
            chosen = [
                strictest(int(n), [int(x) for x in counts], settings.risk / len(rules), settings.error / tests)
                for n, counts in zip(batch["good"], batch[f"r{r}"])
            ]
            out[f"cut{r}"] = pd.Series([math.inf if c is None else rule.cutoffs[c] for c in chosen], dtype="float64")
        yield pd.DataFrame(out)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    rules: tuple[Rule, ...] = RULES,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "label",
) -> DataFrame:
    """Measures of every row's whole text, `base_failed` and `kept`.

    `labels` (`doc_id, label`; 1 is good, 0 is not) are the holdout: in each stratum a rule gets the strictest cutoff
    for which the exact binomial bound shows that it rejects no more than its part of `risk` of the good documents. The
    risk is shared by the rules and the error by all tests of all strata (Bonferroni), so the promise holds for each
    stratum and for all rules together. Where the labels are too few to show it, a rule rejects nothing.

    A document fails the base with under 10 words or with more than a fifth of its words in repeated windows; then it
    is not kept, whatever the rules say. Null and empty texts have no words. Rows that repeat are judged each; a label
    that repeats counts once, and both labels of one document count each. A null stratum is a stratum. With no labels
    the base alone decides; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long"), F.col(stratum).cast("string"), F.col(text).cast("binary")).mapInArrow(
        _measured,
        "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long",
    )
    rows = materialise(spark, rows, "measures")
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    # A document that fails the base is no test of the rules.
    held = rows.join(good, "doc_id", "left_semi").where(~base)
    counted = held.groupBy("stratum").agg(
        F.count("*").alias("good"),
        *(
            F.array(*(F.sum((F.expr(rule.value) > c).cast("long")) for c in rule.cutoffs)).alias(f"r{r}")
            for r, rule in enumerate(rules)
        ),
    )
    counted = materialise(spark, counted, "holdout")
    strata = counted.count()
    tests = max(1, strata) * sum(len(rule.cutoffs) for rule in rules)
    schema = ", ".join(["_stratum string", *(f"cut{r} double" for r in range(len(rules)))])
    cutoffs = counted.mapInPandas(functools.partial(_cutoffs, rules, settings, tests), schema)
    if strata <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    judged = rows.join(cutoffs, rows["stratum"].eqNullSafe(cutoffs["_stratum"]), "left")
    above = [
        F.coalesce(F.expr(rule.value) > F.col(f"cut{r}"), F.lit(False)) for r, rule in enumerate(rules)
    ]
    failed = functools.reduce(lambda a, b: a | b, above, F.lit(False))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~failed).alias("kept"),
    )
