import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tierlake.llm import catalog, toxicity
from llm_tools import COLUMNS, ODD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())


def cell(word):
    return xxhash.xxh3_64_intdigest(word) >> 44


def made_documents(n=1_200, seed=1):
    """Texts of invented words; of the toxic ones, each has some of ten bad words in random places."""
    rng = random.Random(seed)
    syllables = "ba co di fu ge ha ki lo mu ne".split()
    bad = ["vilex", "grumof", "zzarp", "hoxen", "prath"]
    rows, labels = [], []
    for i in range(n):
        text = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), "en", "s", 1))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    return rows, labels, bad


def test_counts_by_brute_force(spark):
    rows, labels, _ = made_documents(150)
    rows += [(900 + i, r[1], *r[2:]) for i, r in enumerate(rows[:20])] + [(1, None, "en", "s", 0), (None, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).select("doc_id", F.col("text").cast("binary").alias("text")).repartition(3)
    shared = np.zeros(toxicity.CELLS, dtype=np.int64)
    for r in rows:
        for c in {cell(w) for w in words_of(r[1])}:
            shared[c] += 1
    assert (toxicity.shared_counts(df) == shared).all()
    label = dict(labels)
    known = toxicity.labelled(df, spark.createDataFrame(labels + [(1, 0), (None, 1)], "doc_id long, label int"))
    assert sorted(r.doc_id for r in known.select("doc_id").collect()) == sorted(r[0] for r in rows if r[0] in label or r[0] == 1)
    pairs = defaultdict(set)
    for r in rows:
        if r[0] in label or r[0] == 1:
            w = words_of(r[1])
            pairs[label.get(r[0], 0)] |= set(zip([b"", *w], w))
    for got, value in zip(toxicity.class_counts(known), (0, 1)):
        want = np.zeros(toxicity.CELLS, dtype=np.int64)
        for _, second in pairs[value]:
            want[cell(second)] += 1
        assert (got == want).all()


def test_pairs_by_brute_force(spark):
    """The higher order: likelihoods of words behind words, against counts in a dictionary."""
    rows, labels, _ = made_documents(150)
    rows = [(i, text + " ba co ba co ba co ba co", *rest) for i, text, *rest in rows]
    df = spark.createDataFrame(rows, DOCS).select("doc_id", F.col("text").cast("binary").alias("text")).repartition(3)
    known = toxicity.labelled(df, spark.createDataFrame(labels, "doc_id long, label int"))
    shared = np.ones(toxicity.CELLS, dtype=np.int64)
    made = [toxicity.likelihood(c, shared, 3.0) for c in toxicity.class_tables(known, 3.0)]
    ratios = []
    for value in (0, 1):
        pairs = defaultdict(int)
        for r in rows:
            if dict(labels).get(r[0]) == value:
                w = words_of(r[1])
                for pair in zip([b"", *w], w):
                    pairs[pair] += 1
        behind, freed, contexts = defaultdict(int), defaultdict(float), np.zeros(toxicity.CELLS, dtype=np.int64)
        for (first, second), n in pairs.items():
            behind[first] += n
            freed[first] += min(n, 3.0)
            contexts[cell(second)] += 1
        lower = np.exp(toxicity.log_likelihood(contexts, shared, 3.0))
        tests = [("ba", "co"), ("co", "ba"), ("zzz", "co"), ("ba", "zzz"), *zip(rows[0][1].split(), rows[0][1].split()[1:])]
        want = []
        for first, second in ((a.encode(), b.encode()) for a, b in tests):
            low = lower[cell(second)]
            seen = behind[first]
            want.append((max(pairs[first, second] - 3.0, 0) + freed[first] * low) / seen if seen else low)
        assert want[0] > 10 * lower[cell(b"co")]
        ratios.append(np.log(want))
    hashes, starts = toxicity._words([" ".join(t).encode() for t in tests])
    got = toxicity.word_ratios(tuple(made), hashes)[1][starts + 2]
    # A few pairs may share a cell with another one.
    assert (abs(got - (ratios[1] - ratios[0])) < 1e-3).mean() > 0.95


def test_likelihoods_sum_to_one():
    rng = np.random.default_rng(2)
    counts, shared = rng.integers(0, 9, 1_000), rng.integers(0, 50, 1_000)
    for discount in (0.75, 3.0):
        assert np.exp(toxicity.log_likelihood(counts, shared, discount)).sum() == pytest.approx(1)
    # What a class has seen up to the discount is as likely as the backoff says, up to a constant.
    rare = np.flatnonzero(counts <= 3)
    gap = toxicity.log_likelihood(counts, shared, 3.0)[rare] - np.log((shared[rare] + 0.5) / (shared.sum() + 500))
    assert gap == pytest.approx(gap[0])
    assert toxicity.log_likelihood(counts * 0, shared, 3.0) == pytest.approx(np.log((shared + 0.5) / (shared.sum() + 500)))


def test_passages():
    ratios = np.array([0.5, -1.0, 4.0, 2.0, -3.0])
    assert toxicity.passage_ratios(ratios, (1, 2, 4, 16)) == pytest.approx([4.0, 3.0, 1.375, 0.5, 0.5])
    assert toxicity.passage_ratios(ratios[:0], (1, 2)) == [0.0, 0.0, 0.0]


def test_curve():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4_000, 3)) * [1, 10, 0.1] + [0, 5, 1]
    true = np.array([2.0, -0.1, 3.0, -2.0])
    y = (rng.random(4_000) < 1 / (1 + np.exp(-(x @ true[:3] + true[3])))).astype(float)
    w = toxicity.fit_curve(x, y, 0.1)
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert abs(p - 1 / (1 + np.exp(-(x @ true[:3] + true[3])))).max() < 0.08
    assert (toxicity.fit_curve(x[:0], y[:0], 0.1) == 0).all()
    assert np.isfinite(toxicity.fit_curve(x, y * 0, 0.1)).all()


def test_held_out_accuracy(spark):
    rows, labels, bad = made_documents()
    df, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, label int")
    truth = {r[0]: any(w in r[1].split() for w in bad) for r in rows}
    got = toxicity.score_documents(df, known).collect()
    held = [r for r in got if r.held_out]
    assert 200 < len(held) < 400 and len(got) == len(rows)
    caught = [r.score >= 0.3 for r in held if truth[r.doc_id]]
    false = [r.score >= 0.3 for r in held if not truth[r.doc_id]]
    assert sum(caught) >= 0.95 * len(caught) and sum(false) <= 0.02 * len(false)
    # Labels of the held-out fold are not used.
    flipped = [(i, 1 - v if r.held_out else v) for r in got for i, v in labels if i == r.doc_id]
    again = toxicity.score_documents(df, spark.createDataFrame(flipped, "doc_id long, label int")).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got})


def test_query(spark, sf, documents):
    got = catalog.QUERIES["op13_toxicity"].run(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 0), (8, 0), (None, 1), (9, None)], "doc_id long, label int")
    got = toxicity.score_documents(odd, labels).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in ODD)
    assert all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {False}
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.score)
    # Texts without words have one score.
    assert by_id[3] == by_id[4] == by_id[5] and len(by_id[3]) == 1
    assert toxicity.score_documents(empty, labels).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (6, 1)], [(6, 0)]])
def test_no_labels_or_one_class(spark, odd, labels):
    got = toxicity.score_documents(odd, spark.createDataFrame(labels, "doc_id long, label int")).collect()
    assert len({r.score for r in got}) == 1 and COLUMNS
