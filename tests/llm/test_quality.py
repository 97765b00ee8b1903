import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tierlake.llm import quality_classifier as qc
from tierlake.llm import quality_rules as qr
from llm_tools import ODD, words


def plain(text):
    """The measures of the contract, one after another."""
    text, w = text or "", words(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = Counter(windows)
    repeated = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if words(line)]
    return (
        len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(repeated)
    )


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label int")


def test_measures(documents):
    texts = [r[0] for r in documents.select("text").collect()] + [r[1] for r in ODD]
    texts += ["a\nb\na\n \na", "é|ü # \U0001f600$", "x " * 12, "a b c d e f a b c d e"]
    for text in texts:
        assert qr.measures(None if text is None else text.encode()) == plain(text)


def test_binomial_bound():
    for k, n, p in [(0, 10, 0.3), (3, 50, 0.1), (10, 2000, 0.01)]:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(qr.log_tail(k, n, p)), exact, rel_tol=1e-9)
    # Zero of 300 shows a risk of at most 1 % with chance 95 %, zero of 298 does not.
    assert qr.strictest(300, [0], 0.01, 0.05) == 0 and qr.strictest(298, [0], 0.01, 0.05) is None
    assert qr.strictest(5000, [0, 10, 40, 400], 0.01, 0.05) == 1
    assert qr.strictest(0, [0], 0.01, 0.05) is None


def judged(spark, texts, labels):
    """kept of every document by a plain loop over strata, rules and cutoffs."""
    fails = lambda m: m[0] < 10 or 100 * m[5] > 20 * m[0]
    value = {
        "symbols": lambda m: m[2] / m[0], "repeated_lines": lambda m: m[4] / m[3], "repeated_words": lambda m: m[5] / m[0],
        "long_words": lambda m: m[1] / m[0], "short_words": lambda m: -m[1] / m[0],
    }
    good = {d for d, label in labels if label == 1}
    held = {}
    for d, text, lang in texts:
        if d in good and not fails(plain(text)):
            held.setdefault(lang, []).append(plain(text))
    tests = max(1, len(held)) * sum(len(r.cutoffs) for r in qr.RULES)
    cut = {}
    for lang, ms in held.items():
        for rule in qr.RULES:
            at = qr.strictest(len(ms), [sum(value[rule.name](m) > c for m in ms) for c in rule.cutoffs], 0.02 / 5, 0.05 / tests)
            cut[lang, rule.name] = math.inf if at is None else rule.cutoffs[at]
    out = Counter()
    for d, text, lang in texts:
        m = plain(text)
        bad = any(value[r.name](m) > cut.get((lang, r.name), math.inf) for r in qr.RULES if m[0])
        out[d, *m[:3], *m[4:], fails(m), not fails(m) and not bad] += 1
    return out


def test_rules_against_a_plain_loop(spark, documents):
    many = documents.where("lang = 'en'").crossJoin(spark.range(20).toDF("copy")).selectExpr("doc_id * 20 + copy AS doc_id", "text", "lang")
    many = many.union(documents.where("lang <> 'en'").select("doc_id", "text", "lang"))
    texts = [tuple(r) for r in many.collect()]
    labels = [(d, 1 if "#" not in t and "|" not in t else 0) for d, t, _ in texts]
    got = Counter(tuple(r) for r in qr.judge(many, labels_of(spark, labels)).collect())
    assert got == judged(spark, texts, labels)
    # The cutoffs do reject what the base lets through.
    assert any(not r[-2] and not r[-1] for r in got)


def test_rules_on_odd_rows(spark, odd, empty):
    texts = [(r[0], r[1], r[2]) for r in ODD]
    labels = [(1, 1), (1, 1), (1, 0), (None, 1), (3, None), (8, 1)]
    got = Counter(tuple(r) for r in qr.judge(odd, labels_of(spark, labels)).collect())
    assert got == judged(spark, texts, labels)
    assert qr.judge(empty, labels_of(spark, labels)).count() == 0
    assert qr.judge(odd, labels_of(spark, [])).where("kept").count() == sum(1 for r in judged(spark, texts, []).elements() if r[-1])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS label")
    rows = qc.score_documents(docs, labels).select("doc_id", "held_out", "score").join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.label == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    ids = [r[0] for r in documents.select("doc_id").collect()]
    out = [zlib.crc32(str(d).encode()) % 5 == 0 for d in ids]
    scores = []
    for flip in (0, 1):
        labels = labels_of(spark, [(d, (d % 3 > 0) ^ (flip if o else 0)) for d, o in zip(ids, out)])
        scores.append({r[0]: r[1] for r in qc.score_documents(documents, labels).select("doc_id", "score").collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (1, 1), (2, 0), (8, 1), (10, 1), (None, 1), (3, None), (4, 7)]])
def test_classifier_on_odd_rows(spark, odd, empty, labels):
    rows = qc.score_documents(odd, labels_of(spark, labels)).select("doc_id", "held_out", "score", "text").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not words(r.text)}) == 1
    assert not labels or len({r.score for r in rows if r.doc_id == 1}) == 1
    assert qc.score_documents(empty, labels_of(spark, labels)).count() == 0


def test_scoring_equals_the_table_of_vectors():
    settings = qc.Settings(bits=10)
    model = qc.Model(settings, np.random.default_rng(1).normal(size=1 << 10), 0.2)
    text = "a few words words and a few more".encode()
    buckets, counts = qc._bag(text, settings)
    mean = (model.weights[buckets] * counts).sum() / counts.sum()
    assert math.isclose(qc._Words(model).score(text), 1 / (1 + math.exp(-(mean + 0.2))), rel_tol=1e-12)


def test_long_texts_are_learned_from_all_their_counts():
    settings = qc.Settings()
    for times in (3, 65_536, 70_001):
        bag = qc._bag(b"long " * times + b"end", settings)
        buckets, counts = qc._unpacked(*(part.tobytes() for part in bag))
        found = dict(zip(buckets.tolist(), counts.tolist()))
        features = [*qc._features(b"long", settings), 1]
        assert all(found[f] >= times - 1 for f in features)
        assert sum(found.values()) == len(qc._features(b"long", settings)) * times + len(qc._features(b"end", settings)) + times
    assert [len(part) for part in qc._unpacked(*(part.tobytes() for part in qc._bag(b"", settings)))] == [0, 0]
