import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tierlake.llm import pii


def luhn(v):
    d = [int(c) for c in re.sub("[^0-9]", "", v)][::-1]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


# The contract's patterns, as they are written there.
PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", luhn),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def base(text):
    return [(k, m.start(), m.end()) for k, (p, good) in enumerate(PLAIN) for m in re.finditer(p, text or "") if good(m[0])]


TRICKY = [
    "a@b@c.d and x@y.z_u@v.w, .@a.b %+@1.2.3.4 a@b a@b. @c.d q@-.- e@f..g",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 999.1.1.1.1 ..1.2.3.4..",
    "4111 1111 1111 1111 4111-1111-1111-1111 5500000000000004 411111111111111 4111  1111 1111 1111 1",
    "+1 (988) 555-2485 +49.30.123456 ++12345678 +1-2 +123456789012345678 +1 2 3 4 5 6 7 8\n+9999999",
    "é\U0001f600 a@b.cé\U0001f600+1 (988) 555-2485\U0001f6004111111111111111",
    "4111111111111111 4111111111111112 4111111111111111",
    "9" * 5000 + " " + "1." * 3000 + "a" * 5000 + "@" + "b." * 3000 + "c +" + "1 " * 3000,
]


def rows_of(df):
    return Counter((d, tuple(map(tuple, b)), tuple(map(tuple, s))) for d, b, s in df.select("doc_id", "base", "spans").collect())


def test_base_spans_of_tricky_texts(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [tuple(s) for s in r.base] == base(TRICKY[r.doc_id]), r.doc_id
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_whole_table(documents):
    want = Counter((d, tuple(base(t))) for d, t in documents.select("doc_id", "text").collect())
    assert Counter((r.doc_id, tuple(map(tuple, r.base))) for r in pii.find(documents).collect()) == want


def test_odd_rows(odd, empty):
    want = Counter((d, tuple(base(t))) for d, t in odd.select("doc_id", "text").collect())
    found = pii.find(odd, keep=("doc_id", "row", "hits"))
    assert Counter((r.doc_id, tuple(map(tuple, r.base))) for r in found.collect()) == want
    assert found.columns == ["doc_id", "row", "hits", "base", "spans"]
    assert pii.find(empty).count() == 0


def corpus():
    """Phone numbers after "call" teach that context; numbers without a plus in it are new. "the" comes before all kinds."""
    rows = [f"please call +1 (555) 010-{1000 + i} now" for i in range(30)]
    rows += [f"the +1 555 020 {1000 + i} x" for i in range(30)] + [f"the user{i}@mail.org y" for i in range(30)]
    rows += ["please call 555-010-9999 tomorrow", "the 555-010-8888 part", "order 555-010-7777 today", "please call +1 (555) 010-1000 now"]
    return list(enumerate(rows))


def test_contexts_find_unseen_identifiers(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = {}
    for r in pii.find(df).collect():
        new = set(map(tuple, r.spans)) - set(map(tuple, r.base))
        if new:
            more[r.doc_id] = sorted(new)
    assert more == {90: [(3, 12, 24)]}


def test_scores_against_a_plain_loop(spark):
    spans = pii._spans(pii._matches(spark.createDataFrame(corpus(), "row long, text string"), "text"))
    rows = spans.collect()
    settings = pii.Settings()
    edges = {}
    for r in rows:
        for context in (f"l:{r.left}" if r.left else None, f"r:{r.right}" if r.right else None):
            if context:
                key = (context, r.kind, r.value)
                edges[key] = edges.get(key, False) or r.base
    score = {}
    for _ in range(settings.rounds):
        worth, size = Counter(), Counter()
        for (context, kind, value), seed in edges.items():
            worth[context, kind] += 1.0 if seed else score.get((kind, value), 0.0)
            size[context] += 1
        precision = {k: w / size[k[0]] for k, w in worth.items() if w >= settings.support and w / size[k[0]] >= settings.precision}
        wrong = {}
        for (context, kind, value), seed in edges.items():
            if not seed and (context, kind) in precision:
                wrong[kind, value] = wrong.get((kind, value), 1.0) * max(1 - precision[context, kind], 1e-6)
        score = {k: 1 - w for k, w in wrong.items()}
    want = {k for k, s in score.items() if s >= settings.accepted}
    assert want == {tuple(r) for r in pii.learn(spans).collect()} and want


@pytest.mark.parametrize("unseen", [1, 8, 80])
def test_unseen_identifiers_do_not_count_against_their_context(spark, unseen):
    rows = [f"please call +1 (555) 010-{1000 + i} now" for i in range(8)] + [f"please call 555-020-{1000 + i} a{i}" for i in range(unseen)]
    # As many base instances of an other kind: nothing is decided about the context.
    rows += [f"at +1 (555) 030-{1000 + i} now" for i in range(8)] + [f"at user{i}@mail.org b{i}" for i in range(8)]
    rows += [f"at 555-040-{1000 + i} c{i}" for i in range(unseen)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    more = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(df).collect() if r.spans != r.base}
    assert more == {8 + i: [(3, 12, 24)] for i in range(unseen)}


def more_than_base(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {r.doc_id: [tuple(s) for s in r.spans if s not in r.base] for r in pii.find(df).collect() if r.spans != r.base}


def test_dates_and_ranges_after_a_trusted_word_are_no_numbers(spark):
    """Eight numbers make "call" a trusted word; what stands after it is a number only if it can be one."""
    seeds = [f"call +1 555 010 {1000 + i} now{i}" for i in range(8)]
    odd = [f"call {2010 + i % 10}-{1 + i % 12:02}-{1 + i % 28:02} meeting{i}" for i in range(300)]
    odd += [f"call {1 + i:02}.{1 + i % 12:02}.{1990 + i} d{i}" for i in range(20)] + [f"call {1990 + i}-{2000 + i} e{i}" for i in range(9)]
    assert more_than_base(spark, seeds + odd) == {}
    # The national numbers among them are found all the same.
    numbers = [f"call 555 020 {1000 + i} c{i}" for i in range(5)]
    assert more_than_base(spark, seeds + odd + numbers) == {len(seeds + odd) + i: [(3, 5, 17)] for i in range(5)}


def test_strings_of_other_shapes_count_against_a_word(spark):
    """Part numbers after "on" have a shape that no number has: many of them show that "on" tells nothing."""
    seeds = [f"on +1 (555) 010-{1000 + i} now{i}" for i in range(8)]
    parts = [f"on 12.34.56.{1000 + i} x{i}" for i in range(40)]
    national = [f"on 555-020-{1000 + i} a{i}" for i in range(10)]
    assert more_than_base(spark, seeds + national) == {8 + i: [(3, 3, 15)] for i in range(10)}
    assert more_than_base(spark, seeds + parts + national) == {}


def test_planted_numbers_precision_and_recall(spark):
    """Of 200 planted national numbers in trusted patterns all are found, of 400 dates, part numbers and sums none."""
    rng = random.Random(3)
    words = ["phone", "tel", "mobile", "ring"]
    rows = [f"{rng.choice(words)} +44 {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)} t{i}" for i in range(200)]
    planted = [f"{rng.choice(words)} {rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} u{i}" for i in range(200)]
    other = [f"{rng.choice(['part', 'sum', 'no'])} {rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} v{i}" for i in range(200)]
    other += [f"{rng.choice(words)} {rng.randint(1950, 2025)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} w{i}" for i in range(200)]
    found = more_than_base(spark, rows + planted + other)
    assert sorted(found) == list(range(200, 400))


def test_accepted_instances_of_other_kinds_count_against_a_context(spark):
    """All 16 addresses after "mail" are accepted in the first round, so "by" holds 8 base numbers and 16 addresses after it."""
    rows = [f"mail user{i}@mail.org x{i}" for i in range(8)] + [f"mail other{i} at mail dot org by y{i}" for i in range(16)]
    rows += [f"z{i} +1 (555) 010-{1000 + i} by" for i in range(8)] + ["w 555-020-1000 by"]
    spans = pii._spans(pii._matches(spark.createDataFrame(list(enumerate(rows)), "row long, text string"), "text"))
    found = lambda rounds: {tuple(r) for r in pii.learn(spans, pii.Settings(rounds=rounds)).collect()}
    addresses = {(0, f"other{i} at mail dot org") for i in range(16)}
    assert found(1) == addresses | {(3, "555-020-1000")}
    assert found(2) == found(3) == addresses


def test_candidates_of_two_kinds_are_scored_as_both(spark):
    """The last number may be a card or a phone number, and only numbers stand after "call"."""
    rows = [f"call +1 (555) 010-{1000 + i} now" for i in range(9)] + ["call 0049 3012 3456 soon"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {tuple(s) for r in pii.find(df).collect() if r.doc_id == 9 for s in r.spans} == {(3, 5, 19)}


def test_overlaps_against_a_greedy_loop(spark):
    rng = random.Random(7)
    rows = []
    for row in range(60):
        for _ in range(rng.randint(1, 8)):
            start = rng.randrange(30)
            rows.append((row, rng.randrange(4), start, start + rng.randint(1, 9), rng.choice([0.9, 0.95, 1.0])))
    rows = list(set(rows))
    want = set()
    for row in range(60):
        kept = []
        for _, k, a, b, _ in sorted((r for r in rows if r[0] == row), key=lambda r: (-r[4], r[2] - r[3], r[2], r[1])):
            if all(b <= x or y <= a for _, x, y in kept):
                kept.append((k, a, b))
        want |= {(row, *s) for s in kept}
    df = spark.createDataFrame(rows, "row long, kind int, start long, end long, score double")
    got = [(r.row, *r.span) for r in pii._resolved(df).collect()]
    assert sorted(got) == sorted(want)


def test_redaction(spark):
    text = "é write a@b.cd or +1 (988) 555-2485."
    df = pii.find(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string"), keep=("doc_id", "text"))
    got = {r.doc_id: r.t for r in df.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é write [email] or [phone].", 2: None, 3: "none"}
