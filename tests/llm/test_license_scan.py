import re
from collections import Counter
from itertools import permutations

import pytest

from tierlake.llm import license_scan as ls
from llm_tools import ASCII_LOWER

RULES = ls.rules()


def brute(text):
    """The contract's base and the detections, with every signature tried on every text."""
    text = (text or "").translate(ASCII_LOWER)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, found = [], set()
    for phrase, label in ls.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                found.add(label)
    norm = " " + " ".join(w) + " " if w else " "
    spans = [(m.start(), -m.end(), n) for n, r in enumerate(RULES) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm)]
    outer, reach = [], -1
    for start, end, n in sorted(spans):
        if -end > reach:
            outer.append((start, -end, n))
            reach = -end
    kept = []
    for i, (start, end, n) in enumerate(outer):
        beaten = any(
            0 <= j < len(outer) and outer[j][2] < n and max(start, outer[j][0]) < min(end, outer[j][1]) for j in (i - 1, i + 1)
        )
        if not beaten:
            kept.append(n)
    labels = found | {RULES[n].label for n in kept}
    score = max([0.0] + [RULES[n].score for n in kept] + [ls.BASE_SCORE] * bool(places))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), score


def check(df):
    want = Counter((d, *brute(t)) for d, t in df.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in ls.scan(df).collect()) == want


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License)",
    "GNU General Public License v3 or any later version; GPL-2.0; LGPL 2.1",
    "cc by cc by CC-BY-NC 4.0 Creative Commons Attribution-ShareAlike 4.0 International",
    "All rights reserved. all  RIGHTS\nreserved worldwide, copyright (c) 2019-2021",
    "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy",
    "allrights reserved; all rights reservedé; cc byé; İcc by K general public license",
    "SPDX-License-Identifier: Apache 2.0 dual BSD-style license, 3-clause BSD license",
    "general public license " * 500,
    "no license here, publiclicense, apache",
]


def test_signatures(spark):
    assert len(RULES) > 200 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    # The gate lets every match through.
    check(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def test_whole_table(documents):
    check(documents)


def test_odd_rows(odd, empty):
    check(odd)
    assert ls.scan(empty).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("under the Apache License, Version 2.0", "apache-2.0"),
        ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
        ("cc by-nc 4.0", "cc-by,cc-by-nc-4.0"),
        ("all rights reserved", "reserved"),
        ("just a text", ""),
    ],
)
def test_labels(spark, text, labels):
    assert ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_versions_in_one_word(spark):
    want = {"GPLv3": "gpl-3.0", "LGPLv2.1 or later": "lgpl-2.1", "under AGPLv3, GPL2": "agpl-3.0,gpl-2.0", "released under MPLv2.0": "mpl-2.0", "gplx": ""}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert [r.labels for r in ls.scan(df).orderBy("doc_id").collect()] == list(want.values())


def greedy(text, signatures):
    """Labels of the spans that stay: contained ones go, then by priority whatever overlaps none that stays."""
    norm = f" {text} "
    spans = sorted((m.start(), -m.end(), n) for n, r in enumerate(signatures) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm))
    outer, reach = [], -1
    for start, end, n in spans:
        if -end > reach:
            outer.append((n, start, -end))
            reach = -end
    kept = []
    for n, start, end in sorted(outer):
        if all(end <= a or b <= start for _, a, b in kept):
            kept.append((n, start, end))
    return ",".join(sorted({signatures[n].label for n, _, _ in kept}))


def test_chains_of_overlaps(spark):
    """Three spans in a chain, in every order of priority, also with more spans behind them."""
    signatures, texts = [], []
    for n, order in enumerate(permutations(range(3))):
        patterns = [f"a{n} b{n}", f"b{n} c{n}", f"c{n} d{n}", f"d{n} e{n}", f"e{n} f{n}"]
        signatures += [ls.Rule(patterns[k], patterns[k], patterns[k], 10, 0.5) for k in (*order, 3, 4)]
        texts += [" ".join(f"{x}{n}" for x in letters) for letters in ("abcd", "abcde", "abcdef", "xabcdycdef")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.scan(df, signatures).collect()}
    assert got == {k: greedy(t, signatures) for k, t in enumerate(texts)}
