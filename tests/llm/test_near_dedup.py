from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tierlake.llm import graph, near_dedup
from llm_tools import ASCII_LOWER, words


def sets_of(rows):
    found = {}
    for i, (_, text) in enumerate(rows):
        w = words((text or "").translate(ASCII_LOWER))
        found[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return found


def brute(rows):
    """n_shingles, component_id and kept of every row, from all pairs that share a shingle."""
    sets, where, common = sets_of(rows), defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for members in where.values():
        common.update(combinations(members, 2))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.drop("content").collect())


def test_whole_table(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got(near_dedup.near_duplicates(documents)) == brute(rows)


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(near_dedup.near_duplicates(odd)) == brute(rows)


def test_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_group_without_a_centre(spark):
    """Copies with more and more edits: neighbours are alike, ends are not, and no copy is alike to all."""
    rng = np.random.default_rng(3)
    text, rows = [f"w{rng.integers(10**6)}" for _ in range(120)], []
    for i in range(60):
        rows.append((int(rng.permutation(1000)[0]) * 100 + i, " ".join(text)))
        text[int(rng.integers(120))] = f"n{i}"
        if i % 3 == 0:
            text[int(rng.integers(120))] = f"m{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(df)) == brute(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (3000, 500, 500))
    x, y = (near_dedup.signature(np.concatenate([shared, own]), 160) for own in (a, b))
    assert abs((x == y).mean() - 0.75) < 0.15


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (9, 8), (3, 9), (20, 21)], [(i, i + 1) for i in range(100)]])
def test_components(spark, edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = graph.components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == root
