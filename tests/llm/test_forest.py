import math
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierlake.llm import catalog, forest

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, queries, k=5):
    """The k nearest of each query by double precision, ties to the smaller id."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = tuple(float(np.float32(x)) for x in v)
            good[i] = min(good.get(i, v), v)
    out = {}
    for q in queries:
        if q in good:
            a = np.array(good[q])
            found = []
            for i, v in good.items():
                if i != q and len(v) == len(a):
                    b = np.array(v)
                    found.append((-sum(a * b) / (math.sqrt(sum(a * a)) * math.sqrt(sum(b * b))), i))
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def run(spark, rows, queries, **settings):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS vector", "2 AS near", "3 AS score")
    got = {}
    for r in forest.search(df, df.where(df.vec_id.isin(queries)), settings=forest.Settings(**settings)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(g)] for q, g in got.items()}


def same(got, want):
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items() if w}
    for q, g in got.items():
        assert [s for _, s in g] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    queries = [i for i, _ in rows if i % 50 == 0]
    want = exact(rows, queries)
    hit = total = 0
    for r in catalog.QUERIES["op9_forest"].run(spark, sf).collect():
        hit += r.vec_id in {i for i, _ in want[r.query_id]}
        total += 1
    assert total == 5 * len(queries) and hit >= 0.9 * total


def test_odd_vectors(spark):
    """All leaves are searched, so the result is exact: ties, copies, repeated ids, and vectors that take no part."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(200, [2.0, 4.0, 6.0, 8.0]), (201, [-1.0, -2.0, -3.0, -4.0])]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(305, []), (306, [1.0, 2.0]), (307, [2.0, 1.0]), (None, [1.0] * 4), (5, [9.0, 9.0, 9.0, 9.0]), (5, [1.0] * 4)]
    rows += [(308, [1e30, 1e-30, 1e30, 1e30]), (309, [1e-30] * 4)]
    queries = [0, 5, 100, 139, 200, 201, 300, 301, 302, 303, 304, 305, 306, 308, 309]
    same(run(spark, rows, queries, share=100.0, block=7), exact(rows, queries))


def test_few_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    same(run(spark, rows, [1, 2]), exact(rows, [1, 2]))
    assert run(spark, rows, [3]) == {} and run(spark, [], [1]) == {} and run(spark, rows[:1], [1]) == {}


def test_queue_visits_near_cells_first():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(500, 8))
    tree = forest.grow(points, 5, forest.Settings(sample_leaf=4), rng)
    leaves = forest.leaves_of(tree, points)
    sizes = np.bincount(leaves, minlength=tree.leaves)
    order = forest.visit([tree], [sizes], points[0], 500)
    assert order[0] == (0, leaves[0]) and sorted(order) == [(0, k) for k in range(tree.leaves)]


def test_driver_gets_trees_and_no_rows(spark, monkeypatch):
    """2000 rows of 32 numbers are half a megabyte; three nodes of each tree and the sizes of the leaves are not."""
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(2500, 32)).tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    sent, kind = [], type(df)
    for name in ("collect", "toArrow", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): sent.append(f(self)) or sent[-1])
    found = forest.search(df, df.where("vec_id % 50 = 0"), settings=forest.Settings(trees=2, leaf=1000, sample=2000, sample_leaf=300))
    size = sum(len(pickle.dumps(x)) for x in sent)
    monkeypatch.undo()
    assert 0 < size < 50_000 and found.count() == 250


@pytest.mark.parametrize("total", [800, 80_000])
def test_trees_of_the_smallest_hashes(spark, total):
    """Only rows below a bound on the hash are put in order; a bound that leaves too few of them is given up."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i * i, v) for i, v in enumerate(rng.normal(size=(800, 6)).tolist())], "id long, vector array<double>")
    settings = forest.Settings(trees=3, leaf=50, sample=100, sample_leaf=4)
    sample = df.orderBy(F.xxhash64("id"), "id").limit(settings.sample).collect()
    units, rng = forest._units([r.vector for r in sample]), np.random.default_rng(settings.seed)
    depth = max(math.ceil(math.log2(total / settings.leaf)), 5)
    want = [forest.grow(units, depth, settings, rng) for _ in range(settings.trees)]
    got = forest.fitted(df.repartition(5), total, settings)
    assert [t.leaves for t in got] == [t.leaves for t in want]
    for a, b in zip(got, want, strict=True):
        assert a.children.tolist() == b.children.tolist() and a.normals == pytest.approx(b.normals) and a.offsets == pytest.approx(b.offsets)


def test_visits_are_not_broadcast(spark):
    """Their estimated size is that of the queries; each query is repeated for every leaf it visits."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(600, 4)).tolist())], SCHEMA)
    found = forest.search(df, df.where("vec_id % 50 = 0"))
    assert found.count() == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "tree#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_blocks_of_a_leaf_are_filled():
    """Blocks of a leaf are joined to larger ones, over the ends of batches too; no row is lost and no leaf mixed."""
    parts = [(0, 1, 3), (0, 1, 2), (0, 1, 4), (0, 2, 1), (0, 2, 1), (1, 2, 6), (1, 2, 1), (1, 3, 1)]
    rows = [(t, leaf, n, bytes([k] * n), bytes([k] * 2 * n)) for k, (t, leaf, n) in enumerate(parts)]
    frames = [pd.DataFrame(rows[a:b], columns=forest.BLOCK) for a, b in ((0, 2), (2, 2), (2, 5), (5, 8))]
    full = pd.concat(forest._full(forest.Settings(block=5), iter(frames)))
    assert list(zip(full["tree"], full["leaf"], full["size"])) == [(0, 1, 5), (0, 1, 4), (0, 2, 2), (1, 2, 6), (1, 2, 1), (1, 3, 1)]
    assert b"".join(full["ids"]) == b"".join(r[3] for r in rows) and b"".join(full["vectors"]) == b"".join(r[4] for r in rows)
    assert all(len(i) == n and len(v) == 2 * n for n, i, v in zip(full["size"], full["ids"], full["vectors"]))
