"""Approximate nearest neighbours: random-projection trees, one priority queue over all trees, exact reranking."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.session import materialise


#: More than products of single-precision unit vectors are off.
SLACK = 1e-5
#: Columns of a block of rows of a leaf.
BLOCK = ["tree", "leaf", "size", "ids", "vectors"]
#: Candidates that a task holds at most before it merges them.
MERGED = 500_000


@dataclass(frozen=True)
class Settings:
    """Trees, rows of a leaf (small tables still get 32 leaves), and how far a search goes.

    A search ends when the leaves it has visited hold `share` of the table's rows, counted in every tree; vectors
    without structure need the large default. Splits are fitted on the `sample` rows with the smallest hash of their
    id, and a leaf keeps at least `sample_leaf` of them; rows travel in blocks of `block` vectors, queries of `queries`.
    A task finds the leaves of about `apart` queries; about `together` meet the rows of a leaf at a time.
    """

    trees: int = 8
    leaf: int = 256
    share: float = 1.25
    sample: int = 20_000
    sample_leaf: int = 16
    block: int = 256
    queries: int = 32
    together: int = 1024
    apart: int = 256
    seed: int = 11


@dataclass(frozen=True)
class Tree:
    """Inner nodes as arrays. Child numbers from 0 on are inner nodes, negative ones are leaves: -1 is leaf 0."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int


def grow(sample: np.ndarray, depth: int, settings: Settings, rng: np.random.Generator) -> Tree:
    """Split by the plane between two random points of a cell at the median, `depth` times or until cells are small."""
    normals, offsets, children, leaves = [], [], [], 0

    def cell(rows: np.ndarray, left: int) -> int:
        nonlocal leaves
        if left and len(rows) >= 2 * settings.sample_leaf:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            size = float(np.linalg.norm(normal))
            # Equal points give no plane; any direction is as good.
            normal = normal / size if size > 0 else rng.standard_normal(sample.shape[1])
            along = sample[rows] @ normal
            cut = float(np.median(along))
            low = along <= cut
            if 0 < low.sum() < len(rows):
                at = len(normals)
                normals.append(normal)
                offsets.append(cut)
                children.append([0, 0])
                children[at] = [cell(rows[low], left - 1), cell(rows[~low], left - 1)]
                return at
        leaves += 1
        return -leaves

    if cell(np.arange(len(sample)), depth) < 0:  # a tree of one leaf still has a root
        normals, offsets, children = [np.zeros(sample.shape[1])], [0.0], [[-1, -1]]
    return Tree(np.array(normals), np.array(offsets), np.array(children), max(leaves, 1))


def _grown(settings: Settings, depth: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The trees of the sample, which comes in one partition, and how many rows it has."""
    found = [batch for batch in batches if len(batch)]
    if not found:
        return
    sample = pd.concat(found, ignore_index=True).sort_values(["hash", "id"])
    units = _units(sample["vector"])
    rng = np.random.default_rng(settings.seed)
    trees = [grow(units, depth, settings, rng) for _ in range(settings.trees)]
    made = [(t.normals.tobytes(), t.offsets.tobytes(), t.children.astype(np.int64).tobytes(), t.leaves, len(units)) for t in trees]
    yield pd.DataFrame(made, columns=["normals", "offsets", "children", "leaves", "rows"]).reset_index(names="tree")


def fitted(rows: DataFrame, total: int, settings: Settings) -> list[Tree]:
    """The trees, fitted by a task on the rows with the smallest hashes; the driver gets the trees and no rows.

    A bound on the hash leaves few more rows than the sample takes, so that tasks do not hand on a sample each.
    """
    depth = max(math.ceil(math.log2(max(1, total / settings.leaf))), min(5, int(math.log2(max(1, total / 8)))))
    hashed = rows.select(F.xxhash64("id").alias("hash"), "id", "vector")
    wanted = min(settings.sample, total)
    below = (wanted + 10 * math.sqrt(wanted)) / total
    # Should ever fewer hashes than wanted lie below the bound, all rows are put in order.
    for near in ([hashed.where(F.col("hash") < int(below * 2**64) - 2**63)] if below < 1 else []) + [hashed]:
        sample = near.orderBy("hash", "id").limit(settings.sample).coalesce(1)
        schema = "tree int, normals binary, offsets binary, children binary, leaves int, rows int"
        found = sample.mapInPandas(functools.partial(_grown, settings, depth), schema).collect()
        if found and found[0]["rows"] == wanted:
            break
    trees = []
    for r in sorted(found, key=lambda r: r["tree"]):
        offsets = np.frombuffer(r["offsets"])
        normals, children = np.frombuffer(r["normals"]).reshape(len(offsets), -1), np.frombuffer(r["children"], dtype=np.int64).reshape(-1, 2)
        trees.append(Tree(normals, offsets, children, r["leaves"]))
    return trees


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector, level by level."""
    at = np.zeros(len(vectors), dtype=np.int64)
    while (at >= 0).any():
        live = np.flatnonzero(at >= 0)
        node = at[live]
        right = np.einsum("ij,ij->i", vectors[live], tree.normals[node]) > tree.offsets[node]
        at[live] = tree.children[node, right.astype(np.int64)]
    return -1 - at


def visit(trees: list[Tree], sizes: list[np.ndarray], vector: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Leaves `(tree, leaf)` in the order of one queue over all trees, until they hold `wanted` rows.

    The queue holds cells by the largest distance to a plane that separates them from the query: nearest cells first.
    """
    margins = [t.normals @ vector - t.offsets for t in trees]
    queue = [(0.0, t, 0) for t in range(len(trees))]
    found, held = [], 0
    while queue and held < wanted:
        far, t, node = heapq.heappop(queue)
        while node >= 0:
            margin = margins[t][node]
            near, other = trees[t].children[node] if margin <= 0 else trees[t].children[node][::-1]
            heapq.heappush(queue, (max(far, abs(margin)), t, int(other)))
            node = int(near)
        leaf = -1 - node
        found.append((t, leaf))
        held += int(sizes[t][leaf])
    return found


def usable(vector: Column) -> Column:
    """Vectors with numbers only, and not all zero."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & fine & F.exists(numbers, lambda x: x != 0), F.lit(False))


def _units(vectors) -> np.ndarray:
    """Rows scaled to length 1 for the search; the largest component first, so that no square over- or underflows."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _blocks(trees: Broadcast, settings: Settings, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each leaf in blocks; a block holds its vectors as one array of bytes."""
    for batch in batches:
        if not len(batch):
            continue
        units = _units(batch["vector"])
        small = units.astype(np.float32)
        ids = batch["id"].to_numpy(dtype=np.int64)
        for t, tree in enumerate(trees.value):
            leaves = leaves_of(tree, units)
            order = np.argsort(leaves, kind="stable")
            ends = np.flatnonzero(np.diff(leaves[order])) + 1
            made = []
            for rows in np.split(order, ends):
                for k in range(0, len(rows), settings.block):
                    part = rows[k : k + settings.block]
                    made.append((t, int(leaves[part[0]]), len(part), ids[part].tobytes(), small[part].tobytes()))
            yield pd.DataFrame(made, columns=BLOCK)


def _full(settings: Settings, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks that follow one another in a leaf as blocks of at least `block` vectors, all but the last of a leaf."""
    place, ids, vectors, size = None, [], [], 0

    def block() -> list[tuple]:
        return [(*place, size, b"".join(ids), b"".join(vectors))] if size else []

    for batch in batches:
        made = []
        for t, leaf, n, some, values in zip(*(batch[c] for c in BLOCK)):
            if (t, leaf) != place or size >= settings.block:
                made += block()
                place, ids, vectors, size = (t, leaf), [], [], 0
            ids.append(some)
            vectors.append(values)
            size += n
        yield pd.DataFrame(made, columns=BLOCK)
    yield pd.DataFrame(block(), columns=BLOCK)


def _visits(
    trees: Broadcast, sizes: Broadcast, wanted: int, settings: Settings, batches: Iterator[pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """The queries of each leaf they visit, in blocks."""
    for batch in batches:
        if not len(batch):
            continue
        units = _units(batch["vector"])
        small = units.astype(np.float32)
        ids = batch["id"].to_numpy(dtype=np.int64)
        # A query visits many leaves and is repeated for each: a few queries at a time keep the batches small.
        for at in range(0, len(units), settings.queries):
            by_leaf: dict[tuple[int, int], list[int]] = {}
            for row in range(at, min(at + settings.queries, len(units))):
                for place in visit(trees.value, sizes.value, units[row], wanted):
                    by_leaf.setdefault(place, []).append(row)
            made = [(t, leaf, ids[rows].tobytes(), small[rows].tobytes()) for (t, leaf), rows in by_leaf.items()]
            yield pd.DataFrame(made, columns=["tree", "leaf", "q_ids", "q_vectors"])


def _merged(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The best `k` rows of each query among candidates, and those that tie with the last of them."""
    rows = pd.concat(found).groupby(["query_id", "vec_id"], as_index=False)["near"].max()
    rows = rows.sort_values(["query_id", "near"], ascending=[True, False])
    last = rows[rows.groupby("query_id").cumcount() == k - 1].set_index("query_id")["near"]
    least = rows["query_id"].map(last)
    return rows[least.isna() | (rows["near"] >= least - SLACK)]


def _best(k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best rows for each query among the blocks of a task, merged whenever `MERGED` candidates have come."""
    found: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        for ids, vectors, q_ids, q_vectors in zip(batch["ids"], batch["vectors"], batch["q_ids"], batch["q_vectors"]):
            own, asked = np.frombuffer(ids, dtype=np.int64), np.frombuffer(b"".join(q_ids), dtype=np.int64)
            x = np.frombuffer(vectors, dtype=np.float32).reshape(len(own), -1)
            q = np.frombuffer(b"".join(q_vectors), dtype=np.float32).reshape(len(asked), -1)
            near = q @ x.T
            near[asked[:, None] == own[None, :]] = -np.inf
            last = np.partition(near, max(0, len(own) - k), axis=1)[:, max(0, len(own) - k)]
            # Rounding of the product must not decide; candidates are scored exactly afterwards.
            row, column = np.nonzero((near >= last[:, None] - SLACK) & (near > -np.inf))
            found.append(pd.DataFrame({"query_id": asked[row], "vec_id": own[column], "near": near[row, column].astype(np.float64)}))
            size += len(row)
            if size > MERGED:
                found = [_merged(found, k)]
                size = len(found[0])
                if size > MERGED // 2:  # very many queries: hand on what there is
                    yield found.pop()
                    size = 0
    if found:
        yield _merged(found, k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, added up in their order."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` rows of `vectors` with the largest cosine found for each row of `queries`.

    Trees are fitted on a bounded sample of the rows; all rows are then dealt to the leaves of every tree. Queries
    and rows of a leaf meet in blocks, so a leaf with very many rows becomes many small tasks. The nearest of each
    block are merged and scored in double precision on the original vectors; ties go to the smaller id.

    A row is no candidate of a query with its own id. Vectors that are null, zero, or hold null or non-finite numbers
    take no part, neither do rows without an id; vectors of another length than a query's are no candidates. Rows that
    repeat an id count once, with the vector that comes first in order. Fewer candidates than `k` give fewer rows;
    no queries or no vectors give none. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("_v")).where(usable(F.col("_v")))
        rows = rows.where("id is not null").select("id", F.transform("_v", lambda x: x.cast("double")).alias("vector"))
        return rows.groupBy("id").agg(F.min("vector").alias("vector"))

    rows, asked = materialise(spark, clean(vectors), "vectors"), materialise(spark, clean(queries), "queries")
    # Of equal vectors only the smallest ids can be among a query's nearest, one more than k if its own is one of them.
    copies = Window.partitionBy("vector").orderBy("id")
    rows = materialise(spark, rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "distinct")
    # Vectors of each length make a forest of their own; there is one length as a rule.
    lengths = [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        found = found.union(_search(rows.where(F.size("vector") == n), asked.where(F.size("vector") == n), k, settings))
    return found


def _search(rows: DataFrame, asked: DataFrame, k: int, settings: Settings) -> DataFrame:
    spark = rows.sparkSession
    total = rows.count()
    trees = fitted(rows, total, settings)
    planes = spark.sparkContext.broadcast(trees)
    schema = "tree int, leaf int, size int, ids binary, vectors binary"
    blocks = rows.mapInPandas(functools.partial(_blocks, planes, settings), schema)
    # A batch has few rows of each leaf. Their queries come along with every block, so blocks are filled up first.
    blocks = blocks.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf")
    blocks = materialise(spark, blocks.mapInPandas(functools.partial(_full, settings), schema), "blocks")
    sizes = [np.zeros(t.leaves, dtype=np.int64) for t in trees]
    for t, leaf, size in blocks.groupBy("tree", "leaf").agg(F.sum("size")).collect():  # a row for each leaf of the sample's trees
        sizes[t][leaf] = size
    wanted = math.ceil(settings.share * total)
    held = spark.sparkContext.broadcast(sizes)
    count = asked.count()
    # Few files hold the queries, each of which makes a row for every leaf it visits.
    spread = asked.repartition(math.ceil(count / settings.apart) or 1, "id")
    visits = spread.mapInPandas(functools.partial(_visits, planes, held, wanted, settings), "tree int, leaf int, q_ids binary, q_vectors binary")
    # A leaf's queries meet its rows together, in parts of about `together` queries however many there are.
    parts = math.ceil(count / settings.together) or 1
    part = F.pmod(F.xxhash64("q_ids"), F.lit(parts))
    visits = visits.groupBy("tree", "leaf", part.alias("part")).agg(F.collect_list(F.struct("q_ids", "q_vectors")).alias("asked")).select(
        "tree", "leaf", F.transform("asked", lambda a: a["q_ids"]).alias("q_ids"), F.transform("asked", lambda a: a["q_vectors"]).alias("q_vectors")
    )
    # A query is repeated for each leaf, which the planner does not see: by its estimate it would send all visits to the driver.
    near = blocks.join(visits.hint("merge"), ["tree", "leaf"]).select("ids", "vectors", "q_ids", "q_vectors")
    near = near.mapInPandas(functools.partial(_best, k), "query_id long, vec_id long, near double")
    # A row is found in several trees; its product may differ there in the last digits.
    near = near.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    last = Window.partitionBy("query_id").orderBy(F.desc("near"))
    near = near.withColumn("kth", F.nth_value("near", k).over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    near = near.where(F.col("kth").isNull() | (F.col("near") >= F.col("kth") - SLACK)).select("query_id", "vec_id")
    scored = (
        near.join(asked.toDF("query_id", "q"), "query_id")
        .join(rows.toDF("vec_id", "v"), "vec_id")
        .select("query_id", "vec_id", cosine(F.col("q"), F.col("v")).alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
