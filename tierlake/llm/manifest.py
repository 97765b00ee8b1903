"""Merkle manifest of a dataset by a nested-struct rollup.

Every row becomes a leaf, the leaves of a group form a tree with runs of eight, and the groups' roots form one more tree.
A row's rank in its group, written in base eight, is its path. Within a block of 512 consecutive leaves the last digit is
grouped away first: the nodes of a run become an array of child structs inside their parent. Two more digits make one
nested row of the block, which knows all hashes below it. A transform down the nested structs then gives each node its
way up (what stands to its left and to its right in each run), and an explode turns it into rows: no join inside a block.

Blocks are bounded, so no group or row grows with the data. The block hashes are the leaves of the next, 512 times
smaller round of the same rollup; what lies above a block comes down to it by its number, one row for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.session import materialise

#: Nodes in a run, and digits that are grouped away in a block.
FAN = 8
DIGITS = 3
BLOCK = FAN**DIGITS
_LOCAL = (1 << 33) - 1


@dataclass(frozen=True)
class Columns:
    """The columns of a leaf in their order, the group, and the column that leaves ascend by."""

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    order: str = "doc_id"
    text: str = "text"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """The digest of fields, each `-` if null, else its length in UTF-8 bytes, a colon and the value."""

    def written(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(*map(written, fields))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaves(docs: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """`doc_id, grp, leaf, altered` for every row.

    `altered` is the leaf of the row with its text lower-cased in A-Z where 3 divides the unsigned crc32 of the decimal
    id, and null elsewhere, rows without an id included.
    """
    fields = [F.col(c) for c in columns.fields]
    tampered = [lowered(F.col(c)) if c == columns.text else F.col(c) for c in columns.fields]
    number = F.col(columns.order).cast("long")
    chosen = F.crc32(number.cast("string").cast("binary")) % 3 == 0
    return docs.select(
        number.alias("doc_id"),
        F.col(columns.group).cast("string").alias("grp"),
        leaf_hash(fields).alias("leaf"),
        F.when(chosen, leaf_hash(tampered)).alias("altered"),
    )


def with_rank(rows: DataFrame, order: list[str], label: str, group: str | None = "grp") -> tuple[DataFrame, DataFrame]:
    """Rows with their rank in their group, and the size of each group.

    Rows are dealt out by ranges, so that neither a large group nor a value that repeats is one task, and numbered where
    they lie; the ranks follow from the counts of the groups in each partition, one row each.
    """
    spark = rows.sparkSession
    keys = [group] if group else []
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie")
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(_LOCAL))
    placed = materialise(spark, placed, label)
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part")
    starts = counts.select(
        *[F.col(k).alias("_grp") for k in keys],
        F.col("_part").alias("_p"),
        (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_start"),
    )
    same = F.col("_part") == F.col("_p")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_grp"))
    ranked = placed.join(starts, same).withColumn("rank", F.col("_at") + F.col("_start"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("size"))
    return ranked.drop("_at", "_part", "_p", "_start", "_grp"), sizes


def _nodes_at(level: int) -> Column:
    """How many nodes a group of `size` nodes has after so many levels."""
    return F.ceil(F.col("size") / F.lit(float(FAN**level))).cast("long")


def blocks(nodes: DataFrame) -> DataFrame:
    """`grp, size, block, hash, tree`: digits of `rank` grouped away, child structs nested within their parents.

    `nodes` has `grp, size, rank, hash` and `carried`. A level that would only repeat a group's one last node keeps its
    hash. `tree` is an array of structs `at, hash, below`, three deep; the lowest has `carried` in place of `below`.
    """
    rows = nodes.select("grp", "size", F.col("rank").alias("at"), "hash", F.col("carried").alias("below"))
    for level in range(DIGITS):
        child = F.struct(F.pmod("at", F.lit(FAN)).cast("int").alias("at"), "hash", "below")
        run = rows.groupBy("grp", "size", F.floor(F.col("at") / FAN).alias("at")).agg(F.collect_list(child).alias("below"))
        run = run.withColumn("below", F.array_sort("below", lambda a, b: a["at"] - b["at"]))
        hashes = F.transform("below", lambda c: c["hash"])
        rows = run.withColumn(
            "hash",
            F.when(_nodes_at(level) > 1, F.sha2(F.array_join(hashes, ""), 256)).otherwise(F.element_at(hashes, 1)),
        )
    return rows.select("grp", "size", F.col("at").alias("block"), "hash", F.col("below").alias("tree"))


def _step(run: Column, index: Column) -> Column:
    """What stands left and right of a node in its run."""
    hashes = F.transform(run, lambda c: c["hash"])
    return F.struct(
        F.array_join(F.slice(hashes, F.lit(1), index), "").alias("left"),
        F.array_join(F.slice(hashes, index + 2, F.lit(FAN)), "").alias("right"),
    )


def ways(trees: DataFrame) -> DataFrame:
    """`grp, size, rank, hash, carried, way`: the nodes of nested blocks with their way to the top, lowest run first.

    `trees` are blocks with `way`, the way from the block up.
    """

    def down(run: Column, way: Column, level: int) -> Column:
        """Each lowest node of a run with its way, in one flat array."""
        applies = _nodes_at(level) > 1

        def of(node: Column, index: Column) -> Column:
            here = F.when(applies, F.concat(F.array(_step(run, index)), way)).otherwise(way)
            if level == 0:
                return F.array(F.struct(node["at"].alias("at"), node["hash"].alias("hash"), node["below"].alias("carried"), here.alias("way")))
            lower = down(node["below"], here, level - 1)
            return F.transform(
                lower,
                lambda n: F.struct(
                    (node["at"] * FAN**level + n["at"]).alias("at"), n["hash"].alias("hash"), n["carried"].alias("carried"), n["way"].alias("way")
                ),
            )

        return F.flatten(F.transform(run, of))

    nodes = F.explode(down(F.col("tree"), F.col("way"), DIGITS - 1))
    return trees.select("grp", "size", "block", nodes.alias("node")).select(
        "grp",
        "size",
        (F.col("block") * BLOCK + F.col("node.at")).alias("rank"),
        F.col("node.hash").alias("hash"),
        F.col("node.carried").alias("carried"),
        F.col("node.way").alias("way"),
    )


def climb(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nested blocks up to one block a group, and `grp, hash` of each group's root.

    The number of rounds grows with the logarithm of the largest group in base 512.
    """
    spark = nodes.sparkSession
    rounds, rows = [], nodes
    while True:
        made = materialise(spark, blocks(rows), label)
        rounds.append(made)
        if (made.agg(F.max("block")).first()[0] or 0) == 0:
            return rounds, made.select("grp", "hash")
        size = F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("long")
        rows = made.select(
            "grp", size.alias("size"), F.col("block").alias("rank"), "hash", F.lit(None).cast("string").alias("carried")
        )


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest nodes with their whole way; `top` has `grp` and `way` for the part above each group's root."""
    named = top.select(F.col("grp").alias("_grp"), F.col("way"))
    rows = rounds[-1].join(named, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
    for made in reversed(rounds[:-1]):
        above = ways(rows).select(F.col("grp").alias("_grp"), F.col("rank").alias("_block"), "way")
        same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block"))
        rows = made.join(above, same).drop("_grp", "_block")
    return ways(rows)


def folded(leaf: Column, way: Column) -> Column:
    """The root that follows from a leaf and its way up."""
    return F.aggregate(way, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(docs: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root, verified` for every row of `docs`.

    Within a group leaves ascend by id, rows without an id first, equal ids by their leaf; rows that are equal in all
    fields are interchangeable. Runs of eight nodes become the digest of their hashes until one is left, the `subroot`.
    The subroots, by the bytes of the group's name with null first, give the `root` in the same way. `proof_sha256` is
    the digest of all hashes beside a leaf's way. `folded_root` is computed up that way from the leaf, or from the leaf
    of the tampered row; `verified` says whether it equals the root.

    Null and empty texts are leaves of their own kinds (`-` and `0:`). A null group is a group. Texts of any length are
    hashed whole and not moved. Other columns are ignored. An empty table gives no rows.
    """
    carried = F.struct("doc_id", "altered")
    ranked, sizes = with_rank(leaves(docs, columns), ["doc_id", "leaf"], "leaves")
    sized = ranked.join(sizes.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
    rounds, subroots = climb(sized.select("grp", "size", "rank", F.col("leaf").alias("hash"), carried.alias("carried")), "blocks")

    # The groups' roots are the leaves of one more tree, of a single group.
    tops, groups = with_rank(subroots, ["grp"], "subroots", group=None)
    tops = tops.select(
        F.lit("").alias("grp"),
        F.lit(groups.first()["size"] or 0).cast("long").alias("size"),
        "rank",
        "hash",
        F.struct(F.col("grp").alias("name")).alias("carried"),
    )
    upper, root = climb(tops, "tops")
    whole = root.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("way"))
    named = descend(upper, whole).select(F.col("carried.name").alias("grp"), F.col("hash").alias("subroot"), "way")
    named = named.withColumn("root", folded(F.col("subroot"), F.col("way")))

    found = descend(rounds, named.select("grp", "way"))
    roots = named.select(F.col("grp").alias("_grp"), "subroot", "root")
    found = found.join(roots, F.col("grp").eqNullSafe(F.col("_grp")))
    beside = F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), "")
    start = F.coalesce(F.col("carried.altered"), F.col("hash"))
    return found.select(
        F.col("carried.doc_id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(beside, 256).alias("proof_sha256"),
        folded(start, F.col("way")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
