"""A stored inverted index of hierarchical tags, of which a query reads the asked tags only.

Targets are numbered; 32768 of them make a block. `members` holds the targets with their block and bit, `postings` a
bitmap for each tag, or prefix of one, and block in which it occurs. Both lie in folders by hash, of the tag and of the
block. Tags are intersected and united block by block on bitmaps of at most 4 KB, so a tag that all targets carry is no
large group; the targets are then read from the folders of the blocks that have an answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.operators.tags import TARGET, tag_index

FOLDERS = 64
POSTINGS = "tag string, block bigint, bits binary, folder int"


def _folder(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(FOLDERS)).cast("int")


def _write(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows by folder, of which the adaptive plan splits large ones; in order, so that readers can skip row groups."""
    ordered = rows.hint("rebalance", "folder").sortWithinPartitions("folder", *order)
    ordered.write.mode("overwrite").partitionBy("folder").parquet(path)


def write_tag_index(targets: DataFrame, root: str) -> None:
    """Replace the index at `root` by one of these targets (namespace, name, tags); repeated rows stay apart."""
    spark = targets.sparkSession
    number = F.monotonically_increasing_id() + 1
    numbered = targets.select(*TARGET, "tags", number.alias("_n")).select(
        F.bitmap_bucket_number("_n").alias("block"), F.bitmap_bit_position("_n").alias("bit"), *TARGET, "tags"
    )
    # The numbers are written before they are used, so that a task that runs again cannot change them.
    _write(numbered.withColumn("folder", _folder(F.col("block"))), f"{root}/members", ["block", "bit"])
    members = _members(spark, root)
    postings = tag_index(members, "block", "bit").groupBy("tag", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    _write(postings.withColumn("folder", _folder(F.col("tag"))), f"{root}/postings", ["tag", "block"])


def _members(spark: SparkSession, root: str) -> DataFrame:
    schema = "block bigint, bit bigint, namespace string, name string, tags array<string>, folder int"
    return spark.read.schema(schema).parquet(f"{root}/members")


def _postings(spark: SparkSession, root: str, tags: list[str]) -> DataFrame:
    """The bitmaps of some tags; the filter on the folder prunes files, the one on the tag reaches the reader."""
    here = reduce(lambda a, b: a | b, [F.col("folder") == _folder(F.lit(t)) for t in tags], F.lit(False))
    return spark.read.schema(POSTINGS).parquet(f"{root}/postings").where(here & F.col("tag").isin(tags))


def _targets(spark: SparkSession, root: str, blocks: DataFrame) -> DataFrame:
    """The targets whose bits are set in `block, bits`."""
    blocks = blocks.where(F.bitmap_count("bits") > 0)
    # At most FOLDERS numbers.
    folders = blocks.agg(F.collect_set(_folder(F.col("block"))).alias("folders")).scalar()
    members = _members(spark, root).where(F.array_contains(folders, F.col("folder")))
    byte = F.col("bits").substr((F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("bit") % 8).cast("int")) == 1
    return members.join(blocks, "block").where(is_set).select(*TARGET)


def with_tag(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """Targets (namespace, name) that carry a tag or a child of it."""
    return with_any_tag(spark, root, [tag])


def with_any_tag(spark: SparkSession, root: str, tags: list[str]) -> DataFrame:
    """Targets that carry at least one of the tags; no tags match nothing."""
    found = _postings(spark, root, tags).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return _targets(spark, root, found)


def with_all_tags(spark: SparkSession, root: str, tags: list[str]) -> DataFrame:
    """Targets that carry all of the tags; no tags match nothing.

    Blocks in which the rarest tag does not occur lack one of the bitmaps and go before any target is read.
    """
    wanted = sorted(set(tags))
    found = _postings(spark, root, wanted).groupBy("block").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_tags")
    )
    return _targets(spark, root, found.where(F.col("_tags") == len(wanted)).drop("_tags"))
