"""Connected components by alternating stars, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.session import remove_path, scratch_path


def _write(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(spark, "edges")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, component` (the smallest node it reaches) for every node of an undirected link table.

    Rounds of large and small stars until nothing changes; every round is written to the shared folder, which cuts
    the lineage and survives lost executors. All state stays in tables: the driver sees a count and a checksum. Nodes
    with very many links meet the joins as skewed keys, which Spark splits. Rows with a null end and loops don't count.
    """
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, path = _write(spark, edges)
    before = _state(edges)
    while before[0]:
        edges, new_path = _write(spark, _small_star(_large_star(edges)))
        remove_path(spark, path)
        path, now = new_path, _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
