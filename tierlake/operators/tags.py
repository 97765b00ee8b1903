"""Hierarchical tags: slash paths that also stand for every prefix of themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.functions.paths import prefixes

TARGET = ["namespace", "name"]


def carries(tags: Column, tag: str) -> Column:
    """Does a tag list hold the tag or a child of it."""
    return F.coalesce(
        F.exists(tags, lambda t: (t == F.lit(tag)) | F.startswith(t, F.lit(tag + "/"))), F.lit(False)
    )


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """Are all wanted tags carried; an empty list matches nothing."""
    return reduce(lambda a, b: a & b, [carries(tags, t) for t in wanted], F.lit(bool(wanted)))


def tag_index(targets: DataFrame, *by: str) -> DataFrame:
    """Every target, or the columns given for it, under every prefix of every tag of it, once.

    The prefixes of one target become distinct inside its row, so no shuffle
    is needed.
    """
    every = F.array_distinct(F.flatten(F.transform("tags", lambda t: prefixes(t, "/"))))
    return targets.select(*(by or TARGET), F.explode(every).alias("tag"))


def tag_query(targets: DataFrame, tag: str) -> DataFrame:
    return targets.where(carries(F.col("tags"), tag)).select(*TARGET)


def tag_query_and(targets: DataFrame, tags: list[str]) -> DataFrame:
    return targets.where(has_tags(F.col("tags"), tags)).select(*TARGET)


def tag_query_or(targets: DataFrame, tags: list[str]) -> DataFrame:
    test = reduce(lambda a, b: a | b, [carries(F.col("tags"), t) for t in tags], F.lit(False))
    return targets.where(test).select(*TARGET)


def has_tag(targets: DataFrame, tag: str) -> DataFrame:
    return targets.select(*TARGET, carries(F.col("tags"), tag).alias("has_tag"))


def tag_counts(targets: DataFrame) -> DataFrame:
    return tag_index(targets).groupBy("tag").agg(F.count("*").alias("targets"))


def tag_children(targets: DataFrame, prefix: str = "") -> DataFrame:
    """Next segments below a prefix (kind dir), and targets tagged exactly there (kind target)."""
    tag = F.explode("tags").alias("tag")
    below = prefix + "/" if prefix else ""
    tags = targets.select(*TARGET, tag)
    segment = F.substring_index(F.substr(F.col("tag"), F.lit(len(below) + 1)), "/", 1)
    dirs = (
        tags.where(F.startswith(F.col("tag"), F.lit(below)))
        .select(segment.alias("name"))
        .where(F.col("name") != "")
        .distinct()
        .select(F.lit("dir").alias("kind"), F.lit("").alias("namespace"), "name")
    )
    here = targets.where(F.array_contains("tags", prefix)).select(F.lit("target").alias("kind"), *TARGET)
    return dirs.unionByName(here)


def one_update(updates: DataFrame, order: str | None = None) -> DataFrame:
    """One row per target: the last by the column order, or an error where there are several and no order."""
    rest = F.struct(*[c for c in updates.columns if c not in TARGET])
    if order is not None:
        return updates.groupBy(*TARGET).agg(F.max_by(rest, order).alias("_u")).select(*TARGET, "_u.*")
    counted = updates.groupBy(*TARGET).agg(F.first(rest).alias("_u"), F.count("*").alias("_n"))
    twice = F.raise_error(F.lit("several updates of one target; name the column that orders them"))
    return counted.select(*TARGET, F.when(F.col("_n") == 1, F.col("_u")).otherwise(twice).alias("_u")).select(*TARGET, "_u.*")


def update_tags(targets: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Apply updates (namespace, name, add, remove, set): set replaces, else remove and then add.

    The result is sorted; empty tags are not added.  Of several updates of one
    target the one that is last by the column order counts; without order they
    are an error.
    """
    none = F.array().cast("array<string>")
    joined = targets.join(one_update(updates, order).select(*TARGET, "add", "remove", "set"), TARGET, "left")
    now = F.coalesce("tags", none)
    change = F.array_union(
        F.array_except(now, F.coalesce("remove", none)),
        F.filter(F.coalesce("add", none), lambda t: t != ""),
    )
    new = F.when(F.size(F.coalesce("set", none)) > 0, F.col("set")).otherwise(change)
    touched = F.col("add").isNotNull() | F.col("remove").isNotNull() | F.col("set").isNotNull()
    return joined.withColumn("tags", F.when(touched, F.array_sort(new)).otherwise(F.col("tags"))).select(targets.columns)
