"""URL filters: reversed-host keys make prefix rules intervals, and a sorted sweep keeps a stack of nested rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the urls of one host suffix are dealt; each part is swept beside its own copy of the rules.
PARTS = 64


def host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without one."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    """Host labels in reverse order, each closed by a dot, so that a suffix of the host is a prefix of the key."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """For every rule the nested rules that are open where it begins, shortest first, itself last.

    Rules of one host nest: one interval holds another exactly if its path is a prefix of the other's.
    """
    inner = rules.select("key", F.col("path").alias("inner"))
    prefixes = inner.withColumn(
        "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("inner")), lambda n: F.col("inner").substr(F.lit(1), n)))
    )
    nested = prefixes.join(rules, ["key", "path"]).select(
        "key", "inner", F.struct(F.length("path").alias("n"), "path", "rule", "verdict").alias("open")
    )
    return nested.groupBy("key", F.col("inner").alias("path")).agg(F.array_sort(F.collect_list("open")).alias("stack"))


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int = PARTS, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """`page_id, host, path, rule, verdict` for every row of `pages`.

    `rules` has `host`, `path` and `verdict`. A rule fits a url of its host or of a subdomain whose path starts with
    the rule's. The longest fitting rule wins: the longer host, then the longer path; `default` is the verdict where
    none fits, and `rule` (host and path of the winner) is null there.

    A url's host is cut after each number of labels that a rule has. Each of these suffixes, reversed, is a key under
    which the rules' paths are intervals in sorted order. Rules and urls of a key are sorted together; a url takes the
    stack of the last rule before it and keeps the innermost interval that still holds it. Urls of one key are dealt to
    `parts` parts, so that a host or a top-level domain with a third of all urls is swept in many tasks.

    Null urls and those without `://` have an empty host and path and no rule unless one has an empty host. Rows that
    repeat, also in their id, or have no id are judged each. Rules that repeat a host and path count once, `block`
    before `allow`; rules with a null host, path or verdict don't count. Other columns are ignored. With no rules
    every verdict is `default`; an empty table gives no rows.
    """
    known = rules.where("host is not null and path is not null and verdict is not null")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("labels", F.split("host", "\\."))
    known = known.select(
        _reversed(F.col("labels")).alias("key"),
        "path",
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size("labels").alias("depth"),
    )
    stacks = _stacks(known).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # The rules' numbers of labels: as many numbers as a host may have labels.
    depths = [r["depth"] for r in known.select("depth").distinct().orderBy("depth").collect()]
    rows = pages.select(
        F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")
    ).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", "\\.")
    # Depth 0 has no rules: it keeps the urls that no rule fits.
    cut = (
        rows.withColumn("labels", labels)
        .withColumn("depth", F.explode(F.filter(F.array(F.lit(0), *map(F.lit, depths)), lambda d: d <= F.size("labels"))))
        .select(
            "row",
            "page_id",
            "host",
            "path",
            F.when(F.col("depth") > 0, _reversed(F.slice("labels", -F.col("depth"), F.col("depth")))).alias("key"),
            F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"),
            F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
        )
    )
    openings = stacks.select(
        F.lit(None).cast("long").alias("row"),
        F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"),
        F.lit(None).cast("string").alias("host"),
        "path",
        "key",
        "part",
        "stack",
    )
    # A rule comes before the urls that begin where it does.
    sweep = Window.partitionBy("key", "part").orderBy("path", F.col("row").isNotNull())
    swept = cut.union(openings).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("row is not null")
    inside = F.filter("open", lambda r: F.col("path").startswith(r["path"]))
    innermost = F.when(F.size(inside) > 0, F.element_at(inside, -1))
    fitting = swept.withColumn("fit", innermost).select(
        "row", "page_id", "host", "path", F.when(F.col("fit").isNotNull(), F.struct(F.length("key").alias("k"), "fit")).alias("fit")
    )
    won = fitting.groupBy("row", "page_id", "host", "path").agg(F.max("fit").alias("fit"))
    return won.select(
        "page_id",
        "host",
        "path",
        F.col("fit.fit.rule").alias("rule"),
        F.coalesce(F.col("fit.fit.verdict"), F.lit(default)).alias("verdict"),
    )
