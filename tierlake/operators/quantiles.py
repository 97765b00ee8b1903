"""Exact and approximate quantiles per group."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.functions.sketch import ALPHA, bin_code, bin_value, finite, sketch_quantile
from tierlake.session import materialise

# Equal intervals into which a bin that holds a wanted rank is cut.
PARTS = 4096
# Groups of at most so many rows are put in order whole, each within one task.
SMALL_GROUP = 100_000
QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class Measure:
    """An aggregate that rides along: over the rows first, which it reads these columns of, then combined step by step."""

    name: str
    of_rows: Column
    combine: Callable[[str], Column]
    reads: tuple[str, ...] = ()


def percentiles_exact(
    df: DataFrame,
    keys: list[str],
    col: str,
    quantiles: dict[str, float] = QUANTILES,
    measures: Sequence[Measure] = (),
) -> DataFrame:
    """Interpolated quantiles of the finite values of each group, and other measures of it.

    The rows are read once: what of them is needed is written below the shared
    folder, and so are the counts of larger groups, since several steps need
    them.  Rows are counted by a hash of their keys; groups of up to
    SMALL_GROUP rows then move once and are put in order whole, others go
    through `_of_large_groups`.  The result reads these files.
    """
    spark = df.sparkSession
    columns = dict.fromkeys([*keys, col, *[c for m in measures for c in m.reads]])
    rows = materialise(spark, df.where(finite(F.col(col).cast("double"))).select(*columns), "rows")
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    sizes = rows.groupBy(group.alias("_group")).agg(F.count("*").alias("_rows"))
    large = materialise(spark, sizes.where(F.col("_rows") > SMALL_GROUP).select("_group"), "large")
    if large.isEmpty():
        return _of_small_groups(rows, keys, col, quantiles, measures)
    marked = rows.withColumn("_group", group)
    small = marked.join(large, "_group", "left_anti").drop("_group")
    others = marked.join(large, "_group", "left_semi").drop("_group")
    of_large = _of_large_groups(others, keys, col, quantiles, measures)
    return _of_small_groups(small, keys, col, quantiles, measures).unionByName(of_large)


def _of_small_groups(
    rows: DataFrame, keys: list[str], col: str, quantiles: dict[str, float], measures: Sequence[Measure]
) -> DataFrame:
    """Quantiles and measures of groups whose rows one task can put in order: they are shuffled once, by their keys."""
    valued = rows.withColumn("_v", F.col(col).cast("double"))
    whole = Window.partitionBy(*keys)
    ordered = valued.withColumns(
        {"_place": F.row_number().over(whole.orderBy("_v")) - 1, "_total": F.count("*").over(whole)}
    )
    names = [m.name for m in measures]
    found = ordered.groupBy(*keys).agg(
        *[m.of_rows.alias(f"_m_{m.name}") for m in measures],
        F.max("_total").alias("_total"),
        *[
            F.max(F.when(F.col("_place") == end(_position(q)), F.col("_v"))).alias(f"_{name}_{i}")
            for name, q in quantiles.items()
            for i, end in enumerate((F.floor, F.ceil))
        ],
    )
    return _interpolated(found.withColumnsRenamed({f"_m_{n}": n for n in names}), keys, names, quantiles)


def _interpolated(found: DataFrame, keys: list[str], names: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles between the values at the two places beside each."""
    return found.select(
        *keys,
        *names,
        *[
            (F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * (_position(q) - F.floor(_position(q)))).alias(n)
            for n, q in quantiles.items()
        ],
    )


def _of_large_groups(
    df: DataFrame, keys: list[str], col: str, quantiles: dict[str, float], measures: Sequence[Measure]
) -> DataFrame:
    """Quantiles and measures of groups of any size.

    Equal values are counted before the shuffle.  The counts are summed by
    relative-error bin, of which a group has a bounded number; the running
    count over the bins tells which bins hold the wanted ranks.  A group of
    nearly equal values may have all of them in one bin, so each such bin is
    cut into PARTS equal intervals between its ends and searched again; only
    the values of the intervals that hold a wanted rank are put in order.
    """
    spark, names = df.sparkSession, [m.name for m in measures]
    counted = (
        df.groupBy(*keys, F.col(col).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"), *[m.of_rows.alias(m.name) for m in measures])
        .withColumn("_bin", bin_code(F.col("_v"), 0.001))
    )
    counts = materialise(spark, counted, "counts")
    per_bin = counts.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_bn"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        *[m.combine(m.name).alias(m.name) for m in measures],
    )
    by_bin, whole = Window.partitionBy(*keys).orderBy("_bin"), Window.partitionBy(*keys)
    placed = per_bin.select(
        *keys,
        "_bin",
        "_low",
        "_high",
        (F.sum("_bn").over(by_bin) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(by_bin).alias("_upto"),
        F.sum("_bn").over(whole).alias("_total"),
        *[m.combine(m.name).over(whole).alias(m.name) for m in measures],
    )
    ends = {q: (F.floor(_position(q)), F.ceil(_position(q))) for q in quantiles.values()}

    def holding(rows: DataFrame) -> DataFrame:
        held = [(rank >= F.col("_before")) & (rank < F.col("_upto")) for pair in ends.values() for rank in pair]
        return rows.where(reduce(lambda x, y: x | y, held)).drop("_upto")

    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width * PARTS), F.lit(PARTS - 1))).otherwise(0)
    held = _join(counts.drop(*names), holding(placed), [*keys, "_bin"]).withColumn("_part", part).drop("_low", "_high")
    inner = materialise(spark, held, "held")
    per_part = inner.groupBy(*keys, "_bin", "_part").agg(
        F.sum("_n").alias("_pn"), F.max("_before").alias("_before"), F.max("_total").alias("_total")
    )
    upto = F.col("_before") + F.sum("_pn").over(Window.partitionBy(*keys, "_bin").orderBy("_part"))
    within = per_part.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_pn"))
    by_value = Window.partitionBy(*keys, "_bin", "_part").orderBy("_v")
    parts = [*keys, "_bin", "_part"]
    ordered = _join(inner.drop("_before"), holding(within).select(*parts, "_before"), parts).withColumn("_last", F.col("_before") + F.sum("_n").over(by_value))

    def value_at(rank: Column) -> Column:
        inside = (rank >= F.col("_last") - F.col("_n")) & (rank < F.col("_last"))
        return F.max(F.when(inside, F.col("_v")))

    # Total and measures are the same on every row of a group by now.
    found = ordered.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[F.max(n).alias(n) for n in names],
        *[value_at(rank).alias(f"_{name}_{i}") for name, q in quantiles.items() for i, rank in enumerate(ends[q])],
    )
    return _interpolated(found, keys, names, quantiles)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    others = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), reduce(lambda x, y: x & y, same)).select("l.*", *others)


def _position(q: float) -> Column:
    """Place of a quantile among the ordered values, counted from zero."""
    return (F.col("_total") - 1) * F.lit(float(q))


def percentiles_approx(
    df: DataFrame, keys: list[str], col: str, accuracy: int = 10_000, quantiles: dict[str, float] = QUANTILES
) -> DataFrame:
    """Approximate quantiles with Spark's bounded summary."""
    found = df.groupBy(*keys).agg(
        F.percentile_approx(col, list(quantiles.values()), accuracy).alias("_p")
    )
    return found.select(*keys, *[F.col("_p")[i].alias(name) for i, name in enumerate(quantiles)])


def finish_bins(
    bins: DataFrame,
    keys: list[str],
    measures: Sequence[Column] = (),
    quantiles: dict[str, float] = QUANTILES,
    alpha: float = ALPHA,
) -> DataFrame:
    """One row per group from rows (keys, _bin, _n) with distinct bins: sketch, quantiles and measures.

    A quantile is the first bin whose running count passes the rank.  A group
    has one row per bin here, a number bounded by the value range and alpha.
    """
    in_order = Window.partitionBy(*keys).orderBy("_bin")
    counted = bins.withColumns(
        {"_upto": F.sum("_n").over(in_order), "_total": F.sum("_n").over(Window.partitionBy(*keys))}
    )
    found = {
        name: F.min(F.when(F.col("_upto") > F.floor((F.col("_total") - 1) * F.lit(float(q))), F.col("_bin")))
        for name, q in quantiles.items()
    }
    entries = F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_n")))
    grouped = counted.groupBy(*keys).agg(
        *measures,
        F.map_from_entries(entries).alias("sketch"),
        *[column.alias(name) for name, column in found.items()],
    )
    return grouped.withColumns({name: bin_value(F.col(name), alpha) for name in quantiles})


def relative_sketch(df: DataFrame, keys: list[str], col: str, alpha: float = ALPHA) -> DataFrame:
    """Mergeable sketch of the finite values of each group, a map from relative-error bin to count, and its quantiles.

    Bins are counted first, so a group reaches the second step as one row per
    bin, never as its raw values.
    """
    bins = (
        df.where(finite(F.col(col).cast("double")))
        .groupBy(*keys, bin_code(F.col(col).cast("double"), alpha).alias("_bin"))
        .agg(F.count("*").alias("_n"))
    )
    return finish_bins(bins, keys, alpha=alpha)


def merge_sketches(df: DataFrame, keys: list[str], col: str = "sketch", alpha: float = ALPHA) -> DataFrame:
    """Sum sketches bin by bin into coarser groups."""
    bins = (
        df.select(*keys, F.explode(col).alias("_bin", "_count"))
        .groupBy(*keys, "_bin")
        .agg(F.sum("_count").alias("_n"))
    )
    return finish_bins(bins, keys, alpha=alpha)


def sketch_quantiles(
    df: DataFrame, quantiles: dict[str, float], alpha: float = ALPHA, col: str = "sketch"
) -> DataFrame:
    """Add any quantiles of stored sketches, each within alpha of the exact order statistic."""
    return df.withColumns({name: sketch_quantile(F.col(col), q, alpha) for name, q in quantiles.items()})


def percentiles_relative(df: DataFrame, keys: list[str], col: str, alpha: float = ALPHA) -> DataFrame:
    return relative_sketch(df, keys, col, alpha)


def kll_sketch(df: DataFrame, keys: list[str], col: str, k: int = 400) -> DataFrame:
    """Mergeable rank-error sketch per group, built while aggregating."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), k).alias("kll"))


def merge_kll(df: DataFrame, keys: list[str], k: int = 400) -> DataFrame:
    return df.groupBy(*keys).agg(F.kll_merge_agg_double("kll", k).alias("kll"))


def kll_quantiles(df: DataFrame, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    return df.withColumns(
        {name: F.kll_sketch_get_quantile_double("kll", F.lit(q)) for name, q in quantiles.items()}
    )


def percentiles_kll(df: DataFrame, keys: list[str], col: str, k: int = 400) -> DataFrame:
    return kll_quantiles(kll_sketch(df, keys, col, k)).drop("kll")


def percentiles_discrete(
    df: DataFrame,
    keys: list[str],
    col: str,
    quantiles: dict[str, float] = QUANTILES,
    accuracy: int = 10_000,
    kll_k: int | None = None,
    margin: float | None = None,
) -> DataFrame:
    """Exact order statistics of the finite values of each group, at the ranks that a summary points to.

    The value of a quantile q is the smallest one that at least q of the group's rows do not exceed.  Spark's bounded
    summary, or a KLL sketch of size kll_k, gives two values around each quantile, `margin` ranks of the group apart from
    it on either side (four times the summary's error, unless given).  Only rows between two such values are counted by
    value; all others are one count for each gap.  A group whose wanted rank falls into a gap is counted whole.
    """
    error = 1 / accuracy if kll_k is None else rank_error_bound(kll_k)
    margin = 4 * error if margin is None else margin
    spark, value = df.sparkSession, F.col(col).cast("double")
    rows = df.where(finite(value)).select(*keys, value.alias("_v"))
    ordered = sorted(quantiles.values())
    points = [max(0.0, q - margin) for q in ordered] + [min(1.0, q + margin) for q in ordered]
    if kll_k is None:
        ends = rows.groupBy(*keys).agg(F.percentile_approx("_v", points, accuracy).alias("_e"))
    else:
        found = [F.kll_sketch_get_quantile_double("kll", F.lit(p)) for p in points]
        ends = kll_sketch(rows, keys, "_v", kll_k).select(*keys, F.array(*found).alias("_e"))
    low, high = F.slice("_e", 1, len(ordered)).alias("_low"), F.slice("_e", len(ordered) + 1, len(ordered)).alias("_high")
    ends = materialise(spark, ends.select(*keys, low, high), "ends")
    found = materialise(spark, _between(rows, keys, ends, quantiles), "discrete")
    missed = reduce(lambda x, y: x | y, [F.col(name).isNull() for name in quantiles])
    lost = found.where(missed).select(
        *keys, F.array(F.lit(-math.inf)).alias("_low"), F.array(F.lit(math.inf)).alias("_high")
    )
    if lost.isEmpty():
        return found
    return found.where(~missed).unionByName(_between(rows, keys, lost, quantiles))


def _between(rows: DataFrame, keys: list[str], ends: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Order statistics that lie between two ends of their group (ascending arrays `_low`, `_high`), null for others."""
    # The gap or interval of a value follows from how many intervals end below it.
    place = F.aggregate("_high", F.lit(0), lambda n, end: n + (end < F.col("_v")).cast("int"))
    placed = _join(rows, ends, keys).withColumn("_place", place)
    inside = F.coalesce(F.col("_v") >= F.get("_low", F.col("_place")), F.lit(False))
    counts = placed.groupBy(*keys, "_place", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    # The rows of a gap come before those of the interval behind it.
    by_value = Window.partitionBy(*keys).orderBy("_place", F.col("_v").asc_nulls_first())
    ranked = counts.withColumns({"_upto": F.sum("_n").over(by_value), "_total": F.sum("_n").over(Window.partitionBy(*keys))})

    def value_at(q: float) -> Column:
        share = Fraction(str(q))
        rank = F.greatest(F.lit(1), F.expr(f"(_total * {share.numerator} + {share.denominator - 1}) div {share.denominator}"))
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_v")))

    return ranked.groupBy(*keys).agg(*[value_at(q).alias(name) for name, q in quantiles.items()])


def rank_error_bound(k: int) -> float:
    """Normalised rank error that a summary of size k keeps with high probability."""
    return 2.296 / math.pow(k, 0.9021)
