"""Alert levels with hysteresis on any ratio series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.operators import chunks
from tierlake.schemas import HOUR_MS, LEVELS, SERIES


#: Gives each row of a summary the state that its series has before it.
Enter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LevelRule:
    """Thresholds of the four levels; a level is left downwards only below its threshold minus hysteresis."""

    warning: float = 0.50
    critical: float = 0.80
    emergency: float = 0.95
    hysteresis: float = 0.10

    def __post_init__(self):
        if not self.warning < self.critical < self.emergency or self.hysteresis < 0:
            raise ValueError("thresholds must increase and hysteresis must not be negative")


def _name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in LEVELS]), code + 1)


# Samples with a third of all rows in one series still meet in groups of one slice: a slice is some cooldowns long, and
# at least an hour, so that a series with few samples is not cut into more slices than samples.
SLICE_COOLDOWNS = 16
# Slices whose step functions are composed together, and runs of slices again.
RUN = 64


def step_applied(allowed: np.ndarray, starts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Earliest time of the next evaluation after a slice, from the earliest time allowed before it.

    A slice is a step function: the first sample that may be evaluated is the first of `starts` at or after the allowed
    time, and `after` is the allowed time that this leads to at the slice's end. Beyond all starts nothing changes.
    """
    place = np.searchsorted(starts, allowed, side="left")
    return np.where(place < len(starts), after[np.minimum(place, len(starts) - 1)], allowed)


def _steps(starts: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same step function; of the starts that lead to one time, the last says it all."""
    last = np.append(after[1:] != after[:-1], True)
    return starts[last], after[last]


def _slice_function(times: np.ndarray, cooldown_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a slice with these distinct, ascending times, by pointer doubling.

    Each sample points to the next one at least a cooldown later; pointers are squared until all lead to the last
    sample of their chain. A chain can only begin within a cooldown of the first sample, or with the next one after.
    """
    following = np.searchsorted(times, times + cooldown_ms, side="left")
    end = np.where(following < len(times), following, np.arange(len(times)))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    first = int(following[0]) + 1
    return _steps(times[:first], times[end[:first]] + cooldown_ms)


def _chain(times: np.ndarray, cooldown_ms: int, allowed: int) -> np.ndarray:
    """The samples of a slice that are evaluated, by tables of 2^k jumps."""
    none = len(times)
    jump = np.append(np.searchsorted(times, times + cooldown_ms, side="left"), none)
    taken = np.array([np.searchsorted(times, allowed, side="left")])
    while taken[-1] < none:
        taken = np.concatenate([taken, jump[taken]])
        jump = jump[jump]
    return times[taken[taken < none]]


def cooldown_picks(
    rows: DataFrame, keys: list[str], cooldown_ms: int, carry: DataFrame | None = None, enter: Enter | None = None
) -> DataFrame:
    """`keys, timestamp_ms` of the evaluations: in each series the first sample, and then each first one a cooldown later.

    Series are cut into slices. Each slice becomes a step function, and the functions of RUN slices, and of RUN such
    runs, are composed; a series walks over the outermost runs only, and the entry of each run is handed down to its
    slices, which then follow their own chain. carry has `keys, last_check_ms`; or enter walks over the outermost runs
    (`keys, place, starts, after`) with a state of its own, and returns `keys, place, allowed`. Null keys are keys like
    others; samples without a time are left out.
    """
    width = max(SLICE_COOLDOWNS * cooldown_ms, HOUR_MS)
    types = dict(rows.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in keys)
    function = f"{head}, place bigint, starts array<bigint>, after array<bigint>"
    entry = f"{head}, place bigint, allowed bigint"
    never = np.iinfo(np.int64).min

    def same(pdf: pd.DataFrame, size: int, **values) -> pd.DataFrame:
        """Rows of the series that pdf is of."""
        return pd.DataFrame({**{c: pd.Series([pdf[c].iloc[0]] * size, dtype=object) for c in keys}, **values})

    def nothing(*columns: str) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(dtype=object) for c in [*keys, *columns]})

    def row(pdf: pd.DataFrame, **values) -> pd.DataFrame:
        return same(pdf, 1, **{c: [v] for c, v in values.items()})

    def sliced(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, after = _slice_function(np.unique(pdf["timestamp_ms"].to_numpy()), cooldown_ms)
        return row(pdf, place=pdf["place"].iloc[0], starts=starts, after=after)

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        starts, after = pdf["starts"].iloc[0], pdf["after"].iloc[0]
        for s, a in zip(pdf["starts"].iloc[1:], pdf["after"].iloc[1:]):
            later = s > starts[-1]
            starts, after = _steps(np.concatenate([starts, s[later]]), np.concatenate([step_applied(after, s, a), a[later]]))
        return row(pdf, place=pdf["place"].iloc[0] // RUN, starts=starts, after=after)

    def walked(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        """The entry of each function of a run, from that of the run."""
        pdf = pdf.sort_values("place")
        allowed, entries = int(first["allowed"].iloc[0]) if len(first) else never, []
        for starts, after in zip(pdf["starts"], pdf["after"]):
            entries.append(allowed)
            allowed = int(step_applied(np.array([allowed]), starts, after)[0])
        return same(pdf, len(pdf), place=pdf["place"].to_numpy(), allowed=np.array(entries, dtype=np.int64))

    def marked(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return nothing("timestamp_ms")
        taken = _chain(np.unique(pdf["timestamp_ms"].to_numpy()), cooldown_ms, int(first["allowed"].iloc[0]))
        return same(pdf, len(taken), timestamp_ms=taken)

    def down(children: DataFrame, parents: DataFrame, by: Column) -> DataFrame:
        group = by.alias("_run")
        return (
            children.groupBy(*keys, group)
            .cogroup(parents.groupBy(*keys, F.col("place").alias("_run")))
            .applyInPandas(lambda c, p: walked(c, p) if len(c) else nothing("place", "allowed"), entry)
        )

    run = F.floor(F.col("place") / RUN)
    times = rows.where("timestamp_ms IS NOT NULL").select(
        *keys, "timestamp_ms", F.floor(F.col("timestamp_ms") / width).alias("place")
    )
    slices = times.groupBy(*keys, "place").applyInPandas(sliced, function)
    runs = slices.groupBy(*keys, run.alias("_run")).applyInPandas(composed, function)
    outer = runs.groupBy(*keys, run.alias("_run")).applyInPandas(composed, function)
    if enter is not None:
        entries = enter(outer)
    else:
        begun = rows.sparkSession.createDataFrame([], entry)
        if carry is not None:
            begun = carry.where("last_check_ms IS NOT NULL").select(
                *keys, F.lit(0).cast("bigint").alias("place"), (F.col("last_check_ms") + cooldown_ms).alias("allowed")
            )
        entries = down(outer, begun, F.lit(0).cast("bigint"))
    for inner in (runs, slices):
        entries = down(inner, entries, run)
    return (
        times.groupBy(*keys, "place")
        .cogroup(entries.groupBy(*keys, "place"))
        .applyInPandas(marked, f"{head}, timestamp_ms bigint")
    )


def _spaced(rows: DataFrame, picks: DataFrame, chunk_ms: int, key: str) -> DataFrame:
    """Add _eval: the first sample at each picked time.

    A pick joins the samples as a mark of its own, which sorts right before them, so the sort that follows the series
    finds them without a join.
    """
    marks = chunks.with_chunk(picks, "timestamp_ms", chunk_ms).withColumn("_real", F.lit(0))
    both = rows.withColumn("_real", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    picked = F.lag("_real").over(chunks.inside([key], "timestamp_ms", "_real", "seq")) == 0
    return both.withColumn("_eval", F.coalesce(picked, F.lit(False))).where("_real = 1")


def _from_level(start: int, steps: list[Column]) -> Column:
    """Level reached from a start level, given how many steps down have been made."""
    out = None
    for level, made in enumerate(steps):
        out = F.when(made >= 1, level) if out is None else out.when(made >= 1, level)
    return out.otherwise(start)


def level_hysteresis(
    df: DataFrame,
    keys: list[str] = SERIES,
    ratio: str = "ratio",
    rule: LevelRule = LevelRule(),
    cooldown_ms: int = 0,
    carry: DataFrame | None = None,
    chunk_ms: int = chunks.CHUNK_MS,
    enter_allowed: Enter | None = None,
    enter_level: Enter | None = None,
    steps_path: str | None = None,
) -> DataFrame:
    """Level of every sample (keys, timestamp_ms, seq, ratio), and the level before it.

    At or above a threshold the level is that of the highest threshold
    reached, whatever it was before.  Below all thresholds it goes down one
    step per sample, and only when the ratio is under the threshold of the
    current level minus the hysteresis.  With a cooldown, samples closer than
    that to the last evaluated one leave the level as it is.  carry holds the
    level (and last_check_ms) at the end of earlier days or batches.  In its
    place, enter_allowed and enter_level may hold the state of a series: they
    get its outermost step functions (see cooldown_picks), and the exit levels
    of its chunks (keys, _chunk, _exits), and return the entry of each.  An
    enter_level that runs a job of its own would have the rows computed again
    for the result; below steps_path they are kept for it, and the caller
    removes the folder once the result has been read.

    All rows come back.  A null key is a key, a null seq comes first among
    samples of one time, and of rows that repeat one is evaluated under a
    cooldown.  Samples without a time come before all others; under a cooldown
    they are not evaluated.
    """
    # As one struct, null keys are keys like others in joins too.
    key, order = "_key", ["timestamp_ms", "seq"]
    whole = F.struct(*keys).alias(key)
    points = df.select(*keys, "timestamp_ms", "seq", F.col(ratio).cast("double").alias("ratio"))
    rows = chunks.with_chunk(points.select(whole, "timestamp_ms", "seq", "ratio"), "timestamp_ms", chunk_ms)
    rows = rows.withColumn(chunks.CHUNK, F.coalesce(chunks.CHUNK, F.lit(NO_TIME // chunk_ms * chunk_ms)))
    if cooldown_ms > 0:
        picks = cooldown_picks(points.select(*keys, "timestamp_ms"), keys, cooldown_ms, carry, enter_allowed)
        rows = _spaced(rows, picks.select(whole, "timestamp_ms"), chunk_ms, key)
        order = ["timestamp_ms", "_real", "seq"]
    else:
        rows = rows.withColumn("_eval", F.lit(True))
    rows = _stepped(rows, key, order, rule)
    if steps_path is not None:
        rows.write.mode("overwrite").parquet(steps_path)
        rows = df.sparkSession.read.schema(rows.schema).parquet(steps_path)
    exits = _exits(rows, key)
    if enter_level is not None:
        entry = enter_level(exits.select(f"{key}.*", chunks.CHUNK, "_exits")).select(whole, chunks.CHUNK, "_entry_level")
    else:
        first = None
        if carry is not None:
            level = F.array_position(F.array(*[F.lit(n) for n in LEVELS]), F.col("level")).cast("int") - 1
            first = carry.select(whole, level.alias("_first"))
        entry = _entry_levels(exits, [key], chunk_ms, first)
    return _finished(rows, entry, key)


# Stands for the time of samples without one: they make the first chunk of their series.
NO_TIME = -(1 << 52)


def _stepped(rows: DataFrame, key: str, order: list[str], rule: LevelRule) -> DataFrame:
    """Add _reached and _before: the level of each row, and of the row before it in the chunk, for each level the chunk might begin with."""
    u = F.col("ratio")
    taken = F.col("_eval") & u.isNotNull()
    forced = F.when(taken & (u >= rule.emergency), 3).when(taken & (u >= rule.critical), 2).when(
        taken & (u >= rule.warning), 1
    )

    def fell(threshold: float) -> Column:
        return F.when(taken & (u < rule.warning) & (u < threshold - rule.hysteresis), 1).otherwise(0)

    ordered = chunks.inside([key], *order)
    so_far = chunks.running(ordered)
    rows = rows.withColumns(
        {"_a": fell(rule.emergency), "_b": fell(rule.critical), "_c": fell(rule.warning), "_forced": forced}
    ).withColumns({"_from": F.last("_forced", ignorenulls=True).over(so_far), "_n": F.row_number().over(ordered)})

    def counted(rows: DataFrame, **flags: str) -> DataFrame:
        """Count flags since the latest forced sample, in the one order that all windows here share."""
        rows = rows.withColumns({f"{name}_all": F.sum(flag).over(so_far) for name, flag in flags.items()})
        start = F.col("_forced").isNotNull()
        rows = rows.withColumns(
            {
                f"{name}_base": F.last(F.when(start, F.col(f"{name}_all")), ignorenulls=True).over(so_far)
                for name in flags
            }
        )
        return rows.withColumns(
            {name: F.col(f"{name}_all") - F.coalesce(f"{name}_base", F.lit(0)) for name in flags}
        )

    def after(flag: str, made: str, step: str) -> Column:
        """A step that counts only on samples after the step before it."""
        return F.when(F.col(made) - F.col(step) >= 1, F.col(flag)).otherwise(0)

    rows = counted(rows, _a3="_a", _b2="_b", _c1="_c")
    rows = rows.withColumns({"_sb3": after("_b", "_a3", "_a"), "_sc2": after("_c", "_b2", "_b")})
    rows = counted(rows, _b3="_sb3", _c2="_sc2")
    rows = counted(rows.withColumn("_sc3", after("_c", "_b3", "_sb3")), _c3="_sc3")
    reached = {
        0: F.lit(0),
        1: _from_level(1, [F.col("_c1")]),
        2: _from_level(2, [F.col("_c2"), F.col("_b2")]),
        3: _from_level(3, [F.col("_c3"), F.col("_b3"), F.col("_a3")]),
    }

    def level_from(start: Column) -> Column:
        return F.when(start == 1, reached[1]).when(start == 2, reached[2]).when(start == 3, reached[3]).otherwise(0)

    known = F.when(F.col("_from").isNotNull(), level_from(F.col("_from")))
    rows = rows.withColumn("_reached", F.array(*[F.coalesce(known, x) for x in reached.values()]))
    rows = rows.withColumn("_before", F.lag("_reached").over(ordered))
    return rows.select(key, chunks.CHUNK, "timestamp_ms", "seq", "ratio", "_eval", "_n", "_reached", "_before")


def _exits(rows: DataFrame, key: str) -> DataFrame:
    """The exit level of each chunk for each entry level."""
    return rows.groupBy(key, chunks.CHUNK).agg(F.max_by("_reached", "_n").alias("_exits"))


def _finished(rows: DataFrame, entry: DataFrame, key: str) -> DataFrame:
    """The levels of the rows, given the entry level of each chunk."""
    joined = chunks.with_carry(rows, entry, [key])
    first = F.col("_entry_level").cast("int")
    return joined.select(
        f"{key}.*",
        "timestamp_ms",
        "seq",
        "ratio",
        F.col("_eval").alias("evaluated"),
        _name(F.coalesce(F.element_at("_before", first + 1), first)).alias("previous"),
        _name(F.element_at("_reached", first + 1)).alias("level"),
    )


# Chunks whose exit tables are composed together.
FAN = 512


def _entry_levels(summary: DataFrame, keys: list[str], chunk_ms: int, first: DataFrame | None) -> DataFrame:
    """Level at the start of each chunk: the exit tables of the chunks before it, applied in order.

    Exit tables, four small numbers each, compose: runs of FAN chunks become
    one table each, the series walks over these, and every run is then walked
    from its own entry level.  The work is linear in the chunks of a series.
    first holds the level that a series begins with, 0 where it has none.
    """
    numbered = summary.withColumn("_i", (F.col(chunks.CHUNK) / chunk_ms).cast("bigint"))
    runs = (
        numbered.groupBy(*keys, F.floor(F.col("_i") / FAN).alias("_run"))
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_exits"))).alias("_list"))
    )
    start = F.array(*[F.lit(level) for level in range(4)])
    composed = F.aggregate("_list", start, lambda acc, c: F.transform(acc, lambda level: F.element_at(c["_exits"], level + 1)))
    whole = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_run").alias("_i"), composed.alias("_exits")))).alias("_list"))
    whole = whole.withColumn("_first", F.lit(0)) if first is None else whole.join(first, keys, "left")
    entries = _walked(whole.withColumn("_first", F.coalesce("_first", F.lit(0))), keys)
    begun = entries.withColumnsRenamed({"_i": "_run", "_entry": "_first"})
    return _walked(runs.join(begun, [*keys, "_run"]), keys).select(
        *keys, (F.col("_i") * chunk_ms).alias(chunks.CHUNK), F.col("_entry").alias("_entry_level")
    )


def _walked(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Level at the start of each element of a list of exit tables, beginning with _first."""
    start = F.struct(F.col("_first").alias("level"), F.array().cast("array<int>").alias("entries"))
    entries = F.aggregate(
        "_list",
        start,
        lambda acc, c: F.struct(
            F.element_at(c["_exits"], acc["level"] + 1).alias("level"),
            F.concat(acc["entries"], F.array(acc["level"])).alias("entries"),
        ),
        lambda acc: acc["entries"],
    )
    pairs = F.arrays_zip(F.col("_list").alias("c"), entries.alias("e"))
    return lists.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.c._i").alias("_i"), F.col("p.e").alias("_entry"))


def level_final(levels: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Level and last evaluation time at the end, as carry for the next day or batch."""
    return levels.groupBy(*keys).agg(
        F.max_by("level", F.struct("timestamp_ms", "seq")).alias("level"),
        F.max(F.when(F.col("evaluated"), F.col("timestamp_ms"))).alias("last_check_ms"),
    )


def level_change_counts(levels: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Number of changes, and of entries into each raised level, per series."""
    changed = F.col("level") != F.col("previous")
    entries = [F.count_if(changed & (F.col("level") == n)).alias(f"{n}_count") for n in LEVELS[1:]]
    return levels.groupBy(*keys).agg(F.count_if(changed).alias("level_changes"), *entries)

