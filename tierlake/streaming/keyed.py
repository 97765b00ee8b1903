"""State by series in Spark's keyed state store, for streams whose operators need the order of a series.

A micro-batch is first cut into chunks and reduced to one small row for each series and chunk (open failure runs, exit
levels, newest buckets), in parallel however hot a series is. These rows go through a stream of their own into a stateful
processor, grouped by series: it takes the chunks of a series in order, gives each the state that the series had before
it, and keeps the state after the last one. Only series of the batch touch the state, and the changelog that RocksDB
writes for a batch grows with those series, not with all.

The rows of a batch are written under its number before the inner stream runs. A batch that is repeated after a failure
finds them there: what the inner stream had committed is not taken twice, and its output is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tierlake.operators import chunks, levels
from tierlake.schemas import SERIES
from tierlake.session import path_exists

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
KEYS = ", ".join(f"{c} string" for c in SERIES)
NAME = "state"


def number(value) -> int | None:
    """A nullable whole number as it comes out of pandas or a state."""
    return None if value is None or pd.isna(value) else int(value)


class InOrder(StatefulProcessor):
    """Takes the rows of a series in order of batch and place; subclasses say what a state is and how a row moves it."""

    #: Columns of the state, and those of an entry that a row is given.
    state: str
    entry: tuple[str, ...]

    def init(self, handle) -> None:
        self.held = handle.getValueState(NAME, self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["batch", "place"], kind="stable")
        now = self.held.get() if self.held.exists() else None
        out = []
        for row in table.to_dict("records"):
            out.append((*key, row["batch"], row["place"], *self.before(now)))
            now = self.after(now, row)
        self.held.update(now)
        yield pd.DataFrame(out, columns=[*SERIES, "batch", "place", *self.entry]).astype(
            {c: "Int64" for c in ("batch", "place", *self.entry)}
        )

    def before(self, now: tuple | None) -> tuple:
        raise NotImplementedError

    def after(self, now: tuple | None, row: dict) -> tuple:
        raise NotImplementedError

    def close(self) -> None:
        pass


class HealthState(InOrder):
    """Open failures, the latest success and failure, and the latest poll with its error."""

    state = "failures bigint, success bigint, failure bigint, polled bigint, error string"
    entry = ("_open", "_cs", "_cf")

    def before(self, now):
        return (None, None, None) if now is None else tuple(map(number, now[:3]))

    def after(self, now, row):
        failures, success, failure = self.before(now)
        mark, fails = number(row["m"]), int(row["n"])
        later = [(a if b is None else b if a is None else max(a, b)) for a, b in ((success, number(row["s"])), (failure, number(row["f"])))]
        polled = number(row["polled"])
        if now is not None and number(now[3]) is not None and (polled is None or polled < number(now[3])):
            polled, error = number(now[3]), now[4]
        else:
            error = row["error"]
        return (failures or 0) + fails if mark is None else fails - mark, *later, polled, error


class LevelState(InOrder):
    """The level of a series, 0 to 3; a row holds the exit level of its chunk for each entry level."""

    state = "level int"
    entry = ("_entry_level",)

    def before(self, now):
        return (0 if now is None else int(now[0]),)

    def after(self, now, row):
        return (int(row["exits"][self.before(now)[0]]),)


class AllowedState(InOrder):
    """The earliest time of the next evaluation under a cooldown; a row holds a step function of slices."""

    state = "allowed bigint"
    entry = ("allowed",)

    def before(self, now):
        return (int(np.iinfo(np.int64).min) if now is None else int(now[0]),)

    def after(self, now, row):
        return (int(levels.step_applied(np.array(self.before(now)), row["starts"], row["after"])[0]),)


class NewestState(InOrder):
    """The newest bucket that a series has reached."""

    state = "newest bigint"
    entry = ("_carry",)

    def before(self, now):
        return (None,) if now is None else (number(now[0]),)

    def after(self, now, row):
        known = [n for n in (self.before(now)[0], number(row["newest"])) if n is not None]
        return (max(known) if known else None,)


@dataclass(frozen=True)
class Keyed:
    """One keyed state below `root` (folders `chunks`, `entries` and `checkpoint`); `row` are the columns of a chunk's row."""

    root: str
    processor: type[InOrder]
    row: str

    def _session(self, spark: SparkSession) -> SparkSession:
        own = spark.newSession()
        for name, value in ROCKSDB.items():
            own.conf.set(name, value)
        for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            own.conf.set(name, spark.conf.get(name))
        return own

    def enter(self, summary: DataFrame, batch_id: int, place: str = chunks.CHUNK) -> DataFrame:
        """The state before each row of a batch (series, `place`, `row`), as series, `place` and the processor's entry."""
        spark = summary.sparkSession
        # The processor gets its rows as named tuples, whose names cannot begin with an underscore.
        fields = [part.lstrip("_") for part in self.row.split(", ")]
        folder, schema = f"{self.root}/chunks/{batch_id:012d}", f"{KEYS}, batch bigint, place bigint, {', '.join(fields)}"
        if not path_exists(spark, f"{folder}/_SUCCESS"):
            columns = [F.col(part.split()[0]).alias(part.split()[0].lstrip("_")) for part in self.row.split(", ")]
            rows = summary.select(*SERIES, F.lit(batch_id).cast("bigint").alias("batch"), F.col(place).alias("place"), *columns)
            rows.write.mode("overwrite").parquet(folder)
        own = self._session(spark)
        entered = ", ".join(f"{c} bigint" for c in self.processor.entry)
        out = f"{KEYS}, batch bigint, place bigint, {entered}"
        moved = (
            own.readStream.schema(schema)
            .parquet(f"{self.root}/chunks/*")
            .groupBy(*SERIES)
            .transformWithStateInPandas(self.processor(), out, "append", "none")
        )
        writer = moved.writeStream.format("parquet").option("path", f"{self.root}/entries").partitionBy("batch")
        writer = writer.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True)
        writer.start().awaitTermination()
        if not path_exists(spark, f"{self.root}/entries"):
            return spark.createDataFrame([], out).drop("batch").withColumnRenamed("place", place)
        entries = spark.read.schema(out).parquet(f"{self.root}/entries").where(F.col("batch") == batch_id)
        return entries.drop("batch").withColumnRenamed("place", place)

    def states(self, spark: SparkSession) -> DataFrame:
        """The state of every series after the last batch: series and the columns of the state."""
        reader = self._session(spark).read.format("statestore").option("path", f"{self.root}/checkpoint")
        found = reader.option("stateVarName", NAME).load()
        return found.select("key.*", "value.*")
