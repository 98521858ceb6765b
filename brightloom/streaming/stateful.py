"""Streams with state of their own: sessions, interval joins, and repeats within a time.

State is kept by slot, a group of keys, in RocksDB and goes when the watermark has passed what it could
still matter for, so it is as large as what is open, not as what was ever seen.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brightloom.session import shared_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that keys are dealt into; a stream that goes on from its checkpoint needs the same number.
SLOTS = 1024


def _millis(micros: int) -> int:
    """The first whole millisecond that is not before."""
    return -(-micros // 1000)


class _Slots(StatefulProcessor):
    """State of all keys of a slot, by name, as arrays of numbers, with one timer for what ends next.

    A key costs some ten calls of the state server if it is a group of its own, far more
    than its few rows; so keys are dealt into SLOTS groups by their hash.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("open", "name string, numbers array<bigint>")

    def held(self) -> dict[str | None, list[int]]:
        return {name: list(numbers) for name, numbers in self.state.get()}

    def hold(self, found: dict[str | None, list[int]], before: int | None) -> None:
        """Store what is not empty, and move the slot's timer; one that has run out, None, goes by itself."""
        found = {name: numbers for name, numbers in found.items() if numbers}
        self.state.put(list(found.items())) if found else self.state.clear()
        after = self.next(found)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def next(self, found: dict[str | None, list[int]]) -> int | None:
        return min((self.end(numbers) for numbers in found.values()), default=None)

    def end(self, numbers: list[int]) -> int:
        """The watermark at which the first of a key's entries goes."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Sessions(_Slots):
    """Open sessions of a key: first, last and n of each in order of time, in microseconds."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def end(self, numbers: list[int]) -> int:
        return _millis(numbers[1] + self.gap)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.held()
        before, times = self.next(found), {}
        for batch in rows:
            for name, t in zip(batch["slot_name"].tolist(), batch["at"].tolist(), strict=True):
                times.setdefault(name, []).append((t, t, 1))
        for name, new in times.items():
            old, merged = found.get(name, []), []
            for first, last, n in sorted([*zip(old[::3], old[1::3], old[2::3], strict=True), *new]):
                if merged and first - merged[-2] <= self.gap:
                    merged[-2], merged[-1] = max(merged[-2], last), merged[-1] + n
                else:
                    merged += first, last, n
            found[name] = merged
        self.hold(found, before)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, found, over = timerValues.getCurrentWatermarkInMs(), self.held(), []
        for name, numbers in found.items():
            done = 0
            while done < len(numbers) and self.end(numbers[done : done + 2]) <= now:
                over.append((name, *numbers[done : done + 3]))
                done += 3
            found[name] = numbers[done:]
        self.hold(found, None)
        yield pd.DataFrame(over, columns=["name", "first", "last", "n"])


class _Firsts(_Slots):
    """Times of a key's rows that were passed on, in order, as long as a row that the watermark admits may repeat them."""

    def __init__(self, within: int, schema: list[str]) -> None:
        self.within, self.schema = within, schema

    def end(self, numbers: list[int]) -> int:
        return _millis(numbers[0] + self.within) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.held()
        before = self.next(found)
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(["at", *(c for c in self.schema if c != "at")], kind="stable", ignore_index=True)
        first = []
        for row, (name, t) in enumerate(zip(batch["slot_name"].tolist(), batch["at"].tolist(), strict=True)):
            kept = found.setdefault(name, [])
            i = bisect_left(kept, t)
            if (i == 0 or t - kept[i - 1] > self.within) and (i == len(kept) or kept[i] - t > self.within):
                kept.insert(i, t)
                first.append(row)
        if first:
            self.hold(found, before)
        yield batch.iloc[first][self.schema]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.hold({name: [t for t in kept if _millis(t + self.within) >= now] for name, kept in self.held().items()}, None)
        return iter(())


def _micros(gap: str, spark: SparkSession) -> int:
    """An interval in microseconds."""
    return spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap})").first()[0]


def _slotted(rows: DataFrame) -> GroupedData:
    return rows.withColumn("slot", F.pmod(F.xxhash64("slot_name"), F.lit(SLOTS))).groupBy("slot")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, first, last, n) of a stream: runs of a key's events, none more than ``gap`` after the one before.

    A session is passed on once the watermark, ``late`` behind the newest event, is at its
    last event plus ``gap``: no event that is still admitted can change it then. Events
    behind the watermark that the batch before had are dropped. An event out of order joins the session it belongs to,
    and two sessions that it bridges become one. Null keys are a key of their own, null
    times are dropped. A key is of a type that is the same after a cast to text and back:
    a number, text, a time.
    """
    spark = events.sparkSession
    rows = events.select(F.col(key).cast("string").alias("slot_name"), F.col(ts).cast("timestamp").alias("ts")).filter("ts IS NOT NULL")
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    out = _slotted(rows).transformWithStateInPandas(_Sessions(_micros(gap, spark)), "name string, first bigint, last bigint, n bigint", "Append", "EventTime")
    return out.select(F.col("name").cast(events.schema[key].dataType).alias(key), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The events of a stream that are at most ``within`` from no event of their keys that was passed on.

    In one batch events come in order of time, then of their other columns, so the result
    of a stream in order doesn't depend on how it is cut into batches. An event that comes
    late, but within the watermark, is a repeat of a passed one on either side. Events
    behind the watermark that the batch before had are dropped, and so are null times; null keys are keys. Columns
    must be of types that pandas keeps: numbers without nulls, text, times.
    """
    spark = events.sparkSession
    rows = events.filter(F.col(ts).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).withColumn("at", F.unix_micros("_ts"))
    rows = rows.withColumn("slot_name", F.to_json(F.array(*(F.col(k).cast("string") for k in keys))))
    columns = [*events.columns, "at"]
    processor = _Firsts(_micros(within, spark), columns)
    out = _slotted(rows).transformWithStateInPandas(processor, rows.select(*columns).schema, "Append", "EventTime")
    return out.select(*events.columns)


def interval_pairs(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """l and r, structs of rows of two streams: r is of the same key, not before l and at most ``within`` after.

    Both sides keep rows until the watermark says that no partner can come any more. Rows
    behind the watermark, and null keys and times, meet nothing.
    """
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.col(ts).cast("timestamp").alias(f"{name}_ts"), F.struct(*df.columns).alias(name)).withWatermark(f"{name}_ts", late)
    near = F.expr(f"l_key = r_key AND r_ts >= l_ts AND r_ts <= l_ts + INTERVAL {within}")
    return side(left, "l").join(side(right, "r"), near).select("l", "r")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """A query that is started within keeps its state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def opened(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet path, a folder or one file, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may also be one file


def ended(stream: DataFrame) -> DataFrame:
    """The rows that a stream of what its sources hold now has passed on, as a table in the shared folder.

    What the stream kept for itself is deleted when it has ended.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    with _rocks(spark):
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/state")
    state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(state, True)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
