"""Stories and slice coverage with keyed state that expires by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from straitline import constants as K
from straitline.functions.similarity import WINDOW_MICROS, first_leaders, resolve_batch, resolve_titles
from straitline.functions.text import normalize_title
from straitline.streaming.slices import LATENESS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE = 1000  # events of a key that are settled at a time
TITLES = 2000  # distinct titles of a key and trigger up to which its events are settled by title


def settle_against(founders: list[tuple[int, int, str]], rows: pd.DataFrame) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Story of each row (at, event_id, norm; in time order) given the founders before them, and the founders still in reach after."""
    if len(rows) > SLICE and (not founders or founders[-1][0] <= rows["at"].iloc[0]):
        code, titles = pd.factorize(np.array([f[2] for f in founders] + rows["norm"].tolist(), dtype=object))
        if len(titles) <= TITLES:
            return _settle_by_titles(founders, rows, code, titles.tolist())
    stories: list[int] = []
    for start in range(0, len(rows), SLICE):
        part = rows.iloc[start : start + SLICE]
        at, ids, norm = part["at"].to_numpy(), part["event_id"].to_numpy(), part["norm"].tolist()
        own, titled = ids.copy(), np.array([t != "" for t in norm])
        founders = [f for f in founders if f[0] >= at[0] - WINDOW_MICROS]
        if founders and titled.any():
            where = np.flatnonzero(titled)
            hit = first_leaders(at[where], [norm[i] for i in where], np.array([f[0] for f in founders]), [f[2] for f in founders])
            own[where[hit >= 0]] = [founders[i][1] for i in hit[hit >= 0]]
            titled[where[hit >= 0]] = False
        open_ = np.flatnonzero(titled)
        if len(open_):
            leader = resolve_batch(at[open_], [norm[i] for i in open_])
            own[open_] = ids[open_][leader]
            founders += [(int(at[i]), int(ids[i]), norm[i]) for i in open_[leader == np.arange(len(open_))]]
        stories += own.tolist()
    return stories, [f for f in founders if f[0] >= int(rows["at"].iloc[-1]) - WINDOW_MICROS] if len(rows) else founders


def _settle_by_titles(founders: list[tuple[int, int, str]], rows: pd.DataFrame, code: np.ndarray, titles: list[str]):
    """``settle_against`` for few distinct titles: founders, none later than a row, and rows are one list that is resolved title by title."""
    at = np.concatenate([np.array([f[0] for f in founders], dtype=np.int64), rows["at"].to_numpy()])
    ids = np.concatenate([np.array([f[1] for f in founders], dtype=np.int64), rows["event_id"].to_numpy()])
    titled = np.flatnonzero(np.array([t != "" for t in titles])[code])
    leader = np.arange(len(at))
    leader[titled] = titled[resolve_titles(at[titled], code[titled], titles)]
    kept = titled[(leader[titled] == titled) & (at[titled] >= at[-1] - WINDOW_MICROS)]
    return ids[leader][len(founders):].tolist(), [(int(at[i]), int(ids[i]), titles[code[i]]) for i in kept]


class StoryProcessor(StatefulProcessor):
    """Per key the founders of the last story window, as list state; a timer clears a key that has gone quiet."""

    def __init__(self, keys: tuple):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.founders = handle.getListState("founders", "at long, event_id long, norm string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], ignore_index=True)
        known = sorted((int(f[0]), int(f[1]), f[2]) for f in self.founders.get()) if self.founders.exists() else []
        stories, founders = settle_against(known, batch)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if founders:
            self.founders.put(founders)
            self.handle.registerTimer((founders[-1][0] + WINDOW_MICROS) // 1000 + 1)
        elif known:
            self.founders.clear()
        yield pd.DataFrame({**{k: [v] * len(batch) for k, v in zip(self.keys, key)}, "event_id": batch["event_id"], "story_id": stories, "held": len(founders)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.founders.clear()
        return iter([])

    def close(self) -> None:
        pass


def story_stream(events: DataFrame, keys: tuple = ("corridor",), lateness: str = LATENESS) -> DataFrame:
    """The keys, event_id, story_id and ``held`` (founders kept) of a stream of events (keys, event_id, ts, title) in time order.

    State is the founders of each key's last three days and no more. Rows later than ``lateness`` are dropped, as everywhere in
    the stream. All events of a key and trigger are settled in one task; where one key has most of the traffic, ``stream_stories``
    spreads it over tasks instead and keeps the founders in a table.
    """
    rows = events.withWatermark("ts", lateness).select(*keys, "event_id", "ts", F.unix_micros("ts").alias("at"), normalize_title(F.col("title")).alias("norm"))
    fields = {f.name: f for f in rows.schema.fields}
    out = StructType([*(fields[k] for k in keys), StructField("event_id", LongType()), StructField("story_id", LongType()), StructField("held", LongType())])
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=StoryProcessor(keys), outputStructType=out, outputMode="Append", timeMode="EventTime")


def append_table(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append what a stream gives to a Parquet table; state is kept in RocksDB, outside the JVM's heap."""
    spark = df.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:  # a query keeps the settings it was started with
        return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def slices_read(lines: DataFrame, window: str = "1 day") -> DataFrame:
    """``start, end, slices_read``: distinct readable slices of each window, once the window has closed.

    A slice counts once however many lines it has; slices later than the publication lag are dropped; closed windows leave the
    state.
    """
    readable = lines.filter("readable").select("path", "slice_ts").withWatermark("slice_ts", LATENESS).dropDuplicatesWithinWatermark(["path"])
    return readable.groupBy(F.window("slice_ts", window).alias("w")).agg(F.count("*").alias("slices_read")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "slices_read")


def slices_against_grid(closed: DataFrame, expected: DataFrame) -> DataFrame:
    """``window_id, slices_read, slices_total, status`` of closed windows, next to the expected grid (window_id, slice_ts): a join of a stream with a table.

    Windows nothing was read of never leave the stream; ``missing_windows`` adds them.
    """
    grid = expected.groupBy("window_id").agg(F.count("*").alias("slices_total"), F.min("slice_ts").alias("first"))
    sampled = F.col("slices_read") >= K.MIN_SLICE_COVERAGE * F.col("slices_total")
    status = F.when(sampled, K.STATUS_OK).otherwise(K.STATUS_ERROR)
    return closed.join(grid, (F.col("first") >= F.col("start")) & (F.col("first") < F.col("end")) & (F.to_date("first") == F.to_date("start"))).select(
        "window_id", "slices_read", "slices_total", status.alias("status"))


def missing_windows(told: DataFrame, expected: DataFrame, until) -> DataFrame:
    """What was told of windows, and as errors those that closed before ``until`` without a slice."""
    grid = expected.groupBy("window_id").agg(F.count("*").alias("slices_total"), F.max("slice_ts").alias("last"))
    silent = grid.filter(F.col("last") < until).join(told.select("window_id"), "window_id", "left_anti").select(
        "window_id", F.lit(0).cast("long").alias("slices_read"), "slices_total", F.lit(K.STATUS_ERROR).alias("status"))
    return told.unionByName(silent)
