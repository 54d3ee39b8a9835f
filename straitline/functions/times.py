"""Slice and day grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from straitline import constants as K

MICROS_PER_DAY = 86_400_000_000
SLICE_SECONDS = K.SLICE_MINUTES * 60


def floor_to_slice(ts: Column) -> Column:
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(SLICE_SECONDS)))


def ceil_to_slice(ts: Column) -> Column:
    floor = floor_to_slice(ts)
    return F.when(floor < ts, floor + F.expr(f"INTERVAL {K.SLICE_MINUTES} MINUTES")).otherwise(floor)


def slice_grid(now: Column, last_minutes: int = K.DEFAULT_LAST_MINUTES,
               lag_minutes: int = K.PUBLICATION_LAG_MINUTES) -> Column:
    """Array of slice stamps of a live window: closed, ending before the publication lag."""
    newest = floor_to_slice(now - F.expr(f"INTERVAL {lag_minutes} MINUTES"))
    oldest = floor_to_slice(now - F.expr(f"INTERVAL {last_minutes} MINUTES"))
    step = F.expr(f"INTERVAL {K.SLICE_MINUTES} MINUTES")
    return F.when(oldest <= newest, F.sequence(oldest, F.greatest(oldest, newest), step)).otherwise(
        F.array().cast("array<timestamp>"))


def slices_between(start: Column, end: Column) -> Column:
    """Array of slice stamps in ``[start, end)``."""
    step = F.expr(f"INTERVAL {K.SLICE_MINUTES} MINUTES")
    first = ceil_to_slice(start)
    last = ceil_to_slice(end) - step
    return F.when(first <= last, F.sequence(first, F.greatest(first, last), step)).otherwise(
        F.array().cast("array<timestamp>"))


def as_of(day: Column) -> Column:
    """The instant a day is scored at."""
    return F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {K.SCORE_TIME}")))


def days_between(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, F.greatest(first, last), F.expr("INTERVAL 1 DAY"))).otherwise(
        F.array().cast("array<date>"))


def day_grid(windows: DataFrame, warmup: bool = False) -> DataFrame:
    """One row per day of each window (event, chart_start, end), with its scoring instant.

    ``warmup`` starts the grid the warm-up days earlier: the days that must be pulled.
    """
    first = F.date_sub("chart_start", K.WARMUP_DAYS) if warmup else F.col("chart_start")
    return windows.select(
        "event", F.explode(days_between(first, F.col("end"))).alias("day")
    ).withColumn("as_of", as_of(F.col("day")))


def age_days(ts: Column, now: Column) -> Column:
    """Days from ``ts`` to ``now``; instants after ``now`` count as age zero."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(float(MICROS_PER_DAY)))


def literal_instant(spark: SparkSession, text: str) -> Column:
    return F.lit(text).cast("timestamp")
