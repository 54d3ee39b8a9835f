"""Price series. A series holds one row per day, so its windows stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from straitline import constants as K


def _by_date():
    return W.partitionBy("series").orderBy("date")


def daily_returns(prices: DataFrame) -> DataFrame:
    """Percent change against the previous published row; rows after a zero price are dropped."""
    return (
        prices.withColumn("prev_usd", F.lag("price_usd").over(_by_date()))
        .filter("prev_usd IS NOT NULL AND prev_usd <> 0")
        .select("series", "date", "price_usd", "prev_usd",
                ((F.col("price_usd") - F.col("prev_usd")) / F.col("prev_usd") * 100.0).alias("pct_change"))
    )


def largest_moves(prices: DataFrame, n: int = 10, direction: str = "up") -> DataFrame:
    """The ``n`` largest single-session moves, largest first, earlier date first on ties."""
    moves = daily_returns(prices)
    change = F.col("pct_change")
    if direction == "up":
        moves, order = moves.filter(change > 0), F.desc(change)
    elif direction == "down":
        moves, order = moves.filter(change < 0), F.asc(change)
    else:
        order = F.desc(F.abs(change))
    return moves.orderBy(order, "date", "series").limit(n)


def price_as_of(prices: DataFrame, keys: DataFrame) -> DataFrame:
    """For each (series, day) key the latest price at or before the day, else null.

    Prices and keys are merged into one ordered list per series; copies of a key cost one row.
    """
    wanted = keys.select("series", "day").distinct()
    merged = prices.select("series", F.col("date").alias("day"), F.struct("date", "price_usd").alias("seen"), F.lit(0).alias("is_key")) \
        .unionByName(wanted.withColumn("seen", F.lit(None).cast("struct<date:date,price_usd:double>")).withColumn("is_key", F.lit(1)))
    latest = F.last("seen", ignorenulls=True).over(
        W.partitionBy("series").orderBy("day", "is_key").rowsBetween(W.unboundedPreceding, 0))
    answers = merged.withColumn("seen", latest).filter("is_key = 1").select(
        "series", "day", F.col("seen.date").alias("price_date"), F.col("seen.price_usd").alias("price_usd"))
    return keys.join(answers, ["series", "day"], "left")


def attach_price(days: DataFrame, prices: DataFrame, day: str = "day") -> DataFrame:
    """Exact-date price, null when there was no session."""
    sessions = prices.select("series", F.col("date").alias(day), F.col("price_usd").alias("price_usd"))
    return days.join(sessions, ["series", day], "left")


def find_price_events(prices: DataFrame, windows: DataFrame, min_pct: float = K.SPIKE_SESSION_PCT) -> DataFrame:
    """First session of each window (event, series, chart_start, end) that rose ``min_pct`` or more."""
    moves = daily_returns(prices).filter(F.col("pct_change") >= min_pct)
    inside = windows.select("event", "series", "chart_start", "end").join(moves, "series").filter(
        "date BETWEEN chart_start AND end")
    first = inside.groupBy("event").agg(F.min(F.struct("date", "pct_change", "prev_usd", "price_usd")).alias("m"))
    return first.select(
        "event", F.col("m.date").alias("spiked_at"), F.col("m.pct_change").alias("spike_pct"),
        F.col("m.prev_usd").alias("before_usd"), F.col("m.price_usd").alias("after_usd"))


def find_run_up(prices: DataFrame, low: float | Column, high: float | Column, tolerance: float = 2.0) -> DataFrame:
    """Tightest climb from at most low+tolerance to at least high-tolerance without falling back.

    Every start looks at the next row that decides its fate: a row back in the low band ends it, a
    row in the high band completes it. The shortest completed climb wins, the earliest on ties.
    ``low`` and ``high`` may be columns of ``prices`` for one target pair per series.
    """
    low, high = (F.lit(x) if isinstance(x, (int, float)) else x for x in (low, high))
    price = F.col("price_usd")
    decides = (price <= low + tolerance) | (price >= high - tolerance)
    after = _by_date().rowsBetween(1, W.unboundedFollowing)
    marked = prices.withColumn("starts", price <= low + tolerance) \
        .withColumn("peaks", (price > low + tolerance) & (price >= high - tolerance)) \
        .withColumn("mark", F.when(decides, F.struct("peaks", F.col("date").alias("peak"), F.col("price_usd").alias("peak_usd"))))
    climbs = (
        marked.withColumn("next", F.first("mark", ignorenulls=True).over(after)).filter("starts AND next.peaks")
        .withColumn("days", F.date_diff("next.peak", "date"))
    )
    best = climbs.groupBy("series").agg(
        F.min(F.struct("days", "date", "price_usd", F.col("next.peak").alias("peak"), F.col("next.peak_usd").alias("peak_usd"))).alias("b"))
    return best.select(
        "series", F.col("b.date").alias("start"), F.col("b.price_usd").alias("start_usd"), "b.peak", "b.peak_usd", "b.days",
        ((F.col("b.peak_usd") - F.col("b.price_usd")) / F.col("b.price_usd") * 100.0).alias("pct_change"))
