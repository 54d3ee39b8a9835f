"""Day series: runs above a threshold, gaps, pull coverage, verdicts.

Series, ledgers and grids hold one row per day and event, so their windows are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from straitline import constants as K
from straitline.functions.text import parse_seendate
from straitline.functions.times import as_of, day_grid
from straitline.operators.prices import find_price_events

EVENT = ("event",)


def excursions(series: DataFrame, threshold: float = K.SIGNAL_THRESHOLD, keys: tuple = EVENT) -> DataFrame:
    """Maximal runs of consecutive rows strictly above ``threshold``; a null score ends a run."""
    order = W.partitionBy(*keys).orderBy("day")
    above = F.coalesce(F.col("score") > threshold, F.lit(False))
    runs = series.withColumn("above", above).withColumn(
        "run", F.sum(F.when(F.col("above"), 0).otherwise(1)).over(order)).filter("above")
    peak = F.max(F.struct("score", (-F.unix_date("day")).alias("early"), "day"))
    return runs.groupBy(*keys, "run").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), peak.alias("p"),
    ).select(*keys, "start", "end", (F.date_diff("end", "start") + 1).alias("days"),
             F.col("p.score").alias("peak"), F.col("p.day").alias("peak_at"))


def missing_days(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """Expected (event, day) rows the ledger does not mark as read."""
    done = ledger.filter(F.col("status") == K.STATUS_OK).select("event", "day")
    return expected.select("event", "day").join(done, ["event", "day"], "left_anti")


def gap_ranges(missing: DataFrame, keys: tuple = EVENT) -> DataFrame:
    """Contiguous runs of missing days."""
    order = W.partitionBy(*keys).orderBy("day")
    island = F.date_sub("day", F.row_number().over(order))
    return missing.select(*keys, "day").distinct().withColumn("island", island).groupBy(*keys, "island").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("days")).drop("island")


def flag_gaps(series: DataFrame, missing: DataFrame, keys: tuple = EVENT) -> DataFrame:
    """Add ``day_sampled`` and the number of missing days at or before each row's day."""
    gone = missing.select(*keys, "day").distinct().withColumn("gone", F.lit(1))
    order = W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, 0)
    days = series.select(*keys, "day").distinct().withColumn("on_chart", F.lit(1)).join(gone, [*keys, "day"], "full_outer")
    flags = days.withColumn("unsampled_days_in_lookback", F.coalesce(F.sum("gone").over(order), F.lit(0))) \
        .withColumn("day_sampled", F.col("gone").isNull()).filter("on_chart = 1").drop("on_chart", "gone")
    return series.join(flags, [*keys, "day"])


def pull_coverage(windows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per event: days expected, read and missing; slices and articles over the days read."""
    expected = day_grid(windows, warmup=True).select("event", "day")
    ok = F.coalesce(F.col("status") == K.STATUS_OK, F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    return expected.join(ledger, ["event", "day"], "left").groupBy("event").agg(
        F.count("*").alias("days_expected"), F.count_if(ok).alias("days_ok"),
        F.sort_array(F.collect_list(F.when(~ok, F.col("day")))).alias("days_missing"),
        total("slices_read").alias("slices_read"), total("slices_total").alias("slices_total"),
        total("stored").alias("articles_stored"), (F.count_if(~ok) == 0).alias("complete"))


def _scored_part(ts: Column):
    """Day whose scoring instant is the last at or before ``ts``, and whether ``ts`` is that instant."""
    at = F.expr(f"INTERVAL '{K.SCORE_TIME}' HOUR TO SECOND")
    day = F.to_date(ts - at)
    return day, ts == as_of(day)


def pending_in_scope(windows: DataFrame, articles: DataFrame) -> DataFrame:
    """Unprocessed articles dated inside [first lookback edge, window end] of each event.

    Articles are counted per scoring day first, so windows only meet day counts.
    """
    seen = articles.filter(~F.col("processed")).withColumn("seen", parse_seendate(F.col("raw_text"))).filter("seen IS NOT NULL")
    day, exact = _scored_part(F.col("seen"))
    counts = seen.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.count_if(exact).alias("n_exact"))
    spans = windows.select("event", "end", F.explode(F.sequence(
        F.date_sub("chart_start", K.LOOKBACK_DAYS), F.col("end"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    inside = F.when(F.col("day") < F.col("end"), F.col("n")).otherwise(F.col("n_exact"))
    return spans.join(counts, "day", "left").groupBy("event").agg(F.coalesce(F.sum(inside), F.lit(0)).alias("pending"))


def event_counts(windows: DataFrame, events: DataFrame, corridors: DataFrame) -> DataFrame:
    """Events per corridor dated in [pull start 00:00, end 16:30], zero-filled."""
    day = F.to_date("ts")
    counts = events.filter("corridor IS NOT NULL").groupBy("corridor", day.alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("ts") <= as_of(day)).alias("n_scored"))
    spans = day_grid(windows, warmup=True).select("event", "day").join(windows.select("event", "end"), "event")
    inside = F.when(F.col("day") < F.col("end"), F.col("n")).otherwise(F.col("n_scored"))
    found = spans.join(counts, "day").groupBy("event", "corridor").agg(F.sum(inside).alias("events"))
    grid = windows.select("event").join(corridors.select(F.col("name").alias("corridor")))
    return grid.join(found, ["event", "corridor"], "left").fillna(0, ["events"])


def validate(series: DataFrame, prices: DataFrame, windows: DataFrame, threshold: float = K.SIGNAL_THRESHOLD,
             tolerance_days: int = K.TOLERANCE_DAYS, spike_pct: float = K.SPIKE_SESSION_PCT) -> DataFrame:
    """Judge each event: did its corridor's score rise before, or just after, the price did?

    ``series`` (event, day, score) of the focus corridor; ``prices`` (series, date, price_usd);
    ``windows`` (event, corridor, series, chart_start, end). The price event comes from prices
    alone. Only the run still open at the price event, or starting within the tolerance after it,
    counts; runs that ended before are false alarms. A run on the first charted day only bounds the lead.
    """
    charted = series.join(windows.select("event", "chart_start", "end"), "event").filter(
        "day BETWEEN chart_start AND end")
    spikes = find_price_events(prices, windows, spike_pct)
    runs = excursions(charted.select("event", "day", "score"), threshold)
    judged = runs.join(spikes.select("event", "spiked_at"), "event")
    counts = (F.col("end") >= F.col("spiked_at")) & (F.col("start") <= F.date_add("spiked_at", tolerance_days))
    run = F.struct("start", "end", "days", "peak", "peak_at")
    found = judged.groupBy("event").agg(
        F.min(F.when(counts, F.col("start"))).alias("elevated_at"),
        F.array_sort(F.collect_list(run)).alias("excursions"),
        F.array_sort(F.collect_list(F.when(F.col("end") < F.col("spiked_at"), run))).alias("false_alarms"))
    levels = charted.join(spikes.select("event", "spiked_at"), "event", "left").groupBy("event").agg(
        F.max("score").alias("max_score"),
        F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.unix_date("day")).alias("early"), "day"))).alias("top"),
        F.max(F.when(F.col("day") == F.col("chart_start"), F.col("score"))).alias("score_at_start"),
        F.max(F.when(F.col("day") == F.col("spiked_at"), F.col("score"))).alias("score_at_spike"))
    lead = F.date_diff("spiked_at", "elevated_at")
    at_start = F.col("elevated_at") == F.col("chart_start")
    verdict = (
        F.when(F.col("spiked_at").isNull(), "NO_PRICE_EVENT").when(F.col("elevated_at").isNull(), "FAILED")
        .when(at_start, "INCONCLUSIVE").otherwise("PASSED")
    )
    text = lambda c: F.col(c).cast("string")
    move = F.format_string("%+.2f", "spike_pct")
    reason = (
        F.when(F.col("spiked_at").isNull(), F.concat(
            F.lit("no session in "), text("chart_start"), F.lit(".."), text("end"), F.lit(f" rose {spike_pct}% or more")))
        .when(F.col("elevated_at").isNull(), F.concat(
            F.col("corridor"), F.lit(f" was not above {threshold} on "), text("spiked_at"),
            F.lit(f" and did not cross it within {tolerance_days} days after")))
        .when(at_start, F.concat(
            F.col("corridor"), F.lit(f" was already above {threshold} on the first charted day; "), lead.cast("string"),
            F.lit(" days is only a lower bound on the lead")))
        .when(lead >= 0, F.concat(
            F.col("corridor"), F.lit(f" crossed {threshold} on "), text("elevated_at"), F.lit(", "), lead.cast("string"),
            F.lit(" day(s) before the "), move, F.lit("% session on "), text("spiked_at")))
        .otherwise(F.concat(
            F.col("corridor"), F.lit(f" crossed {threshold} on "), text("elevated_at"), F.lit(", "), (-lead).cast("string"),
            F.lit(" day(s) AFTER the price move on "), text("spiked_at"), F.lit(", inside the tolerance")))
    )
    none = F.array().cast("array<struct<start:date,end:date,days:int,peak:double,peak_at:date>>")
    has_event = F.col("spiked_at").isNotNull()
    return (
        windows.select("event", "corridor", "chart_start", "end")
        .join(spikes, "event", "left").join(found, "event", "left").join(levels, "event", "left")
        .select(
            "event", "corridor", "spiked_at", "spike_pct", "before_usd", "after_usd", "elevated_at",
            lead.alias("lead_days"), (has_event & F.coalesce(at_start, F.lit(False))).alias("lead_is_lower_bound"),
            "score_at_start", "score_at_spike", "max_score", F.col("top.day").alias("max_at"),
            F.coalesce("excursions", none).alias("excursions"), F.coalesce("false_alarms", none).alias("false_alarms"),
            verdict.alias("validation"), reason.alias("reason"))
    )


def final_verdict(verdicts: DataFrame, coverage: DataFrame, pending: DataFrame, priced: DataFrame) -> DataFrame:
    """Downgrade to INCOMPLETE while days or articles are missing; no prices is its own verdict.

    ``coverage`` from :func:`pull_coverage`; ``pending`` (event, pending); ``priced`` (event,
    has_prices). The series' own verdict is kept in ``validation_if_complete``.
    """
    gone = F.size("days_missing")
    problems = F.concat_ws(
        "; ",
        F.when(gone > 0, F.concat(gone.cast("string"), F.lit(" pull day(s) not sampled"))),
        F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" in-scope article(s) not yet extracted"))))
    no_prices, short = ~F.col("has_prices"), F.col("problems") != ""
    return (
        verdicts.join(coverage.select("event", "days_missing"), "event").join(pending, "event").join(priced, "event")
        .withColumn("problems", problems).withColumn("series_says", F.col("validation"))
        .withColumn("validation_if_complete", F.when(short & ~no_prices, F.col("series_says")))
        .withColumn("validation", F.when(no_prices, "NO_PRICE_DATA").when(short, "INCOMPLETE").otherwise(F.col("series_says")))
        .withColumn("reason", F.when(no_prices, "no price series").when(
            short, F.concat(F.col("problems"), F.lit(" (series alone says "), F.col("series_says"), F.lit(")")))
            .otherwise(F.col("reason")))
        .drop("days_missing", "pending", "has_prices", "problems", "series_says")
    )
