"""Alternatives, arrival timeline and reserve drawdown for many disruptions at once.

Disruptions: (disruption_id, corridor, crisis, gap, duration_days, include_sanctioned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from straitline import constants as K
from straitline.operators.ordered import last_reached, running_sums, running_values

_EPS = 1e-9
_ID = "disruption_id"


def eligible_alternatives(alternatives: DataFrame, corridor: Column, include_sanctioned: Column) -> DataFrame:
    """Alternatives whose route avoids the corridor (a null corridor excludes none) and may be used."""
    crosses = F.coalesce(F.array_contains("transits_corridors", corridor), F.lit(False))
    return alternatives.filter(~crosses & (include_sanctioned | ~F.col("sanctioned")))


def fleet_compatibility(alternatives: DataFrame, refineries: DataFrame, decimals: int | None = None) -> DataFrame:
    """(api_gravity, sulfur_pct, compat): share of refinery capacity whose window admits each crude.

    Grades and windows are reduced to distinct ones first. A window holds a grade when
    api_min <= api <= api_max and sulfur <= tolerance; windows meet grades through whole-degree
    gravity bands, so no grade is compared with a window far from it.
    """
    grades = alternatives.select("api_gravity", "sulfur_pct").distinct()
    windows = refineries.groupBy("api_gravity_min", "api_gravity_max", "sulfur_tolerance").agg(F.sum("capacity_mbd").alias("cap"))
    # A window open to one side has bands only as far as grades occur.
    span = grades.agg(F.floor(F.min("api_gravity")).alias("low"), F.floor(F.max("api_gravity")).alias("high"))  # one row
    banded = windows.filter("api_gravity_min <= api_gravity_max").join(F.broadcast(span)).withColumns({
        "low": F.greatest("low", F.floor("api_gravity_min")), "high": F.least("high", F.floor("api_gravity_max"))}) \
        .filter("low <= high").withColumn("band", F.explode(F.sequence("low", "high")))
    fits = (
        grades.withColumn("band", F.floor("api_gravity")).join(banded, "band")
        .filter("api_gravity BETWEEN api_gravity_min AND api_gravity_max AND sulfur_pct <= sulfur_tolerance")
        .groupBy("api_gravity", "sulfur_pct").agg(F.sum("cap").alias("fit"))
    )
    total = refineries.agg(F.sum("capacity_mbd").alias("total"))  # one row
    share = F.when(F.col("total") > _EPS, F.coalesce("fit", F.lit(0.0)) / F.col("total")).otherwise(0.0)
    return grades.join(fits, ["api_gravity", "sulfur_pct"], "left").join(F.broadcast(total), how="left").select(
        "api_gravity", "sulfur_pct", F.coalesce(share, F.lit(0.0)).alias("compat"))


def min_max(value: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """Position of ``value`` between ``low`` and ``high``; one when they are equal."""
    score = (value - low) / (high - low)
    return F.when(high == low, 1.0).otherwise(1.0 - score if invert else score)


def _weight(crisis: Column, index: int) -> Column:
    chosen = F.raise_error(F.concat(F.lit("unknown crisis "), crisis))
    for name, weights in K.CRISIS_WEIGHTS.items():
        chosen = F.when(crisis == name, F.lit(weights[index])).otherwise(chosen)
    return chosen


_CASE = ["corridor", "crisis", "include_sanctioned"]


def _cases(disruptions: DataFrame) -> DataFrame:
    """Distinct (corridor, crisis, include_sanctioned): all that scores depend on, however many disruptions."""
    return disruptions.select("corridor", "crisis", F.coalesce("include_sanctioned", F.lit(False)).alias("include_sanctioned")).distinct()


def score_alternatives(disruptions: DataFrame, alternatives: DataFrame, refineries: DataFrame) -> DataFrame:
    """Component scores and total of every alternative, once per case the disruptions ask for.

    A case is (corridor, crisis, include_sanctioned). Bounds are taken over what is eligible for the
    case, by aggregation and not by window, so a case's alternatives never gather in one task.
    """
    # One row: at most corridors x crises x 2 cases.
    listed = _cases(disruptions).agg(F.collect_list(F.struct(*_CASE)).alias("cases"))
    candidates = alternatives.join(F.broadcast(listed), how="left").withColumn("c", F.explode("cases")).select(
        *alternatives.columns, "c.*")
    eligible = eligible_alternatives(candidates, F.col("corridor"), F.col("include_sanctioned"))
    bounds = eligible.groupBy(*_CASE).agg(
        F.min("price_premium_usd").alias("p0"), F.max("price_premium_usd").alias("p1"),
        F.min("transit_days").alias("t0"), F.max("transit_days").alias("t1")) \
        .withColumnsRenamed({c: f"b_{c}" for c in _CASE})
    compat = fleet_compatibility(alternatives, refineries)
    c = F.col
    same_case = [c(k).eqNullSafe(c(f"b_{k}")) for k in _CASE]
    return (
        eligible.join(bounds, same_case).join(compat, ["api_gravity", "sulfur_pct"])
        .withColumn("cost_score", min_max(c("price_premium_usd"), c("p0"), c("p1"), invert=True))
        .withColumn("transit_score", min_max(c("transit_days"), c("t0"), c("t1"), invert=True))
        .withColumnRenamed("compat", "compat_score")
        .withColumn("score", _weight(c("crisis"), 0) * c("cost_score") + _weight(c("crisis"), 1) * c("transit_score")
                    + _weight(c("crisis"), 2) * c("compat_score"))
        .drop("p0", "p1", "t0", "t1", *[f"b_{k}" for k in _CASE])
    )


def rank_cases(disruptions: DataFrame, alternatives: DataFrame, refineries: DataFrame, long_lists: bool = True) -> DataFrame:
    """Scored alternatives of every case in rank order (score, then name) with running volume and slowest arrival so far."""
    scored = score_alternatives(disruptions, alternatives, refineries).withColumn("_one", F.lit(1))
    return running_values(scored, _CASE, [F.desc("score"), F.col("name")],
                          {"place": "_one", "cumulative_coverage": "max_incremental_mbd"}, {"slowest_days": "transit_days"}, long_lists).drop("_one")


def procured(disruptions: DataFrame, ranked_cases: DataFrame) -> DataFrame:
    """Disruptions with the place, volume and slowest arrival at which their case's list (``rank_cases``) covers the gap.

    A disruption is answered by a prefix of its case's list: all alternatives before which the gap is still open. Its end is
    looked up in the running volumes, so that no disruption ever meets the alternatives one by one. Volumes are at least 0.
    """
    index = ranked_cases.withColumn("before", F.col("cumulative_coverage") - F.col("max_incremental_mbd"))
    asked = disruptions.withColumn("include_sanctioned", F.coalesce("include_sanctioned", F.lit(False))).withColumn("_open", F.col("gap") - _EPS)
    return last_reached(index, asked, _CASE, "before", "_open", ["place", "cumulative_coverage", "slowest_days"], strict=True).drop("_open")


def prefix_timeline(procured_rows: DataFrame) -> DataFrame:
    """What ``replacement_timeline`` gives, from the ends of the prefixes (``procured``)."""
    covered = F.coalesce("cumulative_coverage", F.lit(0.0))
    return procured_rows.select(
        _ID, F.col("slowest_days").alias("transit_days"), F.coalesce(F.col("place").cast("long"), F.lit(0)).alias("alternatives_used"),
        covered.alias("covered"), F.greatest(F.lit(0.0), F.col("gap") - covered).alias("residual_gap"),
        (covered >= F.col("gap") - _EPS).alias("covers_gap"))


def prefix_daily_gap(procured_rows: DataFrame, ranked_cases: DataFrame) -> DataFrame:
    """What ``daily_gap`` gives, from the ends of the prefixes: what landed on a day is looked up in running volumes by day of arrival."""
    by_day = running_sums(
        ranked_cases.select(*_CASE, "place", F.greatest(F.lit(0), F.col("transit_days")).cast("int").alias("day"), "max_incremental_mbd"),
        [*_CASE, "day"], [F.col("place")], {"landed": "max_incremental_mbd"}).withColumnRenamed("place", "_upto")
    grid = procured_rows.select(_ID, "gap", "place", *_CASE, F.explode(F.sequence(F.lit(0), F.col("duration_days") - 1)).alias("day")) \
        .withColumn("place", F.coalesce("place", F.lit(0)))
    arrived = last_reached(by_day, grid, [*_CASE, "day"], "_upto", "place", ["_upto", "landed"])
    landed = F.coalesce(F.sum("landed").over(W.partitionBy(_ID).orderBy("day")), F.lit(0.0))
    return arrived.select(_ID, "day", F.greatest(F.lit(0.0), F.col("gap") - landed).alias("gap"))


def per_disruption(disruptions: DataFrame, ranked_cases: DataFrame) -> DataFrame:
    """The list of each disruption's case, once per disruption."""
    asked = disruptions.select(_ID, "gap", *[(F.coalesce(c, F.lit(False)) if c == "include_sanctioned" else F.col(c)).alias(f"d_{c}") for c in _CASE])
    same = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in _CASE]
    return ranked_cases.join(asked, same).drop(*[f"d_{c}" for c in _CASE])


def rank_alternatives(disruptions: DataFrame, alternatives: DataFrame, refineries: DataFrame,
                      long_lists: bool = True) -> DataFrame:
    """Every eligible alternative of every disruption in rank order, with running coverage of its gap."""
    return with_coverage(disruptions, rank_cases(disruptions, alternatives, refineries, long_lists))


def with_coverage(disruptions: DataFrame, ranked_cases: DataFrame) -> DataFrame:
    ranked = per_disruption(disruptions, ranked_cases)
    pct = F.when(F.col("gap") <= _EPS, 100.0).otherwise(F.least(F.lit(100.0), F.col("cumulative_coverage") / F.col("gap") * 100.0))
    return ranked.withColumn("cumulative_coverage_pct", pct).withColumn(
        "covers_gap", F.col("cumulative_coverage") >= F.col("gap") - _EPS)


def used_alternatives(ranked: DataFrame) -> DataFrame:
    """Alternatives procured in rank order until the gap is covered."""
    before = F.col("cumulative_coverage") - F.col("max_incremental_mbd")
    return ranked.filter(before < F.col("gap") - _EPS)


def replacement_timeline(disruptions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per disruption: slowest arrival, covered and residual gap, alternatives used."""
    used = used_alternatives(ranked)
    totals = used.groupBy(_ID).agg(
        F.max("transit_days").alias("transit_days"), F.sum("max_incremental_mbd").alias("covered"),
        F.count("*").alias("alternatives_used"))
    covered = F.coalesce("covered", F.lit(0.0))
    return disruptions.select(_ID, "gap").join(totals, _ID, "left").select(
        _ID, "transit_days", F.coalesce("alternatives_used", F.lit(0)).alias("alternatives_used"), covered.alias("covered"),
        F.greatest(F.lit(0.0), F.col("gap") - covered).alias("residual_gap"), (covered >= F.col("gap") - _EPS).alias("covers_gap"))


def daily_gap(disruptions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(disruption_id, day, gap): what is still open on each day; a cargo counts from day = transit days.

    Arrivals are summed per day first, then over the days of the horizon.
    """
    grid = disruptions.withColumn("day", F.explode(F.sequence(F.lit(0), F.col("duration_days") - 1))).select(
        _ID, F.col("gap").alias("full_gap"), "day")
    arrivals = used_alternatives(ranked).groupBy(_ID, F.greatest(F.lit(0), F.col("transit_days")).alias("day")).agg(
        F.sum("max_incremental_mbd").alias("landed"))
    landed = F.coalesce(F.sum("landed").over(W.partitionBy(_ID).orderBy("day")), F.lit(0.0))
    return grid.join(arrivals, [_ID, "day"], "left").withColumn("landed", landed).select(
        _ID, "day", F.greatest(F.lit(0.0), F.col("full_gap") - F.col("landed")).alias("gap"))


def constant_gap(disruptions: DataFrame) -> DataFrame:
    """(disruption_id, day, gap): the full gap until ``transit_days``, nothing after."""
    grid = disruptions.withColumn("day", F.explode(F.sequence(F.lit(0), F.col("duration_days") - 1)))
    return grid.select(_ID, "day", F.when(F.col("day") < F.col("transit_days"), F.col("gap")).otherwise(0.0).alias("gap"))


def reserve_drawdown(profile: DataFrame, total: float = K.RESERVE_TOTAL_MB, floor: float = K.RESERVE_FLOOR_SHARE,
                     rate: float = K.RESERVE_RATE_MBD, key: str = _ID) -> DataFrame:
    """Daily release over a per-day gap (key, day, gap): release, unmet, cumulative release.

    The reserve is used fully, then the worst daily shortfall is as small as it can be, then
    earlier days are served first. In closed form: what the rate limit leaves open is fixed; the
    rest of the shortfall may reach a common level, the lowest at which it fits; below that level
    it is poured from the last day backwards. A horizon has at most MAX_HORIZON_DAYS days.
    """
    if not 0 <= floor < 1:
        raise ValueError(f"floor must be in [0, 1), got {floor}")
    if rate <= 0:
        raise ValueError(f"rate must be > 0, got {rate}")
    available = total * (1.0 - floor)
    every = W.partitionBy(key)
    ascending = W.partitionBy(key).orderBy("gap", "day")
    reverse = W.partitionBy(key).orderBy(F.desc("day"))
    onward = W.partitionBy(key).orderBy("day")
    c = F.col
    rows = (
        profile.withColumn("gap", F.when(c("gap") < 0, F.raise_error(F.lit("gap must be >= 0"))).otherwise(c("gap")))
        .withColumn("days", F.count("*").over(every))
        .withColumn("days", F.when(c("days") > K.MAX_HORIZON_DAYS, F.raise_error(
            F.lit(f"a horizon has at most {K.MAX_HORIZON_DAYS} days"))).otherwise(c("days")))
        .withColumn("forced", F.greatest(F.lit(0.0), c("gap") - rate))
        .withColumn("deliverable", F.least(c("gap"), F.lit(rate)))
        .withColumn("required", F.sum("gap").over(every))
        .withColumn("used", F.least(F.lit(available), F.sum("deliverable").over(every)))
        .withColumn("short", F.greatest(F.lit(0.0), c("required") - c("used")))
        .withColumn("before", F.coalesce(F.sum("gap").over(ascending.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", c("days") - F.row_number().over(ascending) + 1)
        # Lowest level w with sum(min(gap, w)) = short: the first row in gap order that can reach it.
        .withColumn("level", F.min(F.when(
            c("before") + c("gap") * c("left") >= c("short") - 1e-12, (c("short") - c("before")) / c("left"))).over(every))
    )
    first_fit = F.min(F.when(c("before") + c("gap") * c("left") >= c("short") - 1e-12, F.struct("gap", "day", F.greatest(
        F.lit(0.0), (c("short") - c("before")) / c("left")).alias("w")))).over(every)
    rows = rows.withColumn("level", F.coalesce(first_fit["w"], F.lit(0.0))) \
        .withColumn("peak", F.greatest(c("level"), F.max("forced").over(every))) \
        .withColumn("room", F.least(c("gap"), c("peak")) - c("forced")) \
        .withColumn("pour", F.greatest(F.lit(0.0), c("short") - F.sum("forced").over(every))) \
        .withColumn("later", F.coalesce(F.sum("room").over(reverse.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("unmet", c("forced") + F.greatest(F.lit(0.0), F.least(c("room"), c("pour") - c("later")))) \
        .withColumn("release", F.greatest(F.lit(0.0), c("gap") - c("unmet"))) \
        .withColumn("released", F.sum("release").over(onward))
    return rows.select(key, "day", "gap", "release", "unmet", "released")


def reserve_summary(schedule: DataFrame, initial: DataFrame | None = None, total: float = K.RESERVE_TOTAL_MB,
                    floor: float = K.RESERVE_FLOOR_SHARE, rate: float = K.RESERVE_RATE_MBD, key: str = _ID) -> DataFrame:
    """Totals of each schedule, the day the reserve runs dry with need still open, and days of cover.

    ``initial`` (key, gap) is the gap that days of cover refer to; without it, the first day's gap.
    """
    available = total * (1.0 - floor)
    later = F.max("unmet").over(W.partitionBy(key).orderBy("day").rowsBetween(1, W.unboundedFollowing))
    dry = (F.col("released") >= available - 1e-6) & (F.col("later_unmet") > 1e-6)
    out = schedule.withColumn("later_unmet", later).groupBy(key).agg(
        F.sum("release").alias("total_released"), F.sum("unmet").alias("total_unmet"), F.sum("gap").alias("required"),
        F.count_if(F.col("gap") > _EPS).alias("bridge_days"), F.max_by("gap", "day").alias("gap_at_horizon_end"),
        F.min(F.when(dry, F.col("day"))).alias("reserve_exhausted_day"), F.min_by("gap", "day").alias("first_gap"))
    if initial is not None:
        out = out.drop("first_gap").join(initial.select(key, F.col("gap").alias("first_gap")), key)
    speed = F.least(F.col("first_gap"), F.lit(rate))
    return out.withColumn("insufficient", F.col("total_unmet") > 1e-6) \
        .withColumn("gap_covered_pct", F.when(F.col("required") <= _EPS, 100.0).otherwise(
            F.least(F.lit(100.0), F.col("total_released") / F.col("required") * 100.0))) \
        .withColumn("available", F.lit(available)) \
        .withColumn("days_of_cover", F.when(speed > _EPS, available / speed)).drop("first_gap")
