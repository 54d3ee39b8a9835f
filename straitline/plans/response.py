"""Disruptions to full response plans: gap, alternatives, arrivals, reserve."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from straitline import constants as K
from straitline.operators import response as R
from straitline.operators.criticality import scenario_table, supply_gap
from straitline.session import checkpointed


def named_or_corridor(disruptions: DataFrame) -> DataFrame:
    """Resolve disruptions that name a scenario; each names exactly one of corridor and scenario."""
    spark = disruptions.sparkSession
    named = scenario_table(spark).select(
        F.col("scenario_id").alias("scenario"), F.col("corridor").alias("s_corridor"), "mechanism",
        F.col("degradation_pct").alias("s_pct"), "supply_reduction")
    joined = disruptions.join(F.broadcast(named), "scenario", "left")  # a fixed list of four
    both = F.col("corridor").isNull() == F.col("scenario").isNull()
    unknown = F.col("scenario").isNotNull() & F.col("mechanism").isNull()
    checked = F.when(both, F.raise_error(F.lit("pass exactly one of corridor or scenario"))) \
        .when(unknown, F.raise_error(F.concat(F.lit("unknown scenario "), F.col("scenario")))).otherwise(F.col("disruption_id"))
    return joined.select(
        "network_id", checked.alias("scenario_id"), F.coalesce("corridor", "s_corridor").alias("corridor"),
        F.when(F.col("scenario").isNull(), F.coalesce("degradation_pct", F.lit(100.0))).otherwise(F.col("s_pct")).alias("degradation_pct"),
        "supply_reduction", F.coalesce("mechanism", F.lit("corridor")).alias("mechanism"), "scenario",
        F.coalesce("duration_days", F.lit(K.DEFAULT_DURATION_DAYS)).alias("duration_days"),
        F.coalesce("crisis", F.lit("normal")).alias("crisis"), F.coalesce("include_sanctioned", F.lit(False)).alias("include_sanctioned"))


def response_plan(edges: DataFrame, disruptions: DataFrame, alternatives: DataFrame, refineries: DataFrame) -> dict[str, DataFrame]:
    """Tables of the plan for any number of disruptions.

    ``disruptions``: disruption_id, network_id, corridor, scenario, degradation_pct, duration_days,
    crisis, include_sanctioned. Returns gaps, affected, ranked, timeline, schedule and reserve.
    """
    gaps, affected = supply_gap(edges, named_or_corridor(disruptions))
    gaps = checkpointed(gaps)  # every later table starts from it
    asked = gaps.select(
        F.col("scenario_id").alias("disruption_id"), "corridor", "crisis", "gap", "duration_days", "include_sanctioned")
    cases = checkpointed(R.rank_cases(asked, alternatives, refineries))
    # Timeline and schedule look up how far down its case's list a disruption goes; the whole lists, one per disruption, are
    # only made if ``ranked`` is read.
    procured = checkpointed(R.procured(asked, cases))
    schedule = R.reserve_drawdown(R.prefix_daily_gap(procured, cases))
    return {
        "gaps": gaps, "affected": affected, "ranked": R.with_coverage(asked, cases),
        "timeline": R.prefix_timeline(procured), "schedule": schedule,
        "reserve": R.reserve_summary(schedule, asked),
    }
