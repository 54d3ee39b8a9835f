"""One live run: events to scores, scores to networks, triggered corridors to response plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from straitline import constants as K
from straitline.operators.criticality import check_threshold, corridor_criticality, triggered
from straitline.operators.flow import flow_value
from straitline.operators.network import apply_risk
from straitline.operators.scoring import score_corridors
from straitline.plans.response import response_plan
from straitline.session import checkpointed


def live_run(events: DataFrame, corridors: DataFrame, edges: DataFrame, alternatives: DataFrame,
             refineries: DataFrame, now: Column, duration_days: int = K.DEFAULT_DURATION_DAYS) -> dict[str, DataFrame]:
    """Tables of a run: scores, criticality, evaluated, triggered and the plan of every triggered network."""
    scores = checkpointed(score_corridors(events, corridors, now))
    risk = scores.select("corridor", F.col("score").alias("risk"))
    risky = checkpointed(apply_risk(edges, risk))
    criticality = checkpointed(corridor_criticality(risky, risk))
    evaluated = check_threshold(criticality, flow_value(risky))
    fired = checkpointed(triggered(evaluated))
    disruptions = fired.filter("threshold_crossed").select(
        F.concat(F.lit("trigger:"), F.col("network_id")).alias("disruption_id"), "network_id",
        F.col("triggered_corridor").alias("corridor"), F.lit(None).cast("string").alias("scenario"),
        F.lit(100.0).alias("degradation_pct"), F.lit(duration_days).alias("duration_days"),
        F.lit("normal").alias("crisis"), F.lit(False).alias("include_sanctioned"))
    return {"scores": scores.withColumn("computed_at", now), "criticality": criticality, "evaluated": evaluated,
            "triggered": fired, **response_plan(risky, disruptions, alternatives, refineries)}
