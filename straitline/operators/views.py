"""Read views of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from straitline.functions.scoring import formula_label


def latest_events(events: DataFrame, corridor: str | None = None, limit: int = 50) -> DataFrame:
    """Newest events first."""
    if not 1 <= limit <= 500:
        raise ValueError(f"limit must be in 1..500, got {limit}")
    chosen = events if corridor is None else events.filter(F.col("corridor") == corridor)
    return chosen.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def risk_history(history: DataFrame, now: Column, corridor: str | None = None, days: int | None = None) -> DataFrame:
    """Score rows, oldest first, with the formula each was computed by."""
    chosen = history if corridor is None else history.filter(F.col("corridor") == corridor)
    if days is not None:
        chosen = chosen.filter(F.col("computed_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return chosen.withColumn("formula", formula_label(F.col("computed_at"))).orderBy("computed_at", "corridor")
