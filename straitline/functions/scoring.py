"""Weights and normalisations of risk events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from straitline import constants as K
from straitline.functions.times import age_days


def event_weight(severity: Column, confidence: Column, ts: Column, now: Column,
                 decay: float = K.DECAY_PER_DAY) -> Column:
    return severity * confidence * F.exp(-F.lit(decay) * age_days(ts, now))


def normalize_severity(raw: Column, baseline: Column) -> Column:
    """Bounded statistic to [baseline, 1]: no events means exactly the baseline."""
    return F.when(raw > 0, baseline + (1.0 - baseline) * F.least(F.lit(1.0), raw / K.MAX_EVENT_WEIGHT)).otherwise(baseline)


def normalize_saturating(raw: Column, baseline: Column, k: float = K.SATURATION_K) -> Column:
    return F.when(raw > 0, baseline + (1.0 - baseline) * (1.0 - F.exp(-raw / k))).otherwise(baseline)


def formula_label(computed_at: Column) -> Column:
    return F.when(
        computed_at >= F.lit(K.FORMULA_CHANGED_ON).cast("timestamp"), F.lit("top3pad")
    ).otherwise(F.lit("sum_saturating"))
