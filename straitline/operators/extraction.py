"""Model replies to typed events, and event timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from straitline import constants as K
from straitline.functions.text import parse_seendate, stripped


def _kind(field: Column) -> Column:
    return F.schema_of_variant(field)


def _text(variant: Column, name: str) -> Column:
    """A field as text; empty, zero, false and missing fields count as missing."""
    field = F.try_variant_get(variant, f"$.{name}", "variant")
    nested = _kind(field).startswith("ARRAY") | _kind(field).startswith("OBJECT")
    text = F.when(nested, F.to_json(field)).otherwise(F.try_variant_get(variant, f"$.{name}", "string"))
    return F.when(_truthy(variant, name), text)


def _truthy(variant: Column, name: str) -> Column:
    """Non-empty text (even "false"), non-zero number, true, or a non-empty list or object."""
    path = f"$.{name}"
    field = F.try_variant_get(variant, path, "variant")
    kind = _kind(field)
    as_text = F.try_variant_get(variant, path, "string")
    return F.coalesce(
        F.when(kind == "STRING", F.length(as_text) > 0)
        .when(kind == "BOOLEAN", F.try_variant_get(variant, path, "boolean"))
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(field).isin("[]", "{}"))
        .otherwise(F.try_variant_get(variant, path, "double") != 0.0),
        F.lit(False))


def _number(variant: Column, name: str, default: float) -> Column:
    """A number, or text that reads as one; ``default`` for anything else."""
    field = F.try_variant_get(variant, f"$.{name}", "variant")
    scalar = F.when(
        _kind(field) == "BOOLEAN", F.try_variant_get(variant, f"$.{name}", "boolean").cast("double")
    ).when(_kind(field) == "STRING", stripped(F.try_variant_get(variant, f"$.{name}", "string")).try_cast("double")
    ).otherwise(F.try_variant_get(variant, f"$.{name}", "double"))
    return F.coalesce(scalar, F.lit(default))


def coerce_extractions(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Add ``parsed``: corridor, actor, event_type, severity, confidence, is_relevant; null if unusable.

    A reply that is not JSON is searched for its outermost braces. A JSON value that is not an
    object is unusable.
    """
    reply = F.col(reply_col)
    whole = F.try_parse_json(reply)
    block = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    variant = F.when(F.length(reply) > 0, F.coalesce(whole, block))
    aliases = F.create_map(*[F.lit(part) for pair in K.CORRIDOR_ALIASES.items() for part in pair])
    v = F.col("_v")
    named = stripped(F.coalesce(_text(v, "corridor"), F.lit(K.NO_CORRIDOR)))
    corridor = F.coalesce(F.try_element_at(aliases, F.lower(named)), named)
    kind = F.lower(stripped(F.coalesce(_text(v, "event_type"), F.lit("other"))))
    severity = _number(v, "severity", 1.0)
    confidence = _number(v, "confidence", 0.1)
    clamped = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    return (
        df.withColumn("_v", variant)
        .withColumn("parsed", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.struct(
            F.when(corridor.isin(*K.CORRIDOR_VALUES), corridor).otherwise(K.NO_CORRIDOR).alias("corridor"),
            F.substring(F.coalesce(_text(v, "actor"), F.lit("unknown")), 1, K.ACTOR_LIMIT).alias("actor"),
            F.when(kind.isin(*K.EVENT_TYPE_VALUES), kind).otherwise("other").alias("event_type"),
            F.when(F.isnan(severity), F.lit(1)).otherwise(clamped(severity, 1.0, 5.0).cast("int")).alias("severity"),
            clamped(confidence, 0.0, 1.0).alias("confidence"),
            _truthy(v, "is_relevant").alias("is_relevant"))))
        .drop("_v")
    )


def classify_extractions(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Add ``outcome`` and ``processed``; a failed call stays unprocessed, so it is retried."""
    outcome = (
        F.when(F.col(reply_col).isNull(), "call_failed").when(F.col("parsed").isNull(), "unparseable")
        .when(~F.col("parsed.is_relevant"), "irrelevant").otherwise("event")
    )
    return df.withColumn("outcome", outcome).withColumn("processed", F.col("outcome") != "call_failed")


def to_events(classified: DataFrame, corridors: DataFrame) -> DataFrame:
    """Event rows of relevant articles, dated by their text, else by ingest time."""
    names = corridors.select(F.col("name").alias("corridor"))
    rows = classified.filter("outcome = 'event'").select(
        F.col("parsed.corridor").alias("named"), "parsed.actor", "parsed.event_type", "parsed.severity",
        "parsed.confidence", event_timestamp(F.col("raw_text"), F.col("ingested_at")).alias("ts"),
        F.col("url").alias("article_url"), "title")
    return rows.join(names, F.col("named") == F.col("corridor"), "left").drop("named")


def event_timestamp(raw_text: Column, ingested_at: Column) -> Column:
    return F.coalesce(parse_seendate(raw_text), ingested_at)


def extraction_report(classified: DataFrame, *keys: str) -> DataFrame:
    count = lambda name: F.count_if(F.col("outcome") == name)
    return classified.groupBy(*keys).agg(
        F.count("*").alias("articles"), count("event").alias("events"), count("irrelevant").alias("irrelevant"),
        count("unparseable").alias("unparseable"), count("call_failed").alias("call_failed"))


def attribute_source(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Add the ``source`` of each event's article; null when the article is gone."""
    known = articles.groupBy("url").agg(F.min("source").alias("source"))
    return events.join(known, events["article_url"] == known["url"], "left").drop("url")


def repoint_timestamps(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Move events to their article's date when it differs by a minute or more.

    Adds ``seen_at``, ``shift_days`` and ``change`` (no_date, unchanged, moved).
    """
    dated = articles.groupBy("url").agg(F.max(parse_seendate(F.col("raw_text"))).alias("seen_at"))
    joined = events.join(dated, events["article_url"] == dated["url"], "left").drop("url")
    shift = (F.unix_micros("ts") - F.unix_micros("seen_at")) / F.lit(86_400_000_000.0)
    change = (
        F.when(F.col("seen_at").isNull(), "no_date").when(F.abs("shift_days") < 1.0 / 1440.0, "unchanged")
        .otherwise("moved")
    )
    return (
        joined.withColumn("shift_days", shift).withColumn("change", change)
        .withColumn("ts", F.when(F.col("change") == "moved", F.col("seen_at")).otherwise(F.col("ts")))
    )


def timestamp_shift_stats(repointed: DataFrame, *keys: str) -> DataFrame:
    """Counts per change, and min, upper median and max shift of the moved events.

    The median is exact: hourly counts locate the hour that holds the middle rank, and only the
    distinct values of that hour are ranked.
    """
    moved = F.col("change") == "moved"
    stats = repointed.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(F.col("change") == "no_date").alias("no_date"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged"), F.count_if(moved).alias("moved"),
        F.min(F.when(moved, F.col("shift_days"))).alias("min_shift"),
        F.max(F.when(moved, F.col("shift_days"))).alias("max_shift"),
        F.count_if(moved & (F.col("shift_days") >= 1.0)).alias("stale"))
    shifts = repointed.filter(moved).select(*keys, "shift_days", F.floor(F.col("shift_days") * 24).alias("hour"))
    hours = shifts.groupBy(*keys, "hour").agg(F.count("*").alias("n"))
    middle = F.floor(F.sum("n").over(W.partitionBy(*keys)) / 2)
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("hour"))
    home = (
        hours.withColumn("middle", middle).withColumn("upto", upto)
        .filter("upto > middle AND upto - n <= middle")
        .select(*keys, "hour", (F.col("middle") - F.col("upto") + F.col("n")).alias("rank"))
    )
    values = shifts.groupBy(*keys, "hour", "shift_days").agg(F.count("*").alias("n"))
    median = (
        values.join(home, [*keys, "hour"])
        .withColumn("upto", F.sum("n").over(W.partitionBy(*keys).orderBy("shift_days")))
        .filter("upto > rank").groupBy(*keys).agg(F.min("shift_days").alias("median_shift"))
    )
    return stats.join(median, list(keys), "left") if keys else stats.join(median, how="left")
