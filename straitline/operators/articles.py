"""Articles, slice coverage and sampling reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from straitline import constants as K
from straitline.functions.times import floor_to_slice, slices_between
from straitline.sources.stores import first_sightings


def dedupe_by_url(*tables: DataFrame, order: list[str]) -> DataFrame:
    """Union of article tables keeping the first sighting of each URL (table order, then ``order``)."""
    union = None
    for place, table in enumerate(tables):
        placed = table.withColumn("table_no", F.lit(place))
        union = placed if union is None else union.unionByName(placed)
    return first_sightings(union, ["table_no", *order]).drop("table_no")


def expected_slices(windows: DataFrame) -> DataFrame:
    """(window_id, slice_ts) of every slice of windows (window_id, start, end)."""
    return windows.select("window_id", F.explode(slices_between(F.col("start"), F.col("end"))).alias("slice_ts"))


def slice_coverage(expected: DataFrame, read: DataFrame, articles: DataFrame, corridors: DataFrame) -> DataFrame:
    """Per window and corridor: slices read of expected, articles kept, status.

    ``read`` holds the (slice_ts) that could be read; ``articles`` (slice_ts, corridor) the matches.
    A window with less than half its slices is not sampled: every corridor is an error and its
    articles do not count.
    """
    seen = read.select("slice_ts").distinct().withColumn("was_read", F.lit(1))
    totals = expected.join(seen, "slice_ts", "left").groupBy("window_id").agg(
        F.count("was_read").alias("slices_read"), F.count("*").alias("slices_total"))
    per_slice = articles.groupBy("slice_ts", "corridor").agg(F.count("*").alias("n"))
    matched = expected.join(per_slice, "slice_ts").groupBy("window_id", "corridor").agg(F.sum("n").alias("n"))
    names = corridors.select(F.col("name").alias("corridor")).agg(F.collect_set("corridor").alias("names"))
    grid = totals.crossJoin(F.broadcast(names)).withColumn("corridor", F.explode("names")).drop("names")
    sampled = F.col("slices_read") >= K.MIN_SLICE_COVERAGE * F.col("slices_total")
    kept = F.when(sampled, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    return grid.join(matched, ["window_id", "corridor"], "left").select(
        "window_id", "corridor", "slices_read", "slices_total", kept.alias("articles"),
        F.when(~sampled, K.STATUS_ERROR).when(kept > 0, K.STATUS_OK).otherwise(K.STATUS_EMPTY).alias("status"))


def read_slice_stamps(lines: DataFrame) -> DataFrame:
    return lines.filter("readable").select(floor_to_slice(F.col("slice_ts")).alias("slice_ts")).distinct()


def is_sampled(status: Column) -> Column:
    """A corridor whose request failed or never ran was not sampled; an empty answer was."""
    return ~status.isin(*K.FAILED_STATUSES, K.STATUS_NOT_ATTEMPTED)


def sampling_report(corridors: DataFrame, fetches: DataFrame, stored: DataFrame) -> DataFrame:
    """Per corridor: fetched and stored counts, status and whether it was sampled.

    ``fetches`` (corridor, status, fetched); ``stored`` holds one (corridor) row per created article.
    """
    counts = stored.groupBy("corridor").agg(F.count("*").alias("stored"))
    status = F.coalesce("status", F.lit(K.STATUS_ERROR))
    return (
        corridors.select(F.col("name").alias("corridor")).join(fetches, "corridor", "left").join(counts, "corridor", "left")
        .select("corridor", F.coalesce("fetched", F.lit(0)).alias("fetched"),
                F.coalesce("stored", F.lit(0)).alias("stored"), status.alias("status"),
                is_sampled(status).alias("sampled"))
    )


def source_precedence(primary: DataFrame, bulk: DataFrame) -> DataFrame:
    """Combine the primary path with the bulk path per run.

    When any corridor of a run was not sampled by the primary path, the bulk path counts for all
    its corridors. Both tables: (run_id, corridor, fetched, stored, status, sampled); ``primary``
    also has ``place``, the order in which corridors were asked. After the first failure no
    further corridor was asked.
    """
    failures = primary.filter(~F.col("sampled")).groupBy("run_id").agg(F.min("place").alias("failed_at"))
    p = primary.join(failures, "run_id", "left")
    asked = F.col("failed_at").isNull() | (F.col("place") <= F.col("failed_at"))
    p = p.select(
        "run_id", "corridor", F.col("failed_at").isNotNull().alias("fell_back"),
        F.when(asked, F.col("fetched")).otherwise(0).alias("fetched"),
        F.when(asked, F.col("stored")).otherwise(0).alias("stored"),
        F.when(asked, F.col("status")).otherwise(K.STATUS_NOT_ATTEMPTED).alias("doc_status"),
        (asked & F.col("sampled")).alias("doc_sampled"))
    b = bulk.select("run_id", "corridor", F.col("fetched").alias("b_fetched"), F.col("stored").alias("b_stored"),
                    F.col("status").alias("b_status"), F.col("sampled").alias("b_sampled"))
    both, back = p.join(b, ["run_id", "corridor"], "left"), F.col("fell_back")
    added = lambda c: F.when(back, F.coalesce(f"b_{c}", F.lit(0))).otherwise(0)
    return both.select(
        "run_id", "corridor", (F.col("fetched") + added("fetched")).alias("fetched"),
        (F.col("stored") + added("stored")).alias("stored"),
        F.when(F.col("doc_sampled") | ~back, F.col("doc_status"))
        .otherwise(F.coalesce("b_status", F.lit(K.STATUS_ERROR))).alias("status"),
        (F.col("doc_sampled") | (back & F.coalesce("b_sampled", F.lit(False)))).alias("sampled"),
        F.when(~back, "doc").when(F.col("doc_sampled"), "doc+gkg").otherwise("gkg").alias("path"),
        "doc_status")
