"""Running values over long ordered lists, and lookups in them, without one task per list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from straitline.session import checkpointed


def running_values(df: DataFrame, keys: list[str], order: list, sums: dict[str, str], maxima: dict[str, str] | None = None,
                   long_lists: bool = True) -> DataFrame:
    """Add ``sums[name] = running sum of column`` and ``maxima`` likewise per key in ``order`` (a total order).

    With ``long_lists`` the rows are range-partitioned by key and order, each range is summed on
    its own and then lifted by the totals of the ranges before it, so a key that holds most of the
    rows is still summed by many tasks. The ranges are materialised once, which keeps the range
    number of a row stable if a task is run again.
    """
    maxima = maxima or {}
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if not long_lists:
        return df.select("*", *[F.sum(col).over(upto).alias(name) for name, col in sums.items()],
                         *[F.max(col).over(upto).alias(name) for name, col in maxima.items()])
    ranged = checkpointed(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()])
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    lifts = totals.select(  # a key may be null
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_b_{n}") for n in maxima])
    inner = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.join(lifts, [F.col("_range") == F.col("_r")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        .select(*df.columns, *[(F.sum(c).over(inner) + F.col(f"_b_{n}")).alias(n) for n, c in sums.items()],
                *[F.greatest(F.max(c).over(inner), F.col(f"_b_{n}")).alias(n) for n, c in maxima.items()])
    )


def running_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, str], long_lists: bool = True) -> DataFrame:
    return running_values(df, keys, order, sums, None, long_lists)


def last_reached(index: DataFrame, asked: DataFrame, keys: list[str], at: str, asked_at: str, payload: list[str],
                 strict: bool = False) -> DataFrame:
    """``asked`` with the ``payload`` of the last index row of its key whose ``at`` is not above ``asked_at`` (below it, if strict).

    ``payload`` must grow along ``at``, its first column strictly; it is null where nothing is reached. Both sides are sorted
    together and read once: the result and all between have as many rows as the two tables, however far a row reaches. Keys
    may be null and meet each other then.
    """
    rows = index.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(int(strict)).alias("_kind"), F.struct(*payload).alias("_hit"))
    asks = asked.select(*keys, F.col(asked_at).cast("double").alias("_at"), F.lit(int(not strict)).alias("_kind"),
                        F.struct(*[F.col(c) for c in asked.columns]).alias("_ask"))
    both = rows.filter("_at IS NOT NULL").unionByName(asks, allowMissingColumns=True)
    found = running_values(both, keys, [F.col("_at"), F.col("_kind")], {}, {"_found": "_hit"})
    return found.filter("_ask IS NOT NULL").select("_ask.*", *[F.col(f"_found.{c}").alias(c) for c in payload])
