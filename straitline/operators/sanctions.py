"""Actor screening against a sanctions list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from straitline.functions.text import stripped

PIECES = (1, 2, 3, 6, 12)  # a name is looked up by its rarest piece of the largest size it can hold


def _grams(text: Column, size: Column) -> Column:
    """Distinct pieces of ``size`` characters."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substring(text, i, size)))


def screen_actors(actors: DataFrame, sanctions: DataFrame, actor: str = "actor") -> DataFrame:
    """Add ``sanctioned``: the actor's name, trimmed and lower-cased, is part of any listed name.

    Only distinct names are compared. A name that contains the actor's contains every piece of it,
    so an actor meets the listed names that share its rarest piece and no others. Pieces are as long
    as the actor's name allows, up to twelve letters. Empty actors are never sanctioned.
    """
    needle = F.lower(stripped(F.coalesce(F.col(actor), F.lit(""))))
    needles = actors.select(needle.alias("needle")).filter("needle <> ''").distinct().withColumn(
        "size", F.array_max(F.filter(F.array(*map(F.lit, PIECES)), lambda n: n <= F.length("needle"))))
    names = sanctions.select(F.lower("name").alias("listed")).filter("listed <> ''").distinct()
    sizes = names.withColumn("size", F.explode(F.array(*map(F.lit, PIECES)))).filter(F.length("listed") >= F.col("size"))
    pieces = sizes.select("listed", "size", F.explode(_grams(F.col("listed"), F.col("size"))).alias("gram"))
    frequency = pieces.groupBy("size", "gram").agg(F.count("*").alias("names"))
    asked = needles.select("needle", "size", F.explode(_grams(F.col("needle"), F.col("size"))).alias("gram")) \
        .join(frequency, ["size", "gram"], "left")
    rarest = asked.groupBy("needle", "size").agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("pick")) \
        .filter("pick.names > 0").select("needle", "size", "pick.gram")
    hits = rarest.join(pieces, ["size", "gram"]).filter(F.contains("listed", "needle")).select("needle").distinct()
    flagged = actors.withColumn("_needle", needle).join(hits.withColumn("_hit", F.lit(True)), F.col("_needle") == F.col("needle"), "left")
    return flagged.withColumn("sanctioned", F.coalesce("_hit", F.lit(False))).drop("_needle", "needle", "_hit")


def attach_port(refineries: DataFrame, ports: DataFrame) -> DataFrame:
    """Resolve ``connected_port`` by name; ``port_missing`` marks names no port has."""
    known = ports.select(F.col("name").alias("port")).distinct()
    return refineries.join(known, F.col("connected_port") == F.col("port"), "left").withColumn(
        "port_missing", F.col("connected_port").isNotNull() & F.col("port").isNull())
