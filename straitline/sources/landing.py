"""Readers of landed files: bulk slices, search replies, feeds, lists, prices, network seed."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from straitline import constants as K, schemas
from straitline.functions import text as X

_STAMP = re.compile(r"(\d{14})")
_LINES_PER_BATCH = 20_000


def _archive_text(content: bytes, path: str):
    """Text of the first archive member (or of a plain file); None when unreadable."""
    if not path.endswith(".zip"):
        return content.decode("utf-8", errors="replace")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
            return archive.read(names[0]).decode("utf-8", errors="replace") if names else None
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError, OSError):
        return None


def unzip_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            name = path.rsplit("/", 1)[-1]
            stamp = _STAMP.search(name)
            slice_ts = pd.to_datetime(stamp.group(1), format="%Y%m%d%H%M%S", errors="coerce") if stamp else pd.NaT
            text = _archive_text(content, name)
            lines = [None] if text is None else text.split("\n")
            for start in range(0, len(lines), _LINES_PER_BATCH):
                part = lines[start : start + _LINES_PER_BATCH]
                yield pd.DataFrame({
                    "path": path, "slice_ts": slice_ts,
                    "line_no": range(start, start + len(part)), "line": part,
                    "readable": text is not None,
                })


def slices_to_lines(files: DataFrame) -> DataFrame:
    """binaryFile rows to numbered lines; an unreadable archive is one row with ``readable`` false."""
    return files.select("path", "content").mapInPandas(unzip_slices, schemas.SLICE_LINES)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    return slices_to_lines(spark.read.format("binaryFile").load(path))


def parse_slices(lines: DataFrame) -> DataFrame:
    """Usable rows of slice lines: url, title, domain, themes, seen_at, published_at.

    Fields are split on tabs only; short, translated, untitled and unaddressed rows are dropped.
    """
    field = lambda i: F.get("f", F.lit(i))
    rows = (
        lines.filter(X.stripped(F.col("line")) != "")
        .withColumn("f", F.split("line", "\t", -1))
        .filter((F.size("f") >= K.SLICE_COLUMNS) & (X.stripped(field(25)) == ""))
        .select(
            "path", "slice_ts", "line_no", X.stripped(field(4)).alias("url"),
            X.extract_tag(field(26), "PAGE_TITLE").alias("raw_title"),
            X.stripped(field(3)).alias("domain"), field(7).alias("themes"),
            X.parse_compact_ts(field(1)).alias("seen_at"),
            X.parse_compact_ts(X.extract_tag(field(26), "PAGE_PRECISEPUBTIMESTAMP")).alias("published_at"))
        .filter("url <> '' AND raw_title <> ''")
    )
    return (
        rows.withColumn("title", F.substring(X.html_unescape("raw_title"), 1, K.TITLE_LIMIT))
        .filter("title <> ''")
        .select("path", "slice_ts", "line_no", "url", "title", "domain", "themes", "seen_at", "published_at")
    )


def match_slices(rows: DataFrame) -> DataFrame:
    """Parsed slice rows that belong to a corridor, as articles under their first match."""
    return (
        rows.withColumn("matches", X.match_corridors(F.col("title"), F.col("url"), F.col("themes")))
        .withColumn("corridor", X.first_corridor(F.col("matches")))
        .filter("corridor IS NOT NULL")
        .withColumn("source", F.lit(K.SOURCE_BULK))
        .withColumn("raw_text", X.bulk_raw_text(
            F.col("title"), F.col("corridor"), F.col("domain"), F.col("published_at"), F.col("seen_at")))
    )


def read_search_dump(spark: SparkSession, path: str, corridor: str | None = None) -> DataFrame:
    """Articles of landed search replies (one JSON document per file)."""
    replies = spark.read.schema(schemas.SEARCH_DUMP).json(path, multiLine=True)
    items = replies.select(F.posexplode("articles").alias("pos", "a")).select("pos", "a.*")
    title = X.stripped(F.coalesce(F.col("title"), F.lit("")))
    hint = F.lit(corridor).cast("string")
    return (
        items.withColumn("title", title)
        .filter(X.present(F.col("url")).isNotNull() & (F.col("title") != ""))
        .select(
            "pos", "url", F.lit(K.SOURCE_SEARCH).alias("source"),
            F.substring("title", 1, K.TITLE_LIMIT).alias("title"), hint.alias("corridor"),
            X.search_raw_text(F.col("title"), hint, F.col("domain"), F.col("sourcecountry"),
                              F.col("seendate")).alias("raw_text"))
    )


def feed_articles(entries: DataFrame, limit: int = K.FEED_LIMIT) -> DataFrame:
    """First ``limit`` entries of each feed as articles; unaddressed or untitled ones are dropped."""
    first = W.partitionBy("feed").orderBy("pos")
    kept = entries.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
    title = X.stripped(F.coalesce(F.col("title"), F.lit("")))
    body = F.coalesce(X.present(F.col("summary")), X.present(F.col("description")), F.col("title"))
    return (
        kept.withColumn("title", title)
        .filter(X.present(F.col("link")).isNotNull() & (F.col("title") != ""))
        .select(
            "feed", "pos", F.col("link").alias("url"), F.col("feed").alias("source"),
            F.substring("title", 1, K.TITLE_LIMIT).alias("title"),
            X.feed_raw_text(body, F.coalesce("published", "updated")).alias("raw_text"))
    )


def read_feed_entries(spark: SparkSession, path: str, limit: int = K.FEED_LIMIT) -> DataFrame:
    return feed_articles(spark.read.schema(schemas.FEED_ENTRIES).json(path), limit)


def read_sanctions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless sanctions list; null cells become empty, short and unnamed rows are dropped."""
    columns = schemas.SANCTIONS.fieldNames().index("program") + 1
    lines = spark.read.text(path)
    # An empty cell and a missing one both parse as null: whether a row is short is told by its commas outside quotes.
    # Possessive, so that a long quoted cell is passed without recursion.
    cells = F.size(F.split(F.regexp_replace("value", '"[^"]*+(?:""[^"]*+)*+"', "q"), ",", -1))
    raw = lines.filter(cells >= columns).select(
        F.from_csv("value", schemas.SANCTIONS.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"'}).alias("row")).select("row.*")
    def clean(name):
        value = X.stripped(F.coalesce(F.col(name), F.lit("")))
        return F.when(value == K.SANCTIONS_NULL, F.lit("")).otherwise(value).alias(name)
    return (
        raw.select(*[clean(c) for c in ("ent_num", "name", "entity_type", "program")])
        .filter("name <> ''")
    )


def parse_prices(rows: DataFrame) -> DataFrame:
    """(series, date, price_usd): rows without a usable day or value are dropped."""
    return (
        rows.select(
            F.col("series"), F.try_to_date(F.substring("period", 1, 10), "yyyy-MM-dd").alias("date"),
            F.col("value").try_cast("double").alias("price_usd"))
        .dropna(subset=["date", "price_usd"])
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices of landed price rows, in date order within a series."""
    return parse_prices(spark.read.schema(schemas.PRICE_REPLY).json(path)).sort("series", "date")


def read_network_seed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Dimension tables, alternatives and the three edge lists of a seed folder, with defaults."""
    def table(name, schema):
        return spark.read.schema(schema).json(f"{folder}/{name}.json", multiLine=True)

    lists = table("edges", schemas.EDGE_LISTS)
    edges = {name: lists.select(F.inline(name)).fillna(0.0, ["volume_mbd"]) for name in schemas.EDGE_LISTS.fieldNames()}
    return {
        "suppliers": table("suppliers", schemas.SUPPLIERS).fillna({"sanctioned": False}),
        "corridors": table("corridors", schemas.CORRIDORS).fillna({"baseline_risk": K.DEFAULT_BASELINE_RISK}),
        "ports": table("ports", schemas.PORTS).withColumn("location", F.struct("lon", "lat")),
        "refineries": table("refineries", schemas.REFINERIES).fillna({"min_run_rate": 0.70})
            .withColumn("location", F.struct("lon", "lat")),
        "alternatives": table("alternatives", schemas.ALTERNATIVES)
            .fillna({"sanctioned": False, "max_incremental_mbd": 0.0})
            .withColumn("transits_corridors", F.coalesce("transits_corridors", F.array().cast("array<string>"))),
        **edges,
    }
