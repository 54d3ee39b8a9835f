"""Site-relative line frequency: lines on too large a share of a site's pages are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from straitline.llm.common import fresh, stored

#: A line on more than this share of its site's pages is boilerplate ...
MAX_RATIO = 0.05
#: ... if that many pages have it at least; on a site of a few pages any line would pass the ratio.
MIN_PAGES = 3

NULL_HOST = "\x00null"


def _lines(text: str) -> Column:
    return F.split(F.col(f"`{text}`"), "\n")


def _key(line: Column) -> Column:
    """96 bits of a line: rows of this size are shuffled instead of lines."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def _host(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(NULL_HOST))


def boilerplate_lines(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host the keys of its boilerplate lines: ``host, lines``.

    A host's array stays short however many pages it has: its pages' mean number of lines over ``max_ratio`` at most.
    Counting is by (host, line), so that a host with a third of all pages is still dealt over all tasks, and a line that
    very many pages share is summed before the shuffle.
    """
    own = pages.select(_host(host).alias("host"), F.explode(F.array_distinct(F.transform(
        F.filter(_lines(text), lambda x: ~_blank(x)), _key))).alias("line"))
    pages_with = own.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy(_host(host).alias("host")).agg(F.count("*").alias("total"))
    return pages_with.join(totals, "host").filter(F.col("n") / F.col("total") > max_ratio) \
        .groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_site_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    counts: bool = False,
) -> DataFrame:
    """``pages`` with the boilerplate lines of their host taken out of ``text``; ``counts`` adds ``n_lines`` and ``n_dropped``.

    A page counts once for each of its lines, however often it repeats the line. Blank lines (nothing but spaces) are
    neither counted nor dropped. Pages without a host share one site. A null text stays null and has no lines; an empty
    one has one blank line. Repeated rows are pages of their own. Other columns pass through, whatever their names.
    """
    at, drop = fresh("site", pages), fresh("drop", pages)
    table = stored(boilerplate_lines(pages, host, text, max_ratio, min_pages), "boilerplate")
    # The written table's size decides between a broadcast and a shuffled join, which splits large hosts.
    joined = pages.withColumn(at, _host(host)).join(
        table.select(F.col("host").alias(at), F.col("lines").alias(drop)), at, "left")
    kept = F.filter(_lines(text), lambda x: _blank(x) | ~F.array_contains(F.col(drop), _key(x)))
    changed = F.when(F.col(drop).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    columns = [F.col(f"`{c}`") if c != text else changed.alias(text) for c in pages.columns]
    if counts:
        size = F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long")
        left = F.when(F.col(drop).isNull(), size).otherwise(F.coalesce(F.size(kept), F.lit(0)).cast("long"))
        columns += [F.when(F.col(f"`{text}`").isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
                    F.when(F.col(f"`{text}`").isNull(), 0).otherwise(size - left).cast("long").alias("n_dropped")]
    return joined.select(*columns)
