"""Queries over landed files: rows of the driver tables are landed in the formats of the feeds, and read back."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from catalog.base import query, stamp, table
from straitline import constants as K
from straitline.operators import articles as A
from straitline.session import scratch_folder
from straitline.sources import landing

PER_SLICE = 50  # lines of a landed slice


def _folder(spark) -> str:
    return f"{scratch_folder(spark)}/landed-{uuid.uuid4().hex}"


# --- slices: zipped lines of tab-separated fields -------------------------------------------

_HEADLINES = ("Oil tanker hit near Hormuz", "Houthi rebels seize vessel", "Red Sea corals", "Cape of Good Hope crowded", "Local news")


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive per slice, as a file source would give it; some are broken, some rows are short."""
    rows = rows.sort_values("page_id")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("slice.csv", "\n".join(rows["line"]))
    content = b"not an archive" if rows["slice"].iloc[0] % 13 == 5 else held.getvalue()
    return pd.DataFrame({"path": [f"/landed/{rows['stamp'].iloc[0]}.gkg.csv.zip"], "content": [content]})


def landed_slices(spark, sf):
    """Pages as slices of fifty rows, a quarter of an hour each."""
    pages = table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / PER_SLICE).alias("slice"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("slice") * 900)
    compact = lambda t: F.date_format(t, "yyyyMMddHHmmss")
    n = F.col("page_id")
    title = F.concat(F.element_at(F.array(*map(F.lit, _HEADLINES)), (n % 5 + 1).cast("int")), F.lit(" &amp; "), n.cast("string"))
    tags = F.concat(
        F.when(n % 11 != 0, F.concat(F.lit("<PAGE_TITLE>"), title, F.lit("</PAGE_TITLE>"))).otherwise(F.lit("")),
        F.when(n % 2 == 0, F.concat(F.lit("<PAGE_PRECISEPUBTIMESTAMP>"), compact(at - F.expr("INTERVAL 20 MINUTES")), F.lit("</PAGE_PRECISEPUBTIMESTAMP>"))).otherwise(F.lit("")))
    fields = {1: compact(at), 3: F.concat(F.lit("site"), (n % 9).cast("string")), 4: F.concat(F.lit("http://s.example/"), n.cast("string")),
              7: F.when(n % 3 == 0, F.lit("ENV_OIL;X")).otherwise(F.lit("X")), 25: F.when(n % 7 == 0, F.lit("srclc:fra")).otherwise(F.lit("")), 26: tags}
    short = F.concat_ws("\t", *[fields.get(i, F.lit("")) for i in range(K.SLICE_COLUMNS - 1)])
    line = F.concat_ws("\t", *[fields.get(i, F.lit("")) for i in range(K.SLICE_COLUMNS)])
    rows = pages.select("page_id", "slice", compact(at).alias("stamp"), F.when(n % 17 == 0, short).otherwise(line).alias("line"))
    return rows.groupBy("slice").applyInPandas(_zipped, "path string, content binary")


_SLICES = f"""s AS (SELECT page_id AS n, page_id // {PER_SLICE} AS slice, row_number() OVER (PARTITION BY page_id // {PER_SLICE} ORDER BY page_id) - 1 AS line_no,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(15 * (page_id // {PER_SLICE}) AS BIGINT)) AS t0 FROM pages),
u AS (SELECT *, ({list(_HEADLINES)})[n % 5 + 1] || ' & ' || n AS title,
  CASE WHEN n % 5 = 0 THEN 'Hormuz' WHEN n % 5 = 1 THEN 'Red Sea' WHEN n % 5 = 2 AND n % 3 = 0 THEN 'Red Sea' WHEN n % 5 = 3 AND n % 3 = 0 THEN 'Cape' END AS corridor
  FROM s WHERE slice % 13 <> 5 AND n % 7 <> 0 AND n % 11 <> 0 AND n % 17 <> 0)"""


@query("landed_slice_articles", f"""WITH {_SLICES} SELECT 'http://s.example/' || n AS url, strftime(t0, '%Y-%m-%d %H:%M:%S') AS slice_ts, line_no, title, corridor,
  title || chr(10) || 'matched_corridor_query: ' || corridor || chr(10) || 'domain: site' || n % 9 || chr(10) || 'seendate: '
    || strftime(CASE WHEN n % 2 = 0 THEN t0 - INTERVAL '20 minutes' ELSE t0 END, '%Y%m%dT%H%M%SZ') AS raw_text FROM u WHERE corridor IS NOT NULL""")
def landed_slice_articles(spark, sf):
    """Zipped slices to matched articles: unreadable archives, short, translated and untitled rows drop out; themes count."""
    rows = landing.match_slices(landing.parse_slices(landing.slices_to_lines(landed_slices(spark, sf))))
    return rows.select("url", stamp("slice_ts").alias("slice_ts"), "line_no", "title", "corridor", "raw_text")


@query("landed_slice_stamps", f"""SELECT strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(15 * (page_id // {PER_SLICE}) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS slice_ts
FROM pages WHERE (page_id // {PER_SLICE}) % 13 <> 5 GROUP BY 1""")
def landed_slice_stamps(spark, sf):
    """Slices that could be read."""
    return A.read_slice_stamps(landing.slices_to_lines(landed_slices(spark, sf))).select(stamp("slice_ts").alias("slice_ts"))


# --- search replies and feeds: JSON ------------------------------------------------------------

@query("landed_search_articles", """WITH h AS (SELECT page_id AS n, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT url, 'gdelt' AS source, 'Oil in ' || host AS title, 'Hormuz' AS corridor, 'Oil in ' || host || chr(10) || 'matched_corridor_query: Hormuz'
  || CASE WHEN n % 2 = 0 THEN chr(10) || 'domain: ' || host ELSE '' END || CASE WHEN n % 5 = 0 THEN chr(10) || 'sourcecountry: Norway' ELSE '' END
  || chr(10) || 'seendate: 20240101T101500Z' AS raw_text FROM h WHERE n % 7 <> 0 AND n % 11 <> 0""")
def landed_search_articles(spark, sf):
    """Search replies of fifty articles, one document per file; articles without address or title drop out."""
    n, host = F.col("page_id"), F.regexp_extract("url", "^https?://([^/]+)", 1)
    article = F.struct(
        F.when(n % 7 != 0, F.col("url")).alias("url"),
        F.when(n % 11 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("  Oil in "), host, F.lit("\t"))).alias("title"),
        F.when(n % 2 == 0, host).otherwise(F.lit("")).alias("domain"), F.when(n % 5 == 0, F.lit("Norway")).alias("sourcecountry"),
        F.lit("20240101T101500Z").alias("seendate"))
    folder = _folder(spark)
    table(spark, sf, "pages").groupBy(F.floor(n / PER_SLICE)).agg(F.collect_list(article).alias("articles")).select("articles") \
        .write.option("maxRecordsPerFile", 1).json(folder)
    return landing.read_search_dump(spark, folder, "Hormuz").select("url", "source", "title", "corridor", "raw_text")


@query("landed_feed_articles", f"""WITH h AS (SELECT page_id AS n, url, 'feed' || page_id % 4 AS feed, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS place FROM pages)
SELECT feed, url, feed AS source, 'Entry ' || n AS title, CASE WHEN n % 3 = 0 THEN 'Told in ' || n WHEN n % 3 = 1 THEN 'Body ' || n ELSE 'Entry ' || n END
  || CASE WHEN n % 2 = 0 THEN chr(10) || 'seendate: 20240101T000000Z' WHEN n % 5 = 0 THEN chr(10) || 'seendate: 20240102T030405Z' ELSE '' END AS raw_text
FROM h WHERE place <= {K.FEED_LIMIT} AND n % 7 <> 0 AND n % 11 <> 0""")
def landed_feed_articles(spark, sf):
    """The first entries of each feed; body from summary, description or title, time from published or updated."""
    n = F.col("page_id")
    at = lambda text: F.to_timestamp(F.lit(text))
    entries = table(spark, sf, "pages").select(
        F.concat(F.lit("feed"), (n % 4).cast("string")).alias("feed"), n.cast("int").alias("pos"), F.when(n % 7 != 0, F.col("url")).alias("link"),
        F.when(n % 11 != 0, F.concat(F.lit(" Entry "), n.cast("string"))).alias("title"), F.when(n % 3 == 0, F.concat(F.lit("Told in "), n.cast("string"))).alias("summary"),
        F.when(n % 3 < 2, F.concat(F.lit("Body "), n.cast("string"))).otherwise(F.lit("")).alias("description"),
        F.when(n % 2 == 0, at("2024-01-01 00:00:00")).alias("published"), F.when(n % 5 == 0, at("2024-01-02 03:04:05")).alias("updated"))
    folder = _folder(spark)
    entries.write.json(folder)
    return landing.read_feed_entries(spark, folder).select("feed", "url", "source", "title", "raw_text")


# --- lists ---------------------------------------------------------------------------------------

@query("landed_sanctions", """SELECT CAST(s_suppkey AS VARCHAR) AS ent_num, s_name || ', "M/V"' AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'vessel' END AS entity_type,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'P' || s_nationkey END AS program, length(s_name) AS n FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""")
def landed_sanctions(spark, sf):
    """A headerless list with quoted names, null marks, empty programs, long remarks, short and unnamed rows."""
    k = F.col("s_suppkey")
    name = F.when(k % 11 == 0, F.lit("-0-")).otherwise(F.concat(F.lit('"'), F.col("s_name"), F.lit(', ""M/V"""')))
    program = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("P"), F.col("s_nationkey").cast("string")))
    remarks = F.concat(F.lit('"'), F.repeat(F.concat(F.col("s_name"), F.lit(', ""x"" ')), 200), F.lit('"'))
    full = F.concat_ws(",", k.cast("string"), name, F.when(k % 3 == 0, F.lit("-0- ")).otherwise(F.lit("vessel")), program, *[F.lit("-0-")] * 7, remarks)
    folder = _folder(spark)
    table(spark, sf, "supplier").select(F.when(k % 7 == 0, F.concat_ws(",", k.cast("string"), name)).otherwise(full).alias("value")).write.text(folder)
    rows = landing.read_sanctions(spark, folder)
    return rows.select("ent_num", "name", "entity_type", "program", (F.length("name") - 7).alias("n"))


# --- network seed ------------------------------------------------------------------------------

_SEED = """n AS (SELECT n_name, r_name, n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
v AS (SELECT n_name, r_name, round(sum(o_totalprice), 2) AS volume FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey GROUP BY ALL)"""


@query("landed_network_seed", f"""WITH {_SEED}
SELECT 'supplier' AS kind, n_name AS name, NULL AS "to", CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM n
UNION ALL SELECT 'corridor', r_name, NULL, CASE WHEN r_regionkey % 2 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END FROM region
UNION ALL SELECT 'alternative', n_name, r_name, CASE WHEN n_nationkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(n_nationkey AS DOUBLE) END FROM n
UNION ALL SELECT 'edge', n_name, r_name, CASE WHEN n_nationkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE volume END FROM v JOIN n USING (n_name, r_name)""")
def landed_network_seed(spark, sf):
    """A seed folder of nations and regions, with volumes of orders; missing fields take their defaults."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder, key, r = _folder(spark), F.col("n_nationkey"), table(spark, sf, "region")
    volume = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("volume")).join(n, F.col("c_nationkey") == key)

    def land(name, rows):  # a seed file is one document: nations and regions are few at every size
        rows.coalesce(1).write.text(f"{folder}/{name}.json")

    def listed(df, *columns):
        return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("value"))

    sanctioned = F.when(key % 2 == 0, F.lit(True)).alias("sanctioned")
    land("suppliers", listed(n, F.col("n_name").alias("name"), sanctioned))
    land("corridors", listed(r, F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, F.lit(0.3)).alias("baseline_risk")))
    land("ports", listed(r, F.col("r_name").alias("name"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon")))
    land("refineries", listed(r, F.col("r_name").alias("name"), F.lit(1.0).alias("capacity_mbd")))
    land("alternatives", listed(n, F.col("n_name").alias("name"), F.array("r_name").alias("transits_corridors"), F.when(key % 3 != 0, key.cast("double")).alias("max_incremental_mbd")))
    edge = F.struct(F.col("n_name").alias("supplier"), F.col("r_name").alias("corridor"), F.when(key % 4 != 0, F.col("volume")).alias("volume_mbd"))
    empty = F.array().cast("array<struct<port:string>>")
    land("edges", volume.agg(F.sort_array(F.collect_list(edge)).alias("supplier_to_corridor")).select(
        F.to_json(F.struct("supplier_to_corridor", empty.alias("corridor_to_port"), empty.alias("port_to_refinery"))).alias("value")))
    seed = landing.read_network_seed(spark, folder)
    told = lambda kind, df, name, to, value: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), to.cast("string").alias("to"), value.cast("double").alias("value"))
    none = F.lit(None)
    return told("supplier", seed["suppliers"], "name", none, F.col("sanctioned").cast("int")) \
        .unionByName(told("corridor", seed["corridors"], "name", none, F.col("baseline_risk"))) \
        .unionByName(told("alternative", seed["alternatives"], "name", F.col("transits_corridors")[0], F.col("max_incremental_mbd"))) \
        .unionByName(told("edge", seed["supplier_to_corridor"], "supplier", F.col("corridor"), F.col("volume_mbd")))
