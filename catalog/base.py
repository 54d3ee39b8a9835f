"""Registry and the views of the driver tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from straitline.session import checkpointed
from straitline.sources.stores import is_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-30 16:30:00"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as they land: a table is one file, or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    files = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return files.parquet(path) if is_folder(spark, path) else files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def r6(col: Column | str) -> Column:
    return F.round(col, 6)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def stamp(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def day(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


# --- events as risk events -----------------------------------------------------

def risk_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("event_type").alias("corridor"), (F.col("event_id") % 5 + 1).cast("int").alias("severity"),
        ((F.col("user_id") % 10 + 1) / F.lit(10.0)).alias("confidence"), F.col("ts").cast("timestamp").alias("ts"), "value", "user_id", "props")


def risk_corridors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().withColumn(
        "baseline_risk", F.length("name") * F.lit(0.01))


EV = """ev AS (SELECT event_id, event_type AS corridor, CAST(event_id % 5 + 1 AS INTEGER) AS severity,
  CAST(user_id % 10 + 1 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence, ts, value, user_id, props FROM events),
base AS (SELECT event_type AS corridor, length(event_type) * CAST(0.01 AS DOUBLE) AS baseline FROM events GROUP BY event_type)"""
AGE = f"greatest(CAST(0 AS DOUBLE), (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / CAST(86400000000 AS DOUBLE))"
WEIGHT = f"severity * confidence * exp(-CAST(0.1 AS DOUBLE) * {AGE})"
WEV = f"{EV}, wev AS (SELECT *, {WEIGHT} AS w FROM ev)"


def score_sql(raw: str, base: str) -> str:
    return f"CASE WHEN {raw} > 0 THEN {base} + (1 - {base}) * least(CAST(1 AS DOUBLE), {raw} / CAST(5 AS DOUBLE)) ELSE {base} END"


def saturating_sql(raw: str, base: str, k: float) -> str:
    return f"CASE WHEN {raw} > 0 THEN {base} + (1 - {base}) * (1 - exp(-({raw}) / CAST({k} AS DOUBLE))) ELSE {base} END"


# --- event windows of a backtest: one per event type ---------------------------

def windows(spark, sf_dir) -> DataFrame:
    span = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("corridor")).agg(
        F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    return span.select(
        F.concat(F.lit("w_"), F.col("corridor")).alias("event"), "corridor",
        F.date_add("lo", 10).alias("chart_start"), F.date_sub("hi", 2).alias("end"))


WIN = """win AS (SELECT 'w_' || event_type AS event, event_type AS corridor, CAST(min(ts) AS DATE) + 10 AS chart_start,
  CAST(max(ts) AS DATE) - 2 AS "end" FROM events GROUP BY event_type)"""


def ledger(spark, sf_dir) -> DataFrame:
    """A day of an event type is read, not sampled or in error by how many events it has."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") % 5 == 0, "not_sampled").when(F.col("n") % 7 == 0, "error").otherwise("ok")
    return e.select(F.concat(F.lit("w_"), F.col("event_type")).alias("event"), "day", status.alias("status"),
                    F.col("n").alias("slices_read"), (F.col("n") + 3).alias("slices_total"), (F.col("n") * 2).alias("stored"),
                    F.to_timestamp("day").alias("pulled_at"))


LEDGER = """led AS (SELECT 'w_' || event_type AS event, CAST(ts AS DATE) AS day,
  CASE WHEN count(*) % 5 = 0 THEN 'not_sampled' WHEN count(*) % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
  count(*) AS slices_read, count(*) + 3 AS slices_total, count(*) * 2 AS stored FROM events GROUP BY ALL),
grid AS (SELECT event, CAST(unnest(generate_series(CAST(chart_start - 7 AS TIMESTAMP), CAST("end" AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM win)"""


# --- daily prices ----------------------------------------------------------------

def prices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(
        F.lit("all").alias("series"), F.to_date("o_orderdate").alias("date")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("price_usd"))


PRICES = """px AS (SELECT 'all' AS series, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 2)"""


# --- supply networks ---------------------------------------------------------------

def network_parts(spark, sf_dir) -> dict[str, DataFrame]:
    """One network per return flag: supplier -> region of the supplier -> brand -> part."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey", "l_quantity")
    # Few lines share a supplier and a part, so they meet their part as they are, in one exchange, and are summed where they met:
    # a row per network and part, with its volume by region. Suppliers are summed from the lines alone, which only meet those
    # parts that do not occur just once.
    met = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).repartition("l_partkey").join(
        part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"), "left")
    by_region = met.groupBy("l_partkey", "p_partkey", "p_brand", "l_returnflag", "r_name").agg(F.sum("l_quantity").alias("q"), F.max("p_size").alias("size"))
    sums = checkpointed(by_region.groupBy("l_partkey", "p_partkey", "p_brand", "l_returnflag").agg(
        F.sum("q").alias("q"), F.max("size").alias("size"), F.collect_list(F.struct("r_name", "q")).alias("regions")))  # of five regions
    known, unknown = sums.filter("p_partkey IS NOT NULL"), sums.filter("p_partkey IS NULL")
    odd = checkpointed(unknown.select("l_partkey", F.lit(0).alias("copies")).distinct().unionByName(
        part.groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.count("*").alias("copies")).filter("copies > 1")))
    if not odd.isEmpty():
        lines = lines.join(odd, lines["l_partkey"].eqNullSafe(odd["l_partkey"]), "left").filter("copies IS NULL OR copies > 0").withColumn(
            "l_quantity", F.col("l_quantity") * F.coalesce("copies", F.lit(1)))
    net, refinery = F.col("l_returnflag").alias("network_id"), F.concat(F.lit("P"), F.col("l_partkey")).alias("refinery")
    volume = lambda df, *keys: df.groupBy(net, *keys).agg(F.sum("q").alias("volume"))
    of_supplier = lines.groupBy("l_returnflag", "l_suppkey").agg(
        F.sum("l_quantity").alias("q")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return {
        "suppliers": volume(of_supplier, F.concat(F.lit("S"), F.col("l_suppkey")).alias("supplier"), F.col("r_name").alias("corridor")),
        "ports": volume(known.select("l_returnflag", "p_brand", F.inline("regions")), F.col("r_name").alias("corridor"), F.col("p_brand").alias("port")),
        "feeds": known.select(net, F.col("p_brand").alias("port"), refinery, (F.col("q") * 0.9).alias("volume")),
        "refineries": known.groupBy(net, refinery).agg((40.0 * (F.max("size") + 5)).alias("capacity")),
    }


def network(spark, sf_dir) -> DataFrame:
    from straitline.operators.network import build_network

    p = network_parts(spark, sf_dir)
    # The network is far smaller than the lines it is summed from, and every operator reads it often.
    return checkpointed(build_network(p["suppliers"], p["ports"], p["feeds"], p["refineries"]))


def region_risk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("corridor"), (F.col("r_regionkey") * 0.15).alias("risk"))


def risky_network(spark, sf_dir) -> DataFrame:
    from straitline.operators.network import apply_risk

    return checkpointed(apply_risk(network(spark, sf_dir), region_risk(spark, sf_dir)))


NET = """flat AS (SELECT l_returnflag AS net, 'S' || l_suppkey AS s, r_name AS c, p_brand AS p, 'P' || l_partkey AS r, p_size, l_quantity AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
sc AS (SELECT net, s, c, sum(q) AS v FROM flat GROUP BY ALL),
cp AS (SELECT net, c, p, sum(q) AS v FROM flat GROUP BY ALL),
pr AS (SELECT net, p, r, sum(q) * CAST(0.9 AS DOUBLE) AS v FROM flat GROUP BY ALL),
rt AS (SELECT net, r, CAST(40 AS DOUBLE) * (max(p_size) + 5) AS cap FROM flat GROUP BY ALL),
risk AS (SELECT r_name AS c, r_regionkey, r_regionkey * CAST(0.15 AS DOUBLE) AS risk FROM region),
cpr AS (SELECT net, cp.c, p, v, v * (1 - least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), risk))) AS e FROM cp JOIN risk USING (c)),
down AS (SELECT net, p, sum(least(v, cap)) AS d FROM pr JOIN rt USING (net, r) GROUP BY ALL)"""


def flow_ctes(scenarios: str) -> str:
    """CTEs giving flows(net, sid, flow) for scenarios(net, sid, hit, keep, supply): the closed form
    for networks in which every supplier has one corridor and every refinery one port."""
    return f"""scen AS ({scenarios}),
bits AS (SELECT c, CAST(pow(2, r_regionkey) AS BIGINT) AS b FROM risk),
xs AS (SELECT unnest(range(CAST(pow(2, (SELECT count(*) FROM risk)) AS BIGINT))) AS x),
sup AS (SELECT net, sid, x, sum(CASE WHEN x & b = 0 THEN v * supply ELSE 0 END) AS sv
  FROM (SELECT net, c, sum(v) AS v FROM sc GROUP BY ALL) t JOIN bits USING (c) JOIN scen USING (net) CROSS JOIN xs GROUP BY ALL),
inflow AS (SELECT net, sid, x, p, sum(CASE WHEN x & b <> 0 THEN (CASE WHEN c = hit THEN e * keep ELSE e END) ELSE 0 END) AS i
  FROM edges2 JOIN bits USING (c) JOIN scen USING (net) CROSS JOIN xs GROUP BY ALL),
cuts AS (SELECT net, sid, x, sum(least(i, coalesce(d, 0))) AS pv FROM inflow LEFT JOIN down USING (net, p) GROUP BY ALL),
flows AS (SELECT net, sid, min(coalesce(sv, 0) + pv) AS flow FROM cuts LEFT JOIN sup USING (net, sid, x) GROUP BY ALL)"""


BASE_SCEN = "SELECT DISTINCT net, 'base' AS sid, CAST(NULL AS VARCHAR) AS hit, CAST(1 AS DOUBLE) AS keep, CAST(1 AS DOUBLE) AS supply FROM cp"
CUT_SCEN = f"{BASE_SCEN} UNION ALL SELECT DISTINCT net, 'cut:' || c, c, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM cp"
RISKY = "edges2 AS (SELECT net, c, p, e FROM cpr)"
STATIC = "edges2 AS (SELECT net, c, p, v AS e FROM cpr)"


# --- alternatives and refineries for the response operators --------------------------

def alternatives(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("price_premium_usd"), F.col("s_nationkey").alias("transit_days"),
        (F.col("s_suppkey") % 50).cast("double").alias("api_gravity"), ((F.col("s_suppkey") % 7) / F.lit(2.0)).alias("sulfur_pct"),
        (F.col("s_acctbal") < 0).alias("sanctioned"), F.array("r_name").alias("transits_corridors"),
        (F.col("s_suppkey") % 7 + 1).cast("double").alias("max_incremental_mbd"))


def fleet(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("refinery"), F.col("p_retailprice").alias("capacity_mbd"),
        (F.col("p_size") - 8).cast("double").alias("api_gravity_min"), (F.col("p_size") + 8).cast("double").alias("api_gravity_max"),
        ((F.col("p_size") % 5) / F.lit(1.0)).alias("sulfur_tolerance"), F.col("p_brand").alias("connected_port"))


ALT = """alt AS (SELECT s_name AS name, s_acctbal AS premium, s_nationkey AS transit, CAST(s_suppkey % 50 AS DOUBLE) AS api,
  (s_suppkey % 7) / CAST(2 AS DOUBLE) AS sulfur, s_acctbal < 0 AS sanctioned, r_name AS transits, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS vol
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ref AS (SELECT p_retailprice AS cap, p_size - 8 AS lo, p_size + 8 AS hi, CAST(p_size % 5 AS DOUBLE) AS tol FROM part),
compat AS (SELECT api, sulfur, sum(CASE WHEN api BETWEEN lo AND hi AND sulfur <= tol THEN cap ELSE 0 END) / sum(cap) AS compat
  FROM (SELECT DISTINCT api, sulfur FROM alt) a CROSS JOIN (SELECT lo, hi, tol, sum(cap) AS cap FROM ref GROUP BY ALL) r GROUP BY ALL)"""


def disruptions(spark, sf_dir) -> DataFrame:
    """One disruption per customer segment and region, sized by its orders."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    counts = per_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")) \
        .groupBy("c_mktsegment", "r_name").agg(F.sum("n").alias("n"))
    return counts.select(
        F.concat_ws("/", "c_mktsegment", "r_name").alias("disruption_id"), F.col("r_name").alias("corridor"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "severe").otherwise("normal").alias("crisis"),
        ((F.col("n") % 97) / F.lit(4.0)).alias("gap"), (F.col("n") % 20 + 10).cast("int").alias("duration_days"),
        (F.col("n") % 2 == 0).alias("include_sanctioned"))


DIS = """dis AS (SELECT c_mktsegment || '/' || r_name AS id, r_name AS c, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'severe' ELSE 'normal' END AS crisis,
  (count(*) % 97) / CAST(4 AS DOUBLE) AS gap, CAST(count(*) % 20 + 10 AS INTEGER) AS days, count(*) % 2 = 0 AS sanc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment, r_name)"""
LISTS = """elig AS (SELECT id, crisis, gap, days, name, premium, transit, vol, compat FROM dis JOIN alt ON alt.transits <> dis.c AND (sanc OR NOT sanctioned) JOIN compat USING (api, sulfur)),
bnd AS (SELECT id, min(premium) AS p0, max(premium) AS p1, min(transit) AS t0, max(transit) AS t1 FROM elig GROUP BY id),
parts AS (SELECT elig.*, CASE WHEN p1 = p0 THEN 1 ELSE 1 - (premium - p0) / (p1 - p0) END AS cost, CASE WHEN t1 = t0 THEN 1 ELSE 1 - (transit - t0) / CAST(t1 - t0 AS DOUBLE) END AS trans FROM elig JOIN bnd USING (id)),
scored AS (SELECT *, CASE WHEN crisis = 'severe' THEN CAST(0.2 AS DOUBLE) * cost + CAST(0.55 AS DOUBLE) * trans + CAST(0.25 AS DOUBLE) * compat
  ELSE CAST(0.4 AS DOUBLE) * cost + CAST(0.35 AS DOUBLE) * trans + CAST(0.25 AS DOUBLE) * compat END AS score FROM parts),
ranked AS (SELECT *, row_number() OVER w AS place, sum(vol) OVER (PARTITION BY id ORDER BY score DESC, name ROWS UNBOUNDED PRECEDING) AS cum FROM scored WINDOW w AS (PARTITION BY id ORDER BY score DESC, name))"""
RANKED = f"{ALT}, {DIS}, {LISTS}"
