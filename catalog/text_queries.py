"""Queries over texts, articles, extraction and stores."""

from __future__ import annotations

import html
import re
from html.entities import html5

from pyspark.sql import functions as F

from catalog.base import EV, LEDGER, NOW, PRICES, WIN, day, ledger, now, prices, query, r6, risk_corridors, risk_events, stamp, table, windows
from straitline import constants as K
from straitline.functions import text as X
from straitline.functions.scoring import formula_label
from straitline.functions.times import as_of, day_grid, slice_grid, slices_between
from straitline.operators import articles as A
from straitline.operators import extraction as E
from straitline.operators.sanctions import attach_port, screen_actors
from straitline.operators.views import latest_events, risk_history
from straitline.sources import landing, stores

WORD = r"[\p{L}\p{M}\p{N}_]"


def term_sql(col: str, terms) -> str:
    choices = "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms)
    return f"regexp_matches({col}, '(^|[^{WORD[1:-1]}])({choices})s?([^{WORD[1:-1]}]|$)')"


_TERMS = ("the", "of", "de la", "und", "re")


@query("text_terms", f"SELECT doc_id, {term_sql('lower(text)', _TERMS)} AS hit FROM documents")
def text_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.contains_term(F.lower("text"), _TERMS).alias("hit"))


# Frequent words stand in for the vocabulary, so that real matches occur in whole texts.
_STAND_INS = ((" the ", " hormuz "), (" that ", " red sea "), (" with ", " cape route "), (" and ", " tankers "),
              (" of ", " houthi "), (" is ", " airport "), (" in ", " crisis "))


def _headline_sql() -> str:
    out = "' ' || lower(text) || ' '"
    for old, new in _STAND_INS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _headlines(spark, sf):
    col = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    for old, new in _STAND_INS:
        col = F.replace(col, F.lit(old), F.lit(new))
    return table(spark, sf, "documents").withColumn("title", col).withColumn("url", F.concat(F.lit("http://"), "source", F.lit("/a")))


def _match_sql() -> str:
    strong = [f"topical AND {term_sql('h', t)}" for t in K.CORRIDOR_TERMS.values()]
    red = list(K.CORRIDOR_TERMS).index("Red Sea")
    return f"""WITH d AS (SELECT doc_id, {_headline_sql()} || ' http://' || source || '/a' AS h FROM documents),
m AS (SELECT *, {term_sql('h', K.MARITIME_TERMS)} AS maritime FROM d),
t AS (SELECT *, maritime OR {term_sql('h', K.TOPIC_TERMS)} AS topical FROM m),
s AS (SELECT doc_id, {strong[0]} AS c0, {strong[1]} AS c1, {strong[2]} AS c2,
  maritime AND {term_sql('h', K.CORRIDOR_HINT_TERMS['Red Sea'])} AND NOT ({strong[red]}) AS c3 FROM t)"""


@query("corridor_matches", _match_sql() + """
SELECT doc_id, concat_ws('|', CASE WHEN c0 THEN 'Hormuz' END, CASE WHEN c1 THEN 'Red Sea' END, CASE WHEN c2 THEN 'Cape' END, CASE WHEN c3 THEN 'Red Sea' END) AS matches FROM s""")
def corridor_matches(spark, sf):
    return _headlines(spark, sf).select(
        "doc_id", F.array_join(X.match_corridors(F.col("title"), F.col("url")), "|").alias("matches"))


@query("first_corridors", _match_sql() + """
SELECT CASE WHEN c0 THEN 'Hormuz' WHEN c1 THEN 'Red Sea' WHEN c2 THEN 'Cape' ELSE 'Red Sea' END AS corridor, count(*) AS articles
FROM s WHERE c0 OR c1 OR c2 OR c3 GROUP BY 1""")
def first_corridors(spark, sf):
    first = X.first_corridor(X.match_corridors(F.col("title"), F.col("url")))
    return _headlines(spark, sf).withColumn("corridor", first).filter("corridor IS NOT NULL").groupBy("corridor").agg(
        F.count("*").alias("articles"))


# --- landed text of articles -----------------------------------------------------

_BASE_TS = "2024-01-01 00:00:00"


def landed_articles(spark, sf):
    """Documents as articles: first line as title, a date line from doc_id, some without a usable one."""
    seen = F.timestamp_micros(F.unix_micros(F.lit(_BASE_TS).cast("timestamp")) + F.col("doc_id") * F.lit(37 * 60_000_000))
    published = F.when(F.col("doc_id") % 3 == 0, seen - F.expr("INTERVAL 3 HOURS"))
    d = table(spark, sf, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    raw = X.bulk_raw_text(F.col("title"), F.col("lang"), F.col("source"), published, seen)
    return d.select(
        "doc_id", F.concat(F.lit("http://a/"), F.col("doc_id").cast("string")).alias("url"), "source", "title",
        F.when(F.col("doc_id") % 5 == 0, F.replace(raw, F.lit("seendate: "), F.lit("seendate: x"))).otherwise(raw).alias("raw_text"),
        F.lit(_BASE_TS).cast("timestamp").alias("ingested_at"), (F.col("n_chars") % 2 == 0).alias("processed"))


ART = f"""a0 AS (SELECT doc_id, 'http://a/' || doc_id AS url, source, split_part(text, chr(10), 1) AS title, lang, n_chars,
  TIMESTAMP '{_BASE_TS}' + to_minutes(CAST(doc_id * 37 AS BIGINT)) AS seen0 FROM documents),
a1 AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN seen0 - INTERVAL 3 HOUR ELSE seen0 END AS dated FROM a0),
art AS (SELECT *, title || chr(10) || 'matched_corridor_query: ' || lang || chr(10) || 'domain: ' || source || chr(10) || 'seendate: '
  || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || strftime(dated, '%Y%m%dT%H%M%SZ') AS raw_text,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE dated END AS seen, n_chars % 2 = 0 AS processed FROM a1)"""


@query("article_raw_text", f"WITH {ART} SELECT doc_id, raw_text FROM art")
def article_raw_text(spark, sf):
    return landed_articles(spark, sf).select("doc_id", "raw_text")


@query("article_seendates", f"WITH {ART} SELECT doc_id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS seen FROM art")
def article_seendates(spark, sf):
    return landed_articles(spark, sf).select("doc_id", stamp(X.parse_seendate(F.col("raw_text"))).alias("seen"))


@query("article_event_times", f"""WITH {ART} SELECT doc_id, strftime(coalesce(seen, TIMESTAMP '{_BASE_TS}'), '%Y-%m-%d %H:%M:%S') AS event_time FROM art""")
def article_event_times(spark, sf):
    return landed_articles(spark, sf).select(
        "doc_id", stamp(E.event_timestamp(F.col("raw_text"), F.col("ingested_at"))).alias("event_time"))


@query("compact_timestamps", """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def compact_timestamps(spark, sf):
    digits = F.date_format("ts", "yyyyMMddHHmmss")
    landed = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("2024"), digits)).otherwise(digits)
    return table(spark, sf, "events").select("event_id", stamp(X.parse_compact_ts(landed)).alias("parsed"))


@query("page_titles", r"""SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title,
trim(regexp_replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM pages""")
def page_titles(spark, sf):
    title = X.extract_tag(F.col("html"), "title")
    return table(spark, sf, "pages").select("page_id", title.alias("title"), X.normalize_title(title).alias("norm"))


#: Character references as HTML5 reads them (the rule of ``html.unescape``): names with and without their semicolon, and the numbers that stand for another character or for none.
_NUMBERS = [*range(32), *range(127, 160), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))]
_CODED = lambda text: " || ".join(f"chr({ord(c)})" for c in text) or "''"
_NAMES = ", ".join(f"('{name}', {_CODED(text)})" for name, text in sorted(html5.items()))
_OTHERS = ", ".join(f"({n}, {_CODED(html.unescape(f'&#{n};'))})" for n in _NUMBERS if html.unescape(f"&#{n};") != chr(n))
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
UNESCAPED = rf"""names(name, told) AS (VALUES {_NAMES}), others(n, told) AS (VALUES {_OTHERS}),
cut AS (SELECT page_id, line, regexp_extract_all(title, '{_REFERENCE}') AS refs, string_split_regex(title, '{_REFERENCE}') AS between FROM raw),
ref AS (SELECT DISTINCT unnest(refs) AS ref FROM cut),
num AS (SELECT ref, CASE WHEN ref ~ '^&#[0-9]' THEN coalesce(TRY_CAST(regexp_extract(ref, '[0-9]+') AS BIGINT), 1114112)
  ELSE (SELECT CASE WHEN length(h) > 8 THEN 1114112 ELSE CAST('0x' || coalesce(nullif(h, ''), '0') AS BIGINT) END FROM (SELECT ltrim(regexp_extract(ref, '[xX]([0-9a-fA-F]+)', 1), '0') AS h)) END AS n
  FROM ref WHERE ref LIKE '&#%'),
told AS (SELECT ref, CASE WHEN others.n IS NOT NULL THEN others.told WHEN num.n > 1114111 OR num.n BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(CAST(num.n AS INTEGER)) END AS told FROM num LEFT JOIN others ON others.n = num.n
  UNION ALL SELECT ref, coalesce(arg_max(names.told || substr(ref, 2 + length(name)), length(name)), ref) FROM ref LEFT JOIN names ON starts_with(substr(ref, 2), name) WHERE ref NOT LIKE '&#%' GROUP BY ref),
piece AS (SELECT page_id, line, i, between[i] AS part, refs[i] AS ref FROM (SELECT *, unnest(range(1, len(between) + 1)) AS i FROM cut))
SELECT page_id, string_agg(part || coalesce(told, ''), '' ORDER BY i) AS title FROM piece LEFT JOIN told USING (ref) GROUP BY page_id, line"""


@query("unescaped_titles", rf"""WITH raw AS (SELECT page_id, row_number() OVER () AS line, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title FROM pages),
{UNESCAPED}""")
def unescaped_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_unescape(X.extract_tag(F.col("html"), "title")).alias("title"))


# --- extraction ----------------------------------------------------------------------

def replies(spark, sf):
    """Model replies of every shape, from the event's own number k."""
    k = F.get_json_object("props", "$.k").cast("int")
    shape = k % 10
    s = lambda fmt, *cols: F.format_string(fmt, *cols)
    reply = (
        F.when(shape == 0, F.lit(None).cast("string")).when(shape == 1, F.lit("nothing to report"))
        .when(shape == 2, F.lit('[{"severity": 3}]'))
        .when(shape == 3, s('Reply:\n{"corridor": "Suez", "severity": %d, "confidence": 0.9, "is_relevant": true, "event_type": " MILITARY", "actor": "user %d"} end', k, F.col("user_id")))
        .when(shape == 4, F.lit('{"corridor": "Hormuz", "severity": "4.7", "confidence": "x", "is_relevant": "false", "event_type": "cyber"}'))
        .when(shape == 5, F.lit('{"corridor": "Hormuz", "severity": 2, "is_relevant": false}'))
        .when(shape == 6, s('{"corridor": "Panama", "severity": null, "confidence": %d, "is_relevant": 1, "actor": null}', k))
        .otherwise(s('{"corridor": "cape of good hope", "severity": %d, "confidence": 0.25, "is_relevant": true, "event_type": "shipping", "actor": "x"}', (k / 10).cast("int")))
    )
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "props").select("event_id", "event_type", "user_id", k.alias("k"), reply.alias("reply"))


REPLY = "rep AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query("coerced_extractions", f"""WITH {REPLY} SELECT event_id,
  CASE WHEN k % 10 = 3 THEN 'Red Sea' WHEN k % 10 IN (4, 5) THEN 'Hormuz' WHEN k % 10 = 6 THEN 'None' WHEN k % 10 >= 7 THEN 'Cape' END AS corridor,
  CASE WHEN k % 10 = 3 THEN 'user ' || user_id WHEN k % 10 IN (4, 5, 6) THEN 'unknown' WHEN k % 10 >= 7 THEN 'x' END AS actor,
  CASE WHEN k % 10 = 3 THEN 'military' WHEN k % 10 IN (4, 5, 6) THEN 'other' WHEN k % 10 >= 7 THEN 'shipping' END AS event_type,
  CASE WHEN k % 10 = 3 THEN least(5, greatest(1, k)) WHEN k % 10 = 4 THEN 4 WHEN k % 10 = 5 THEN 2 WHEN k % 10 = 6 THEN 1 WHEN k % 10 >= 7 THEN least(5, greatest(1, k // 10)) END AS severity,
  CASE WHEN k % 10 = 3 THEN CAST(0.9 AS DOUBLE) WHEN k % 10 IN (4, 5) THEN CAST(0.1 AS DOUBLE) WHEN k % 10 = 6 THEN CAST(1 AS DOUBLE) WHEN k % 10 >= 7 THEN CAST(0.25 AS DOUBLE) END AS confidence,
  CASE WHEN k % 10 = 0 THEN 'call_failed' WHEN k % 10 IN (1, 2) THEN 'unparseable' WHEN k % 10 = 5 THEN 'irrelevant' ELSE 'event' END AS outcome,
  k % 10 <> 0 AS processed FROM rep""")
def coerced_extractions(spark, sf):
    rows = E.classify_extractions(E.coerce_extractions(replies(spark, sf)))
    return rows.select("event_id", "parsed.corridor", "parsed.actor", "parsed.event_type", "parsed.severity",
                       "parsed.confidence", "outcome", "processed")


@query("extraction_report", f"""WITH {REPLY} SELECT event_type, count(*) AS articles, count(*) FILTER (WHERE k % 10 IN (3, 4, 6, 7, 8, 9)) AS events,
  count(*) FILTER (WHERE k % 10 = 5) AS irrelevant, count(*) FILTER (WHERE k % 10 IN (1, 2)) AS unparseable,
  count(*) FILTER (WHERE k % 10 = 0) AS call_failed FROM rep GROUP BY event_type""")
def extraction_report(spark, sf):
    return E.extraction_report(E.classify_extractions(E.coerce_extractions(replies(spark, sf))), "event_type")


def _linked_events(spark, sf):
    """Events that point at the article whose number is their user times three."""
    return risk_events(spark, sf).withColumn("article_url", F.concat(F.lit("http://a/"), (F.col("user_id") * 3).cast("string")))


@query("event_sources", f"""WITH {EV}, {ART} SELECT event_id, source FROM ev LEFT JOIN art ON art.url = 'http://a/' || (user_id * 3)""")
def event_sources(spark, sf):
    return E.attribute_source(_linked_events(spark, sf), landed_articles(spark, sf)).select("event_id", "source")


MOVED = f"""WITH {EV}, {ART}, j AS (SELECT event_id, corridor, seen, (epoch_us(ts) - epoch_us(seen)) / CAST(86400000000 AS DOUBLE) AS shift
  FROM ev LEFT JOIN art ON art.url = 'http://a/' || (user_id * 3)),
c AS (SELECT *, CASE WHEN seen IS NULL THEN 'no_date' WHEN abs(shift) < 1 / CAST(1440 AS DOUBLE) THEN 'unchanged' ELSE 'moved' END AS change FROM j)"""


@query("repointed_timestamps", MOVED + " SELECT event_id, change, round(shift, 6) AS shift_days FROM c")
def repointed_timestamps(spark, sf):
    moved = E.repoint_timestamps(_linked_events(spark, sf), landed_articles(spark, sf))
    return moved.select("event_id", "change", r6("shift_days").alias("shift_days"))


@query("timestamp_shift_stats", MOVED + """ SELECT corridor, count(*) AS events, count(*) FILTER (WHERE change = 'no_date') AS no_date,
  count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'moved') AS moved,
  round(min(shift) FILTER (WHERE change = 'moved'), 6) AS min_shift, round(max(shift) FILTER (WHERE change = 'moved'), 6) AS max_shift,
  count(*) FILTER (WHERE change = 'moved' AND shift >= 1) AS stale,
  round(list_sort(list(shift) FILTER (WHERE change = 'moved'))[count(*) FILTER (WHERE change = 'moved') // 2 + 1], 6) AS median_shift
  FROM c GROUP BY corridor""")
def timestamp_shift_stats(spark, sf):
    moved = E.repoint_timestamps(_linked_events(spark, sf), landed_articles(spark, sf))
    out = E.timestamp_shift_stats(moved, "corridor")
    for c in ("min_shift", "max_shift", "median_shift"):
        out = out.withColumn(c, r6(c))
    return out


# --- screening and links ---------------------------------------------------------------

@query("screened_actors", """WITH l AS (SELECT lower(s_name) AS n FROM supplier UNION SELECT lower(n_name) FROM nation),
a AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN n_name WHEN c_mktsegment = 'HOUSEHOLD' THEN ' ' ELSE replace(c_name, 'Customer', 'SUPPLIER') END AS actor
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, trim(actor) <> '' AND EXISTS (SELECT 1 FROM l WHERE contains(l.n, lower(trim(actor)))) AS sanctioned FROM a""")
def screened_actors(spark, sf):
    nation = table(spark, sf, "nation")
    actor = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("n_name")).when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(" ")) \
        .otherwise(F.replace("c_name", F.lit("Customer"), F.lit("SUPPLIER")))
    actors = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", actor.alias("actor"))
    listed = table(spark, sf, "supplier").select(F.col("s_name").alias("name")).unionByName(nation.select(F.col("n_name").alias("name")))
    return screen_actors(actors, listed).select("c_custkey", "sanctioned")


@query("refinery_ports", """WITH ports AS (SELECT DISTINCT p_brand FROM part WHERE p_retailprice > 999)
SELECT p_partkey, ports.p_brand AS port, ports.p_brand IS NULL AS port_missing FROM part LEFT JOIN ports ON ports.p_brand = part.p_brand""")
def refinery_ports(spark, sf):
    part = table(spark, sf, "part")
    ports = part.filter("p_retailprice > 999").select(F.col("p_brand").alias("name"))
    return attach_port(part.withColumn("connected_port", F.col("p_brand")), ports).select("p_partkey", "port", "port_missing")


# --- grids, labels, views -----------------------------------------------------------------

@query("live_slices", f"""WITH w AS (SELECT event_type AS corridor, max(ts) AS m FROM events GROUP BY 1)
SELECT corridor, strftime(unnest(generate_series(time_bucket(INTERVAL '15 minutes', m - INTERVAL '1440 minutes'),
  time_bucket(INTERVAL '15 minutes', m - INTERVAL '90 minutes'), INTERVAL '15 minutes')), '%Y-%m-%d %H:%M:%S') AS slice_ts FROM w""")
def live_slices(spark, sf):
    w = risk_events(spark, sf).groupBy("corridor").agg(F.max("ts").alias("m"))
    return w.select("corridor", F.explode(slice_grid(F.col("m"))).alias("t")).select("corridor", stamp("t").alias("slice_ts"))


@query("window_slices", """WITH w AS (SELECT event_type AS corridor, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
SELECT corridor, count(*) AS slices, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_slice, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_slice
FROM (SELECT corridor, a, b, unnest(generate_series(time_bucket(INTERVAL '15 minutes', a), b, INTERVAL '15 minutes')) AS t FROM w)
WHERE t >= a AND t < b GROUP BY corridor""")
def window_slices(spark, sf):
    w = risk_events(spark, sf).groupBy("corridor").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return w.select("corridor", F.explode(slices_between(F.col("a"), F.col("b"))).alias("t")).groupBy("corridor").agg(
        F.count("*").alias("slices"), stamp(F.min("t")).alias("first_slice"), stamp(F.max("t")).alias("last_slice"))


@query("pull_days", f"""WITH {WIN}, {LEDGER} SELECT event, strftime(day, '%Y-%m-%d') AS day, strftime(day, '%Y-%m-%d') || ' 16:30:00' AS as_of FROM grid""")
def pull_days(spark, sf):
    return day_grid(windows(spark, sf), warmup=True).select("event", day("day").alias("day"), stamp("as_of").alias("as_of"))


def _history(spark, sf):
    return risk_events(spark, sf).select(
        "event_id", "corridor", (F.col("ts") + F.expr("INTERVAL 985 DAYS")).alias("computed_at"), F.col("value").alias("score"))


@query("score_formulas", """SELECT event_id, CASE WHEN ts + INTERVAL 985 DAY >= TIMESTAMP '2026-09-26 00:00:00' THEN 'top3pad' ELSE 'sum_saturating' END AS formula FROM events""")
def score_formulas(spark, sf):
    return _history(spark, sf).select("event_id", formula_label(F.col("computed_at")).alias("formula"))


@query("risk_history", """SELECT event_id, event_type AS corridor, value AS score,
  CASE WHEN ts + INTERVAL 985 DAY >= TIMESTAMP '2026-09-26 00:00:00' THEN 'top3pad' ELSE 'sum_saturating' END AS formula
FROM events WHERE event_type = 'click' AND ts + INTERVAL 985 DAY >= TIMESTAMP '2026-10-01 00:00:00' - INTERVAL 9 DAY""")
def risk_history_query(spark, sf):
    at = F.lit("2026-10-01 00:00:00").cast("timestamp")
    return risk_history(_history(spark, sf), at, "click", 9).select("event_id", "corridor", "score", "formula")


@query("latest_events", "SELECT event_id, event_type AS corridor, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_events_query(spark, sf):
    return latest_events(risk_events(spark, sf), "error").select("event_id", "corridor", "value")


# --- stores --------------------------------------------------------------------------------

def _hosts(spark, sf):
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("url"), "page_id", F.col("url").startswith("https").alias("secure"))


@query("first_sightings", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def first_sightings_query(spark, sf):
    pages = _hosts(spark, sf)
    return A.dedupe_by_url(pages, order=["page_id"]).select("url", "page_id")


@query("new_articles", """WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS url, page_id, url LIKE 'https%' AS secure FROM pages)
SELECT url, min(page_id) AS page_id FROM h WHERE url NOT IN (SELECT url FROM h WHERE secure) GROUP BY url""")
def new_articles_query(spark, sf):
    pages = _hosts(spark, sf)
    return stores.new_articles(pages.filter("secure").select("url").distinct(), pages, ["page_id"]).select("url", "page_id")


@query("live_scores", f"WITH {EV} SELECT corridor, round(arg_max(value, ts), 6) AS live_risk_score FROM ev GROUP BY corridor")
def live_scores_query(spark, sf):
    history = risk_events(spark, sf).select("corridor", F.col("value").alias("score"), F.col("ts").alias("computed_at"))
    return stores.live_scores(history).select("corridor", r6("live_risk_score").alias("live_risk_score"))


@query("upserted_customers", """WITH old AS (SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_nationkey < 20),
new AS (SELECT c_name AS name, c_acctbal + 1 AS bal FROM customer WHERE c_nationkey >= 10)
SELECT coalesce(new.name, old.name) AS name, round(coalesce(new.bal, old.bal), 2) AS bal,
  CASE WHEN old.name IS NULL THEN 'created' WHEN new.name IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old FULL JOIN new ON old.name = new.name""")
def upserted_customers(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), "c_nationkey")
    out = stores.upsert_dimension(c.filter("c_nationkey < 20").drop("c_nationkey"),
                                  c.filter("c_nationkey >= 10").withColumn("bal", F.col("bal") + 1).drop("c_nationkey"), "name")
    return out.withColumn("bal", F.round("bal", 2))


@query("merged_ledger", f"""WITH {WIN}, {LEDGER}, fresh AS (SELECT event, day, 'ok' AS status, slices_total AS n FROM led WHERE slices_total > 60),
todo AS (SELECT event, day FROM grid WHERE (event, day) NOT IN (SELECT (event, day) FROM led WHERE status = 'ok'))
SELECT event, strftime(day, '%Y-%m-%d') AS day, coalesce(f.status, led.status) AS status, coalesce(f.n, led.slices_read) AS slices_read
FROM led LEFT JOIN (SELECT fresh.* FROM fresh JOIN todo USING (event, day)) f USING (event, day)""")
def merged_ledger(spark, sf):
    led = ledger(spark, sf)
    fresh = led.filter("slices_total > 60").withColumn("status", F.lit("ok")).withColumn("slices_read", F.col("slices_total"))
    out = stores.upsert_ledger(led, fresh, day_grid(windows(spark, sf), warmup=True).select("event", "day"))
    return out.select("event", day("day").alias("day"), "status", "slices_read")


@query("merged_prices", f"""WITH {PRICES}, old AS (SELECT * FROM px WHERE date < DATE '1998-01-01'), new AS (SELECT date, price * 2 AS price FROM px WHERE date >= DATE '1997-06-01')
SELECT strftime(coalesce(new.date, old.date), '%Y-%m-%d') AS date, round(coalesce(new.price, old.price), 4) AS price FROM old FULL JOIN new ON old.date = new.date""")
def merged_prices(spark, sf):
    px = prices(spark, sf)
    old, new = px.filter("date < '1998-01-01'"), px.filter("date >= '1997-06-01'").withColumn("price_usd", F.col("price_usd") * 2)
    covered = old.groupBy("series").agg(F.min("date").alias("covered_start"), F.max("date").alias("covered_end"))
    start = new.groupBy("series").agg(F.min("date").alias("start"))
    merged, _ = stores.upsert_prices(old, covered, new, start)
    return merged.select(day("date").alias("date"), F.round("price_usd", 4).alias("price"))


@query("price_coverage", f"""WITH {PRICES} SELECT strftime(min(date), '%Y-%m-%d') AS covered_start, strftime(max(date), '%Y-%m-%d') AS covered_end FROM px""")
def price_coverage(spark, sf):
    px = prices(spark, sf)
    old, new = px.filter("date < '1998-01-01'"), px.filter("date >= '1997-06-01'")
    covered = old.groupBy("series").agg(F.min("date").alias("covered_start"), F.max("date").alias("covered_end"))
    _, coverage = stores.upsert_prices(old, covered, new, new.groupBy("series").agg(F.min("date").alias("start")))
    return coverage.select(day("covered_start").alias("covered_start"), day("covered_end").alias("covered_end"))


@query("parsed_prices", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, round(o_totalprice, 2) AS price FROM orders
WHERE o_orderkey % 6 NOT IN (0, 1) AND o_orderkey % 11 <> 0""")
def parsed_prices(spark, sf):
    o = table(spark, sf, "orders")
    value = F.when(F.col("o_orderkey") % 6 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 6 == 1, F.lit("n/a")) \
        .otherwise(F.round("o_totalprice", 2).cast("string"))
    period = F.when(F.col("o_orderkey") % 11 == 0, F.lit("no day")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("series"), period.alias("period"), value.alias("value"))
    return landing.parse_prices(rows).select(
        F.col("series").cast("bigint").alias("o_orderkey"), day("date").alias("date"), F.col("price_usd").alias("price"))


# --- coverage and sampling --------------------------------------------------------------------

@query("slice_coverage", f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
g AS (SELECT day, unnest(generate_series(CAST(day AS TIMESTAMP), CAST(day AS TIMESTAMP) + INTERVAL '1425 minutes', INTERVAL '15 minutes')) AS s FROM d),
e AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS s, event_type AS corridor, count(*) AS n FROM events WHERE value > 40 GROUP BY ALL),
t AS (SELECT day, count(r.s) AS slices_read, count(*) AS slices_total FROM g LEFT JOIN (SELECT DISTINCT s FROM e) r USING (s) GROUP BY day),
m AS (SELECT day, corridor, sum(n) AS n FROM g JOIN e USING (s) GROUP BY ALL),
x AS (SELECT t.*, c.corridor, coalesce(n, 0) AS n FROM t CROSS JOIN (SELECT DISTINCT event_type AS corridor FROM events) c LEFT JOIN m USING (day, corridor)),
y AS (SELECT *, slices_read >= slices_total * CAST(0.5 AS DOUBLE) AS ok FROM x)
SELECT strftime(day, '%Y-%m-%d') AS window_id, corridor, slices_read, slices_total, CAST(CASE WHEN ok THEN n ELSE 0 END AS BIGINT) AS articles,
  CASE WHEN NOT ok THEN 'error' WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status FROM y""")
def slice_coverage(spark, sf):
    from straitline.functions.times import floor_to_slice

    e = risk_events(spark, sf)
    days = e.select(F.to_date("ts").alias("d")).distinct()
    w = days.select(day("d").alias("window_id"), F.to_timestamp("d").alias("start"), F.to_timestamp(F.date_add("d", 1)).alias("end"))
    rows = e.filter("value > 40").select(floor_to_slice(F.col("ts")).alias("slice_ts"), "corridor")
    return A.slice_coverage(A.expected_slices(w), rows, rows, risk_corridors(spark, sf))


@query("sampling_report", f"""WITH c AS (SELECT lang AS corridor, count(*) AS n FROM documents GROUP BY 1),
f AS (SELECT corridor, n, CASE WHEN n % 3 = 0 THEN 'throttled' WHEN n % 3 = 1 THEN 'ok' ELSE 'empty' END AS status FROM c WHERE corridor <> 'en'),
s AS (SELECT lang AS corridor, count(*) AS k FROM documents WHERE n_chars > 500 GROUP BY 1)
SELECT c.corridor, coalesce(f.n, 0) AS fetched, coalesce(k, 0) AS stored, coalesce(status, 'error') AS status, coalesce(status, 'error') NOT IN ('error', 'throttled') AS sampled
FROM c LEFT JOIN f USING (corridor) LEFT JOIN s USING (corridor)""")
def sampling_report(spark, sf):
    d = table(spark, sf, "documents")
    counts = d.groupBy(F.col("lang").alias("corridor")).agg(F.count("*").alias("fetched"))
    rest = F.col("fetched") % 3
    fetches = counts.filter("corridor <> 'en'").withColumn(
        "status", F.when(rest == 0, "throttled").when(rest == 1, "ok").otherwise("empty"))
    stored = d.filter("n_chars > 500").select(F.col("lang").alias("corridor"))
    return A.sampling_report(counts.select(F.col("corridor").alias("name")), fetches, stored)


@query("source_precedence", """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, o_orderpriority AS corridor, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY ALL),
p AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'throttled' WHEN n % 5 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN f % 4 = 0 THEN 'error' ELSE 'ok' END AS b_status FROM o),
q AS (SELECT *, min(CASE WHEN status = 'throttled' THEN corridor END) OVER (PARTITION BY run_id) AS failed FROM p),
r AS (SELECT *, failed IS NOT NULL AS back, failed IS NULL OR corridor <= failed AS asked FROM q),
s AS (SELECT *, CASE WHEN asked THEN status ELSE 'not_attempted' END AS doc_status, asked AND status <> 'throttled' AS ds FROM r)
SELECT run_id, corridor, CASE WHEN asked THEN n ELSE 0 END + CASE WHEN back THEN f ELSE 0 END AS fetched, CASE WHEN asked THEN n ELSE 0 END + CASE WHEN back THEN f ELSE 0 END AS stored,
  CASE WHEN ds OR NOT back THEN doc_status ELSE b_status END AS status, ds OR (back AND b_status = 'ok') AS sampled,
  CASE WHEN NOT back THEN 'doc' WHEN ds THEN 'doc+gkg' ELSE 'gkg' END AS path, doc_status FROM s""")
def source_precedence(spark, sf):
    o = table(spark, sf, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderpriority").alias("corridor")).agg(
            F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    status = F.when(F.col("n") % 7 == 0, "throttled").when(F.col("n") % 5 == 0, "empty").otherwise("ok")
    primary = o.select("run_id", "corridor", F.col("n").alias("fetched"), F.col("n").alias("stored"), status.alias("status"),
                       A.is_sampled(status).alias("sampled"), F.col("corridor").alias("place"))
    b_status = F.when(F.col("f") % 4 == 0, "error").otherwise("ok")
    bulk = o.select("run_id", "corridor", F.col("f").alias("fetched"), F.col("f").alias("stored"), b_status.alias("status"), A.is_sampled(b_status).alias("sampled"))
    return A.source_precedence(primary, bulk)
