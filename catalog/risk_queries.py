"""Queries over weights, statistics, stories, prices, series and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    AGE, EV, LEDGER, NOW, PRICES, WEV, WIN, day, ledger, now, prices, query, r6, risk_corridors, risk_events,
    saturating_sql, score_sql, table, windows,
)
from catalog.text_queries import ART, landed_articles
from straitline import constants as K
from straitline.functions.scoring import event_weight, normalize_saturating, normalize_severity
from straitline.functions.times import day_grid
from straitline.operators import point_in_time as P
from straitline.operators import prices as PX
from straitline.operators import scoring as S
from straitline.operators import series as SE
from straitline.operators import stories as ST
from straitline.plans.backtest import run_backtest

# --- weights and statistics -----------------------------------------------------------


@query("event_weights", f"WITH {WEV} SELECT event_id, round(w, 6) AS weight FROM wev")
def event_weights(spark, sf):
    return S.weighted_events(risk_events(spark, sf), now()).select("event_id", r6("weight").alias("weight"))


@query("normalized_values", f"""WITH {EV} SELECT event_id, round({score_sql('(value - 20) / 37', 'baseline')}, 6) AS severity_score,
round({saturating_sql('(value - 20)', 'baseline', 25.0)}, 6) AS saturating_score FROM ev JOIN base USING (corridor)""")
def normalized_values(spark, sf):
    e = risk_events(spark, sf).join(risk_corridors(spark, sf), F.col("corridor") == F.col("name"))
    b, raw = F.col("baseline_risk"), F.col("value") - 20
    return e.select("event_id", r6(normalize_severity(raw / 37, b)).alias("severity_score"),
                    r6(normalize_saturating(raw, b)).alias("saturating_score"))


@query("windowed_events", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 12 DAY AND ts <= TIMESTAMP '{NOW}'")
def windowed_events(spark, sf):
    return S.corridor_events(risk_events(spark, sf), now(), 12, exclude_future=True).select("event_id")


CORRIDOR_RISK_SQL = f"""WITH {WEV}, r AS (SELECT corridor, w, row_number() OVER (PARTITION BY corridor ORDER BY w DESC) AS k FROM wev),
raw AS (SELECT corridor, sum(w) / 3 AS raw FROM r WHERE k <= 3 GROUP BY corridor)
SELECT corridor, round(raw, 6) AS raw_score, round({score_sql('raw', 'baseline')}, 6) AS score FROM raw JOIN base USING (corridor)"""


@query("corridor_risk", CORRIDOR_RISK_SQL)
def corridor_risk(spark, sf):
    weighted = S.weighted_events(S.corridor_events(risk_events(spark, sf), now()), now())
    out = S.scores_from_weights(weighted, risk_corridors(spark, sf))
    return out.select("corridor", r6("raw_score").alias("raw_score"), r6("score").alias("score"))


@query("event_weight_totals", f"WITH {WEV} SELECT corridor, round(sum(w), 6) AS risk_sum FROM wev GROUP BY corridor")
def event_weight_totals(spark, sf):
    return S.risk_sum(risk_events(spark, sf), now(), deduplicate=False).select("corridor", r6("risk_sum").alias("risk_sum"))


STATS = f"""WITH {WEV}, r AS (SELECT corridor, w, row_number() OVER (PARTITION BY corridor ORDER BY w DESC) AS k FROM wev),
den AS (SELECT sum(exp(-CAST(0.1 AS DOUBLE) * {AGE})) AS d FROM events),
st AS (SELECT corridor, count(*) AS stories, sum(w) AS sum_sat, ln(1 + sum(w)) AS log_sat, avg(w) AS mean, max(w) AS top1,
  sum(w) FILTER (WHERE k <= 3) / count(*) FILTER (WHERE k <= 3) AS top3, sum(w) FILTER (WHERE k <= 3) / 3 AS top3pad,
  sum(w) FILTER (WHERE k <= 5) / 5 AS top5pad, 100 * sum(w) / (SELECT d FROM den) AS share,
  100 * sum(w) / (CAST(61000 AS DOUBLE) / CAST(0.1 AS DOUBLE)) AS share_scanned FROM r GROUP BY corridor)"""


def _statistics(spark, sf):
    e = risk_events(spark, sf)
    articles = e.select(F.lit("all").alias("source"), F.col("ts").alias("article_ts"))
    pool = S.decayed_article_count(articles, now())
    return S.statistics(S.weighted_events(e, now()), denominators=pool, scanned_per_day=61000.0)


@query("risk_statistics", STATS + "SELECT corridor, stories, " + ", ".join(f"round({c}, 6) AS {c}" for c in S.CANDIDATES) + " FROM st")
def risk_statistics(spark, sf):
    return _statistics(spark, sf).select("corridor", "stories", *[r6(c).alias(c) for c in S.CANDIDATES])


@query("decayed_articles", f"SELECT event_type AS source, round(sum(exp(-CAST(0.1 AS DOUBLE) * {AGE})), 6) AS denominator, count(*) AS articles FROM events GROUP BY 1")
def decayed_articles(spark, sf):
    rows = risk_events(spark, sf).select(F.col("corridor").alias("source"), F.col("ts").alias("article_ts"))
    return S.decayed_article_count(rows, now()).withColumn("denominator", r6("denominator"))


_NORMAL = {"sum_sat": 25.0, "log_sat": 2.0, "share": 25.0, "share_scanned": 0.05}
_CAND = " UNION ALL ".join(
    f"SELECT '{c}' AS candidate, corridor, {c} AS raw, {saturating_sql(c, 'baseline', _NORMAL[c]) if c in _NORMAL else score_sql(c, 'baseline')} AS score, stories, baseline FROM st JOIN base USING (corridor)"
    for c in S.CANDIDATES)


@query("candidate_scores", STATS + f""", cs AS ({_CAND}), g AS (SELECT candidate, (list_reverse_sort(list(score)))[1] - (list_reverse_sort(list(score)))[2] AS gap FROM cs GROUP BY candidate)
SELECT candidate, corridor, stories, round(raw, 6) AS raw, round(score, 6) AS score, round(gap, 6) AS gap,
  stories > 0 OR abs(score - baseline) <= 1e-9 AS baseline_ok FROM cs JOIN g USING (candidate)""")
def candidate_scores(spark, sf):
    out = S.candidate_scores(_statistics(spark, sf), risk_corridors(spark, sf))
    return out.select("candidate", "corridor", "stories", r6("raw").alias("raw"), r6("score").alias("score"), r6("gap").alias("gap"), "baseline_ok")


# --- stories over documents -------------------------------------------------------------

#: First instant of the pages, the time between two of them, and the span that all of them stay within: less than one lookback.
_PAGES_FROM, _PAGE_STEP, _PAGES_SPAN = 1704067200 * 10 ** 6, 600 * 10 ** 6, 170 * 86400 * 10 ** 6


def _page_instant(spark, sf, page):
    """Pages are ten minutes apart, or closer where the table is so large that the last lookback would not see all of them."""
    last = table(spark, sf, "pages").agg(F.max("page_id")).first()[0] or 0
    return F.timestamp_micros(F.lit(_PAGES_FROM) + F.coalesce(page, F.lit(last)) * min(_PAGE_STEP, _PAGES_SPAN // (last + 1)))


def document_events(spark, sf):
    """Web pages as events: the language as corridor, the host as source, the whole title as headline."""
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("event_id"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("corridor"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"),
        (F.length("html") % 5 + 1).cast("int").alias("severity"), ((F.length("html") % 10 + 1) / F.lit(10.0)).alias("confidence"),
        _page_instant(spark, sf, F.col("page_id")).alias("ts"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def document_corridors(spark, sf):
    return document_events(spark, sf).select(F.col("corridor").alias("name")).distinct().withColumn("baseline_risk", F.lit(0.1))


def _after_documents(spark, sf):
    """Scoring instant: that of the last page."""
    return _page_instant(spark, sf, F.lit(None).cast("long"))


@query("similar_titles")
def similar_titles(spark, sf):
    return ST.similar_titles(document_events(spark, sf))


@query("stories")
def stories(spark, sf):
    out = ST.build_stories(document_events(spark, sf), _after_documents(spark, sf))
    return out.select("corridor", "story_id", r6("weight").alias("weight"), "title", "members")


@query("story_syndication")
def story_syndication(spark, sf):
    return ST.syndication(ST.cluster_stories(document_events(spark, sf)))


@query("story_risk")
def story_risk(spark, sf):
    out = S.score_corridors(document_events(spark, sf), document_corridors(spark, sf), _after_documents(spark, sf))
    return out.select("corridor", r6("raw_score").alias("raw_score"), r6("score").alias("score"))


@query("story_weight_totals")
def story_weight_totals(spark, sf):
    return S.risk_sum(document_events(spark, sf), _after_documents(spark, sf)).select("corridor", r6("risk_sum").alias("risk_sum"))


# Exact titles only: each event's story is its title, so SQL can follow the strongest member rule.
_BEST = f"""WITH d AS (SELECT page_id AS doc_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, length(html) % 5 + 1 AS sev,
  CAST(length(html) % 10 + 1 AS DOUBLE) / CAST(10 AS DOUBLE) AS conf, regexp_extract(url, '^https?://([^/]+)', 1) AS source,
  make_timestamp({_PAGES_FROM} + page_id * least({_PAGE_STEP}, {_PAGES_SPAN} // ((SELECT max(page_id) FROM pages) + 1))) AS ts FROM pages),
w AS (SELECT *, sev * conf * exp(-CAST(0.1 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), (epoch_us((SELECT max(ts) FROM d)) - epoch_us(ts)) / CAST(86400000000 AS DOUBLE))) AS w FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY w DESC, ts, doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS members,
  min(doc_id) OVER (PARTITION BY lang, source) AS story_id FROM w)
SELECT lang AS corridor, story_id, round(w, 6) AS weight, CAST(sev AS INTEGER) AS severity, conf AS confidence, members FROM r WHERE k = 1"""


@query("strongest_members", _BEST)
def strongest_members(spark, sf):
    """The strongest-member rule on given groups: all pages of one host and language."""
    from pyspark.sql import Window as W

    e = document_events(spark, sf)
    first = e.groupBy("corridor", "source").agg(F.min("event_id").alias("story_id"))
    out = ST.strongest_members(e.join(first, ["corridor", "source"]), _after_documents(spark, sf))
    return out.select("corridor", "story_id", r6("weight").alias("weight"), "severity", "confidence", "members")


@query("volume_sensitivity")
def volume_sensitivity(spark, sf):
    e = document_events(spark, sf)
    articles = e.select("source", F.col("ts").alias("article_ts"))
    out = S.volume_sensitivity(e, articles, document_corridors(spark, sf), _after_documents(spark, sf))
    return out.select("candidate", "slice", "corridor", r6("raw").alias("raw"), r6("ratio").alias("ratio"))


# --- prices ----------------------------------------------------------------------------------

RET = f"""{PRICES}, ret AS (SELECT *, (price - prev) / prev * 100 AS pct FROM (SELECT *, lag(price) OVER (ORDER BY date) AS prev FROM px) WHERE prev IS NOT NULL AND prev <> 0)"""


@query("daily_returns", f"WITH {RET} SELECT strftime(date, '%Y-%m-%d') AS date, round(pct, 6) AS pct_change FROM ret")
def daily_returns(spark, sf):
    return PX.daily_returns(prices(spark, sf)).select(day("date").alias("date"), r6("pct_change").alias("pct_change"))


for _name, _where, _order in (("up", "pct > 0", "pct DESC"), ("down", "pct < 0", "pct"), ("either", "true", "abs(pct) DESC")):
    @query(f"largest_moves_{_name}", f"WITH {RET} SELECT strftime(date, '%Y-%m-%d') AS date, round(pct, 6) AS pct_change FROM ret WHERE {_where} ORDER BY {_order}, date LIMIT 10")
    def largest_moves(spark, sf, _direction=_name):
        return PX.largest_moves(prices(spark, sf), 10, _direction).select(day("date").alias("date"), r6("pct_change").alias("pct_change"))


@query("prices_as_of", f"""WITH {PRICES}, k AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT strftime(k.day, '%Y-%m-%d') AS day, strftime(px.date, '%Y-%m-%d') AS price_date, price FROM k ASOF LEFT JOIN px ON k.day >= px.date""")
def prices_as_of(spark, sf):
    keys = table(spark, sf, "lineitem").select(F.lit("all").alias("series"), F.to_date("l_shipdate").alias("day")).distinct()
    return PX.price_as_of(prices(spark, sf), keys).select(
        day("day").alias("day"), day("price_date").alias("price_date"), F.col("price_usd").alias("price"))


@query("attached_prices", f"""WITH {PRICES}, k AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1)
SELECT strftime(k.day, '%Y-%m-%d') AS day, n, price FROM k LEFT JOIN px ON k.day = px.date""")
def attached_prices(spark, sf):
    days = table(spark, sf, "lineitem").groupBy(F.lit("all").alias("series"), F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return PX.attach_price(days, prices(spark, sf)).select(day("day").alias("day"), "n", F.col("price_usd").alias("price"))


def _yearly(spark, sf):
    """Prices as one series per year, with a target climb from the year's low to its high."""
    px = prices(spark, sf).withColumn("series", F.date_format("date", "yyyy"))
    ends = px.groupBy("series").agg(F.min("price_usd").alias("lo"), F.max("price_usd").alias("hi"))
    width = F.col("hi") - F.col("lo")
    return px.join(ends, "series").withColumn("low", F.col("lo") + width * 0.25).withColumn("high", F.col("lo") + width * 0.75)


@query("price_run_ups", f"""WITH {PRICES}, y AS (SELECT strftime(date, '%Y') AS series, date, price, min(price) OVER w AS lo, max(price) OVER w AS hi FROM px WINDOW w AS (PARTITION BY strftime(date, '%Y'))),
b AS (SELECT *, lo + (hi - lo) * CAST(0.25 AS DOUBLE) + 2 AS low, lo + (hi - lo) * CAST(0.75 AS DOUBLE) - 2 AS high FROM y),
c AS (SELECT a.series, a.date AS start, a.price AS start_usd, (SELECT min(n.date) FROM b n WHERE n.series = a.series AND n.date > a.date AND (n.price <= n.low OR n.price >= n.high)) AS nxt FROM b a WHERE a.price <= a.low),
d AS (SELECT c.series, start, start_usd, b.date AS peak, b.price AS peak_usd, b.date - start AS days FROM c JOIN b ON b.series = c.series AND b.date = nxt WHERE b.price > b.low AND b.price >= b.high),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY days, start) AS k FROM d)
SELECT series, strftime(start, '%Y-%m-%d') AS start, strftime(peak, '%Y-%m-%d') AS peak, days, round((peak_usd - start_usd) / start_usd * 100, 6) AS pct_change FROM r WHERE k = 1""")
def price_run_ups(spark, sf):
    out = PX.find_run_up(_yearly(spark, sf), F.col("low"), F.col("high"))
    return out.select("series", day("start").alias("start"), day("peak").alias("peak"), "days", r6("pct_change").alias("pct_change"))


# --- day series --------------------------------------------------------------------------------

def _value_series(spark, sf):
    return risk_events(spark, sf).groupBy("corridor", F.to_date("ts").alias("day")).agg(r6(F.avg("value")).alias("score"))


SERIES = """ser AS (SELECT event_type AS corridor, CAST(ts AS DATE) AS day, round(avg(value), 6) AS score FROM events GROUP BY ALL)"""
RUNS = """marks AS (SELECT *, score > 50 AS above, sum(CASE WHEN score > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY corridor ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM ser),
runs AS (SELECT corridor, min(day) AS start, max(day) AS "end", max(day) - min(day) + 1 AS days, max(score) AS peak, arg_min(day, (-score, day)) AS peak_at FROM marks WHERE above GROUP BY corridor, run)"""


@query("risk_excursions", f"""WITH {SERIES}, {RUNS} SELECT corridor, strftime(start, '%Y-%m-%d') AS start, strftime("end", '%Y-%m-%d') AS "end", days, peak, strftime(peak_at, '%Y-%m-%d') AS peak_at FROM runs""")
def risk_excursions(spark, sf):
    out = SE.excursions(_value_series(spark, sf), 50.0, ("corridor",))
    return out.select("corridor", day("start").alias("start"), day("end").alias("end"), "days", "peak", day("peak_at").alias("peak_at"))


MISS = f"""{WIN}, {LEDGER}, miss AS (SELECT event, day FROM grid WHERE (event, day) NOT IN (SELECT (event, day) FROM led WHERE status = 'ok'))"""


def _missing(spark, sf):
    return SE.missing_days(day_grid(windows(spark, sf), warmup=True), ledger(spark, sf))


@query("missing_days", f"WITH {MISS} SELECT event, strftime(day, '%Y-%m-%d') AS day FROM miss")
def missing_days(spark, sf):
    return _missing(spark, sf).select("event", day("day").alias("day"))


@query("gap_ranges", f"""WITH {MISS}, i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY event ORDER BY day) AS INTEGER) AS g FROM miss)
SELECT event, strftime(min(day), '%Y-%m-%d') AS start, strftime(max(day), '%Y-%m-%d') AS "end", count(*) AS days FROM i GROUP BY event, g""")
def gap_ranges(spark, sf):
    return SE.gap_ranges(_missing(spark, sf)).select("event", day("start").alias("start"), day("end").alias("end"), "days")


@query("flagged_days", f"""WITH {MISS}, c AS (SELECT event, day FROM grid JOIN win USING (event) WHERE day >= chart_start)
SELECT event, strftime(day, '%Y-%m-%d') AS day, (event, day) NOT IN (SELECT (event, day) FROM miss) AS day_sampled,
  (SELECT count(*) FROM miss WHERE miss.event = c.event AND miss.day <= c.day) AS unsampled_days_in_lookback FROM c""")
def flagged_days(spark, sf):
    chart = day_grid(windows(spark, sf)).select("event", "day")
    return SE.flag_gaps(chart, _missing(spark, sf)).select(
        "event", day("day").alias("day"), "day_sampled", "unsampled_days_in_lookback")


@query("pull_coverage", f"""WITH {WIN}, {LEDGER} SELECT event, count(*) AS days_expected, count(*) FILTER (WHERE status = 'ok') AS days_ok,
  count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') AS days_missing, CAST(coalesce(sum(slices_read) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS slices_read,
  CAST(coalesce(sum(slices_total) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS slices_total, CAST(coalesce(sum(stored) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS articles_stored,
  count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') = 0 AS complete FROM grid LEFT JOIN led USING (event, day) GROUP BY event""")
def pull_coverage(spark, sf):
    return SE.pull_coverage(windows(spark, sf), ledger(spark, sf)).withColumn("days_missing", F.size("days_missing").cast("bigint"))


@query("pending_articles", f"""WITH {WIN}, {ART} SELECT event, (SELECT count(*) FROM art WHERE NOT processed AND seen >= chart_start + INTERVAL '16:30:00' HOUR TO SECOND - INTERVAL 180 DAY
  AND seen <= "end" + INTERVAL '16:30:00' HOUR TO SECOND) AS pending FROM win""".replace("INTERVAL '16:30:00' HOUR TO SECOND", "INTERVAL '990 minutes'"))
def pending_articles(spark, sf):
    return SE.pending_in_scope(windows(spark, sf), landed_articles(spark, sf))


@query("window_event_counts", f"""WITH {WIN}, c AS (SELECT DISTINCT event_type AS corridor FROM events)
SELECT event, c.corridor, (SELECT count(*) FROM events WHERE event_type = c.corridor AND ts >= chart_start - 7 AND ts <= "end" + INTERVAL '990 minutes') AS events FROM win CROSS JOIN c""")
def window_event_counts(spark, sf):
    return SE.event_counts(windows(spark, sf), risk_events(spark, sf), risk_corridors(spark, sf))


# --- point in time ----------------------------------------------------------------------------------

_DAYS = "days AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM events)"


def _calendar(spark, sf):
    """Every day from the first event to the day after the last."""
    from straitline.functions.times import as_of

    span = table(spark, sf, "events").agg(F.to_date(F.min("ts")).alias("a"), F.date_add(F.to_date(F.max("ts")), 1).alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day")).withColumn("as_of", as_of(F.col("day")))


def _seen_sql(lookback: int, extra: str) -> str:
    return f"""WITH {EV}, {_DAYS}, s AS (SELECT corridor, days.day, severity * confidence * exp(-CAST(0.1 AS DOUBLE) * (epoch_us(days.day + INTERVAL '990 minutes') - epoch_us(ts)) / CAST(86400000000 AS DOUBLE)) AS w
  FROM ev JOIN days ON ts <= days.day + INTERVAL '990 minutes' AND ts >= days.day + INTERVAL '990 minutes' - INTERVAL {lookback} DAY)
SELECT corridor, strftime(day, '%Y-%m-%d') AS day, count(*) AS events{extra} FROM s GROUP BY ALL"""


@query("as_of_totals", _seen_sql(180, ", round(sum(w), 6) AS weight"))
def as_of_totals(spark, sf):
    out = P.as_of_totals(risk_events(spark, sf), _calendar(spark, sf), 180)
    return out.select("corridor", day("day").alias("day"), "events", r6("weight").alias("weight"))


@query("events_by_as_of", _seen_sql(180, ""))
def events_by_as_of(spark, sf):
    seen = P.events_by_as_of(risk_events(spark, sf), _calendar(spark, sf), 180)
    return seen.groupBy("corridor", day("day").alias("day")).agg(F.count("*").alias("events"))


def _titled_events(spark, sf):
    """Risk events with the headline of the page whose number is their user's, so copies recur over time."""
    titles = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return risk_events(spark, sf).join(titles, F.col("user_id") == F.col("page_id"), "left").drop("page_id")


@query("score_series")
def score_series(spark, sf):
    series, _ = P.score_series(_titled_events(spark, sf), risk_corridors(spark, sf), windows(spark, sf))
    return series.select("event", "corridor", day("day").alias("day"), "raw", "score", "stories", "events")


@query("top_stories_per_day")
def top_stories(spark, sf):
    _, tops = P.score_series(_titled_events(spark, sf), risk_corridors(spark, sf), windows(spark, sf))
    return P.top_stories_per_day(tops, windows(spark, sf)).select(
        "event", day("day").alias("day"), F.size("top_stories").alias("stories"),
        F.to_json("top_stories").alias("top_stories"))


# --- price events and verdicts -----------------------------------------------------------------------

def _signal(spark, sf):
    """Daily order count of each status above its mean, in [0, 1], as the signal of a price window per year."""
    o = table(spark, sf, "orders")
    daily = o.groupBy(F.date_format("o_orderdate", "yyyy").alias("event"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    top = daily.groupBy("event").agg(F.max("n").alias("top"))
    return daily.join(top, "event").select("event", "day", r6(F.col("n") / F.col("top")).alias("score"))


def _price_windows(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("event")).agg(
        F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return o.select("event", F.lit("orders").alias("corridor"), F.lit("all").alias("series"),
                    F.date_add("lo", 30).alias("chart_start"), F.date_sub("hi", 30).alias("end"))


PWIN = """pw AS (SELECT strftime(o_orderdate, '%Y') AS event, CAST(min(o_orderdate) AS DATE) + 30 AS chart_start, CAST(max(o_orderdate) AS DATE) - 30 AS "end" FROM orders GROUP BY 1)"""
SPIKE = """spike AS (SELECT event, arg_min(ret.date, ret.date) AS spiked_at, arg_min(pct, ret.date) AS pct FROM pw JOIN ret ON ret.date BETWEEN chart_start AND "end" AND pct >= 150 GROUP BY event)"""


@query("price_events", f"WITH {RET}, {PWIN}, {SPIKE} SELECT event, strftime(spiked_at, '%Y-%m-%d') AS spiked_at, round(pct, 6) AS spike_pct FROM spike")
def price_events(spark, sf):
    out = PX.find_price_events(prices(spark, sf), _price_windows(spark, sf), 150.0)
    return out.select("event", day("spiked_at").alias("spiked_at"), r6("spike_pct").alias("spike_pct"))


VERDICTS = f"""{RET}, {PWIN}, {SPIKE},
dn AS (SELECT strftime(o_orderdate, '%Y') AS event, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL),
ser AS (SELECT event AS corridor, dn.day, round(n / CAST(max(n) OVER (PARTITION BY event) AS DOUBLE), 6) AS score FROM dn),
chart AS (SELECT ser.* FROM ser JOIN pw ON event = corridor WHERE day BETWEEN chart_start AND "end"),
marks AS (SELECT *, sum(CASE WHEN score > 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY corridor ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM chart),
runs AS (SELECT corridor AS event, min(day) AS start, max(day) AS "end" FROM marks WHERE score > 0.6 GROUP BY corridor, run),
rel AS (SELECT event, min(start) AS elevated_at FROM runs JOIN spike USING (event) WHERE "end" >= spiked_at AND start <= spiked_at + 2 GROUP BY event),
fa AS (SELECT event, count(*) AS n FROM runs JOIN spike USING (event) WHERE "end" < spiked_at GROUP BY event),
v AS (SELECT pw.event, chart_start, spiked_at, elevated_at, spiked_at - elevated_at AS lead_days, coalesce(fa.n, 0) AS false_alarms,
  (SELECT max(score) FROM chart WHERE corridor = pw.event) AS max_score,
  CASE WHEN spiked_at IS NULL THEN 'NO_PRICE_EVENT' WHEN elevated_at IS NULL THEN 'FAILED' WHEN elevated_at = chart_start THEN 'INCONCLUSIVE' ELSE 'PASSED' END AS validation
  FROM pw LEFT JOIN spike USING (event) LEFT JOIN rel USING (event) LEFT JOIN fa USING (event))"""


def _verdicts(spark, sf):
    return SE.validate(_signal(spark, sf), prices(spark, sf), _price_windows(spark, sf), spike_pct=150.0)


@query("verdicts", f"""WITH {VERDICTS} SELECT event, strftime(spiked_at, '%Y-%m-%d') AS spiked_at, strftime(elevated_at, '%Y-%m-%d') AS elevated_at, lead_days, false_alarms, max_score, validation FROM v""")
def verdicts(spark, sf):
    return _verdicts(spark, sf).select(
        "event", day("spiked_at").alias("spiked_at"), day("elevated_at").alias("elevated_at"), "lead_days",
        F.size("false_alarms").cast("bigint").alias("false_alarms"), "max_score", "validation")


@query("final_verdicts", f"""WITH {VERDICTS}, led AS (SELECT event, day, n % 3 = 0 AS gone FROM dn),
g AS (SELECT event, CAST(unnest(generate_series(CAST(chart_start - 7 AS TIMESTAMP), CAST("end" AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM pw),
m AS (SELECT event, count(*) AS n FROM g LEFT JOIN led USING (event, day) WHERE gone IS NULL OR gone GROUP BY event),
q AS (SELECT event, sum(CASE WHEN n % 2 = 0 AND day BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' THEN 1 ELSE 0 END) AS pending FROM dn GROUP BY event)
SELECT event, CASE WHEN coalesce(m.n, 0) > 0 OR pending > 0 THEN 'INCOMPLETE' ELSE validation END AS validation,
  CASE WHEN coalesce(m.n, 0) > 0 OR pending > 0 THEN validation END AS validation_if_complete,
  concat_ws('; ', CASE WHEN coalesce(m.n, 0) > 0 THEN m.n || ' pull day(s) not sampled' END, CASE WHEN pending > 0 THEN pending || ' in-scope article(s) not yet extracted' END) || ' (series alone says ' || validation || ')' AS reason
FROM v LEFT JOIN m USING (event) JOIN q USING (event) WHERE coalesce(m.n, 0) > 0 OR pending > 0""")
def final_verdicts(spark, sf):
    w = _price_windows(spark, sf)
    daily = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("event"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    led = daily.select("event", "day", F.when(F.col("n") % 3 == 0, "error").otherwise("ok").alias("status"),
                       F.col("n").alias("slices_read"), F.col("n").alias("slices_total"), F.col("n").alias("stored"))
    pending = daily.groupBy("event").agg(F.count_if((F.col("n") % 2 == 0) & F.col("day").between("1999-01-01", "2000-12-31")).alias("pending"))
    priced = w.select("event", F.lit(True).alias("has_prices"))
    out = SE.final_verdict(_verdicts(spark, sf), SE.pull_coverage(w, led), pending, priced)
    return out.filter("validation_if_complete IS NOT NULL").select("event", "validation", "validation_if_complete", "reason")


@query("backtest_report")
def backtest_report(spark, sf):
    """Full backtest of one window per event type; the daily value of orders a year back is the price."""
    span = windows(spark, sf).withColumn("series", F.lit("all")).withColumn("name", F.col("event")).withColumn("note", F.lit("")) \
        .withColumn("run_up_low", F.lit(None).cast("double")).withColumn("run_up_high", F.lit(None).cast("double"))
    px = prices(spark, sf).withColumn("date", F.to_date(F.add_months("date", 12 * 5)))
    px = px.groupBy("series", "date").agg(F.max("price_usd").alias("price_usd"))
    out = run_backtest(_titled_events(spark, sf), risk_corridors(spark, sf), span, px, ledger(spark, sf), landed_articles(spark, sf))
    return out.select("event", "validation", "validation_if_complete", "lead_days", "max_score", "days_ok", "pending",
                      F.size("series").alias("charted_days"), F.to_json("gaps").alias("gaps"), F.to_json("events_in_window").alias("events_in_window"))
