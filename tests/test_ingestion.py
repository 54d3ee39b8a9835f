"""Landed files, matching, extraction, stores and screening on small fixtures."""

import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from straitline.functions import text as X
from straitline.operators import articles as A
from straitline.operators import extraction as E
from straitline.operators.sanctions import screen_actors
from straitline.sources import landing, stores
from straitline.streaming import slices as ST


def line(url="http://a/1", title="Tanker hit in the Strait of Hormuz &amp; on fire", themes="", translated="", published="20240101101500", n=27):
    fields = [""] * 27
    fields[1], fields[3], fields[4], fields[7], fields[25] = "20240101103000", "a.com", url, themes, translated
    fields[26] = (f"<PAGE_TITLE>{title}</PAGE_TITLE>" if title else "") + (
        f"<PAGE_PRECISEPUBTIMESTAMP>{published}</PAGE_PRECISEPUBTIMESTAMP>" if published else "")
    return "\t".join(fields[:n])


@pytest.fixture()
def slices(tmp_path):
    first = [line(), line("http://a/2", n=20), line("http://a/3", translated="srclc:fra"), line("http://a/4", title=""), line("", "x"),
             line("http://a/5", "Houthi missile hits airport in Riyadh"), line("http://a/6", "Houthi rebels seize vessel", published=None), ""]
    second = [line("http://a/1", "Oil tankers leave Hormuz again"), line("http://a/7", "Red Sea corals", themes="ENV_OIL;X")]
    for stamp, rows in (("20240101103000", first), ("20240101104500", second)):
        with zipfile.ZipFile(tmp_path / f"{stamp}.gkg.csv.zip", "w") as z:
            z.writestr("x.csv", "\n".join(rows).encode() + b"\xff")
    (tmp_path / "20240101110000.gkg.csv.zip").write_bytes(b"not an archive")
    with zipfile.ZipFile(tmp_path / "20240101111500.gkg.csv.zip", "w"):
        pass
    return str(tmp_path)


def test_slices_to_articles(spark, slices):
    lines = landing.read_slices(spark, slices).cache()
    assert {r.slice_ts.strftime("%H%M"): r.readable for r in lines.select("slice_ts", "readable").distinct().collect()} == {
        "1030": True, "1045": True, "1100": False, "1115": False}
    parsed = landing.parse_slices(lines)
    rows = {(r.url, r.slice_ts.minute): r for r in parsed.collect()}
    assert {u for u, _ in rows} == {"http://a/1", "http://a/5", "http://a/6", "http://a/7"}
    assert rows["http://a/1", 30].title == "Tanker hit in the Strait of Hormuz & on fire"
    matched = landing.match_slices(parsed)
    got = {(r.url, r.slice_ts.minute): r for r in matched.collect()}
    assert {k: r.corridor for k, r in got.items()} == {
        ("http://a/1", 30): "Hormuz", ("http://a/1", 45): "Hormuz", ("http://a/6", 30): "Red Sea", ("http://a/7", 45): "Red Sea"}
    assert got["http://a/1", 30].raw_text.split("\n") == [
        "Tanker hit in the Strait of Hormuz & on fire", "matched_corridor_query: Hormuz", "domain: a.com", "seendate: 20240101T101500Z"]
    assert got["http://a/6", 30].raw_text.endswith("seendate: 20240101T103000Z")
    first = A.dedupe_by_url(matched, order=["slice_ts", "line_no"])
    assert {r.url: r.slice_ts.minute for r in first.collect()} == {"http://a/1": 30, "http://a/6": 30, "http://a/7": 45}


def test_stream_of_slices_fills_the_store_once(spark, slices, tmp_path):
    store = str(tmp_path / "store")
    for run in range(2):
        lines = ST.stream_lines(spark, slices + "/*.zip")
        ST.store_articles(ST.stream_dedupe(ST.stream_articles(lines)), store, str(tmp_path / f"cp{run}")).awaitTermination()
    rows = spark.read.parquet(store)
    assert sorted(r.url for r in rows.collect()) == ["http://a/1", "http://a/6", "http://a/7"]


@pytest.mark.parametrize("title,want", [
    ("Riyadh airport near Hormuz supports measures", []), ("Tankers at Bab el-Mandeb", ["Red Sea"]), ("hormuz-bound crude", ["Hormuz"]),
    ("Cape route and Red Sea shipping", ["Red Sea", "Cape"]), ("houthi attack on riyadh", []), ("Hormuz closed", ["Hormuz"]), ("Jeddah port", ["Red Sea"])])
def test_corridor_tiers(spark, title, want):
    df = spark.createDataFrame([(title,)], "title string")
    assert df.select(X.match_corridors(F.col("title"), F.lit("http://x"))).first()[0] == want


def test_search_feed_sanctions_prices(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"articles": [
        {"url": "u1", "title": " T " , "domain": "d", "sourcecountry": "", "seendate": "20240101T000000Z"}, {"url": "", "title": "x"}, {"url": "u2", "title": " "}, {"url": "u3", "title": "y" * 600}]}))
    rows = {r.url: r for r in landing.read_search_dump(spark, str(tmp_path / "s.json"), "Cape").collect()}
    assert set(rows) == {"u1", "u3"} and len(rows["u3"].title) == 500
    assert rows["u1"].raw_text == "T\nmatched_corridor_query: Cape\ndomain: d\nseendate: 20240101T000000Z"
    feed = [{"feed": "f", "pos": i, "link": f"l{i}", "title": "t" if i else " ", "summary": "" if i == 1 else "s", "description": "d",
             "updated": "2024-01-02T03:04:05Z" if i == 2 else None} for i in range(6)]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, feed)))
    got = {r.url: r.raw_text for r in landing.read_feed_entries(spark, str(tmp_path / "f.json"), limit=4).collect()}
    assert got == {"l1": "d", "l2": "s\nseendate: 20240102T030405Z", "l3": "s"}
    (tmp_path / "o.csv").write_text('1,"ACME, LTD",-0- ,PROG,a,b,c,d,e,f,g,h\n2,short\n3,-0- ,x,P,a,b,c,d,e,f,g,h\n')
    assert [tuple(r) for r in landing.read_sanctions(spark, str(tmp_path / "o.csv")).collect()] == [("1", "ACME, LTD", "", "PROG")]
    prices = [{"period": "2024-01-03", "series": "B", "value": "71.5"}, {"period": "2024-01-01", "series": "B", "value": 70}, {"period": "2024-01-02", "series": "B", "value": None}, {"period": "bad", "series": "B", "value": 1}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, prices)))
    assert [(r.date, r.price_usd) for r in landing.read_prices(spark, str(tmp_path / "p.json")).collect()] == [(date(2024, 1, 1), 70.0), (date(2024, 1, 3), 71.5)]


def test_extraction_rules(spark):
    good = {"corridor": "Hormuz", "actor": "Iran", "event_type": "military", "severity": 4, "confidence": 0.9, "is_relevant": True}
    cases = {
        "fenced": ("```json\n" + json.dumps(good) + "\n```", ("Hormuz", "Iran", "military", 4, 0.9, True)),
        "clamped": (json.dumps({**good, "severity": 7, "confidence": 3, "corridor": " suez canal "}), ("Red Sea", "Iran", "military", 5, 1.0, True)),
        "words": (json.dumps({**good, "severity": "x", "confidence": None, "actor": ""}), ("Hormuz", "unknown", "military", 1, 0.1, True)),
        "truthy": (json.dumps({**good, "is_relevant": "false", "severity": "3.9"}), ("Hormuz", "Iran", "military", 3, 0.9, True)),
        "falsy": (json.dumps({**good, "is_relevant": [], "corridor": None}), ("None", "Iran", "military", 4, 0.9, False)),
        "low": (json.dumps({**good, "severity": 0, "confidence": -1, "event_type": "war", "is_relevant": 0.0}), ("Hormuz", "Iran", "other", 1, 0.0, False)),
        "missing": ("{}", ("None", "unknown", "other", 1, 0.1, False)),
        "list": (json.dumps([good]), None), "prose": ("sorry", None), "empty": ("", None), "null": (None, None), "broken": ("{bad json}", None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, reply string")
    rows = {r.k: r for r in E.classify_extractions(E.coerce_extractions(df)).collect()}
    for k, (_, want) in cases.items():
        assert (tuple(rows[k].parsed) if rows[k].parsed else None) == want, k
    assert rows["null"].outcome == "call_failed" and not rows["null"].processed and rows["broken"].processed


def test_seendate_and_tags(spark):
    text = ["t\nseendate: 20240101T000000Z\nx", "seendate: 2024", "x seendate: 20240101T000000Z", "seendate: 20241301T000000Z", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").select("i", X.parse_seendate(F.col("t")).alias("d"))
    assert {r.i for r in df.filter("d IS NOT NULL").collect()} == {0}
    tags = spark.createDataFrame([("<A> x\ny </A><A>z</A>",), (None,)], "t string").select(X.extract_tag(F.col("t"), "A").alias("v"))
    assert [r.v for r in tags.collect()] == ["x\ny", ""]


def test_screening_equals_substring_search(spark):
    names = ["Acme Shipping", "IR Lines", "Zed"]
    actors = ["acme", " LINES ", "e", "ir", "zeds", "", None, "hip", "xyz"]
    got = {r.actor: r.sanctioned for r in screen_actors(
        spark.createDataFrame([(a,) for a in actors], "actor string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {a: bool(a and a.strip()) and any(a.strip().lower() in n.lower() for n in names) for a in actors}


def test_article_store_never_touches_known_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *urls: spark.createDataFrame([(u, "s", "t" * 600, "r", datetime(2024, 1, 1), i) for i, u in enumerate(urls)], "url string, source string, title string, raw_text string, ingested_at timestamp, n int")
    assert stores.append_new_articles(path, rows("a", "b", "a", None, ""), ["n"]) == 2
    assert stores.append_new_articles(path, rows("b", "c"), ["n"]) == 1
    assert sorted((r.url, len(r.title), r.processed) for r in spark.read.parquet(path).collect()) == [("a", 500, False), ("b", 500, False), ("c", 500, False)]


def test_price_cache_spans(spark):
    px = lambda rows: spark.createDataFrame([("B", date.fromisoformat(d), p) for d, p in rows], "series string, date date, price_usd double")
    span = lambda a, b: spark.createDataFrame([("B", date.fromisoformat(a), date.fromisoformat(b))], "series string, covered_start date, covered_end date")
    ask = lambda d: spark.createDataFrame([("B", date.fromisoformat(d))], "series string, start date")
    cache = px([("2024-01-01", 1.0), ("2024-01-05", 2.0)])
    merged, cover = stores.upsert_prices(cache, span("2024-01-01", "2024-01-05"), px([("2024-01-05", 9.0), ("2024-01-08", 3.0)]), ask("2024-01-05"))
    assert sorted((r.date.day, r.price_usd) for r in merged.collect()) == [(1, 1.0), (5, 9.0), (8, 3.0)]
    assert cover.first().covered_end == date(2024, 1, 8)
    merged, cover = stores.upsert_prices(cache, span("2024-01-01", "2024-01-05"), px([("2024-01-20", 3.0)]), ask("2024-01-07"))
    assert [r.date.day for r in merged.collect()] == [20] and cover.first().covered_start == date(2024, 1, 7)


def test_reports_keep_other_k_apart(spark, tmp_path):
    path = str(tmp_path / "r")
    for k, v in ((3, "main"), (5, "other"), (3, "again")):
        stores.write_report(spark.createDataFrame([("e", k, v)], "event string, top_k int, v string"), path)
    assert {(r.top_k, r.v) for r in spark.read.json(path).collect()} == {(3, "again"), (5, "other")}


def test_network_seed_defaults(spark, tmp_path):
    files = {
        "suppliers": [{"name": "S", "country_code": "X", "region": "R", "avg_export_mbd": 1.0}], "corridors": [{"name": "C", "capacity_mbd": 999.0, "transit_days": 2}],
        "ports": [{"name": "P", "lat": 1.0, "lon": 2.0}], "refineries": [{"name": "F", "capacity_mbd": 0.5, "lat": 1.0, "lon": 2.0}],
        "alternatives": [{"name": "A", "transit_days": 3}],
        "edges": {"supplier_to_corridor": [{"supplier": "S", "corridor": "C", "volume_mbd": 0.7}], "corridor_to_port": [{"corridor": "C", "port": "P", "volume_mbd": 0.6}], "port_to_refinery": [{"port": "P", "refinery": "F", "volume_mbd": 0.4}]}}
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    from straitline.operators.flow import flow_value
    from straitline.operators.network import network_from_seed

    seed = landing.read_network_seed(spark, str(tmp_path))
    assert seed["corridors"].first().baseline_risk == 0.1 and seed["refineries"].first().min_run_rate == 0.70
    assert seed["alternatives"].first().transits_corridors == [] and seed["suppliers"].first().sanctioned is False
    assert flow_value(network_from_seed(seed)).first().flow == pytest.approx(0.4)


def test_sanctions_keep_listed_names_without_a_program(spark, tmp_path):
    (tmp_path / "s.csv").write_text('4,"X, Y",,\n5,"SHORT",""\n6,Z,-0- ,P,more,columns\n7,"",,\n')
    assert sorted(tuple(r) for r in landing.read_sanctions(spark, str(tmp_path / "s.csv")).collect()) == [("4", "X, Y", "", ""), ("6", "Z", "", "P")]


def test_sanctions_with_long_quoted_cells(spark, tmp_path):
    long = 'remark, ""quoted"", ' * 1000
    (tmp_path / "list.csv").write_text("\n".join([
        f'1,"SHIP, ONE",vessel,PROG,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"{long}"', f'2,"{long}",vessel,,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,x',
        '3,"SHORT, ROW",vessel', '4,PLAIN,-0- ,PROG']))
    rows = {r.ent_num: r for r in landing.read_sanctions(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "2", "4"} and rows["1"].name == "SHIP, ONE" and rows["2"].program == "" and len(rows["2"].name) > 15_000
    assert (rows["4"].entity_type, rows["4"].program) == ("", "PROG")
