"""Queries on tables as larger runs have them: folders of part files."""

import pytest

from __spark_entry__ import oracle_sql, queries

HOSTS = 7


@pytest.fixture(scope="module")
def pages_in_parts(spark, tmp_path_factory):
    """Pages as a folder of part files, beside a second table that a stream must not read."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"http://host{i % HOSTS}.org/{i}", f'<html lang="{"en" if i % 2 else "de"}"><title>{"ship oil " * (i % 4)}</title>') for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(4).write.parquet(f"{folder}/pages.parquet")
    pages.withColumn("url", pages.html).coalesce(1).write.parquet(f"{folder}/other.parquet")
    return folder


def against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    rows = queries()[name](spark, folder)
    asked = con.execute(oracle_sql()[name])
    names = [d[0] for d in asked.description]
    want = [tuple(r[names.index(c)] for c in rows.columns) for r in asked.fetchall()]
    return sorted(map(tuple, rows.collect())), sorted(want)


def test_stream_deduped_reads_all_parts_of_a_table(spark, pages_in_parts):
    got, want = against_sql(spark, pages_in_parts, "stream_deduped")
    assert got == want and len(got) == HOSTS


def test_stream_first_sightings_reads_all_parts_of_a_table(spark, pages_in_parts):
    got, want = against_sql(spark, pages_in_parts, "stream_first_sightings")
    assert got == want and len(got) == HOSTS


def test_stream_stories_reads_all_parts_of_a_table(spark, pages_in_parts):
    streamed = queries()["stream_stories"](spark, pages_in_parts).collect()
    assert sum(r.events for r in streamed) == 60
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, queries()["story_syndication"](spark, pages_in_parts).collect()))


TITLES = ["", " A &amp; B ", "cut &am", "cut &amp", "&ampere &amp;amp;", "&notit; &notin; &not", "&lt;b&gt &#60; &#x3C &#X3c;x", "&#128; &#x80 &#0; &#13;|", "&#1;|&#11;|&#xFFFE;|",
          "&#xD800; &#1114112; &#99999999999999999999999; &#x0000000000000041; &#xfffffffffffffffffff;", "&NotEqualTilde; &acE; &Aacute &Aacute;", "&; & &# &#; &#x; &x &unknown; &&amp&&", "&CounterClockwiseContourIntegral; &CounterClockwiseContourIntegralx;",
          "&ThisNameIsFarTooLongToBeTheNameOfAnything;", "&fjlig; &#x1F600; &#233;t&eacute"]


def test_unescaped_titles_and_their_sql_read_all_character_references(spark, tmp_path):
    import html

    rows = [(i, f"<html><title>{t}</title>") for i, t in enumerate(TITLES)] + [(len(TITLES), None), (3, f"<title>{TITLES[3]}</title>")]
    spark.createDataFrame(rows, "page_id long, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got, want = against_sql(spark, str(tmp_path), "unescaped_titles")
    assert got == want
    assert dict(got) == {**{i: html.unescape(t.strip()) for i, t in enumerate(TITLES)}, len(TITLES): ""}


def test_titles_are_compared_once_for_all_keys_and_windows(monkeypatch):
    import numpy as np
    import pandas as pd

    from straitline.functions import similarity
    from straitline.operators import title_groups

    compared, bound = [], similarity.TitleBlock.may_match
    monkeypatch.setattr(similarity.TitleBlock, "may_match", lambda self, a, b, t: compared.append(len(a)) or bound(self, a, b, t))
    titles = ["oil tanker seized", "oil tanker seized again", "port closed", "far away"]
    rows = [(1, 1, "1", key, 10 * k + i, t, np.array([0, 1, 2] if i < 3 else [9])) for k, key in enumerate("xyz") for i, t in enumerate(titles)]
    links = title_groups._forest(pd.DataFrame(rows, columns=["left", "right", "tile", "story_key", "tid", "norm", "windows"]))
    assert sorted((k, *sorted(ab)) for k, *ab in links.to_numpy().tolist()) == [("x", 0, 1), ("y", 10, 11), ("z", 20, 21)]
    assert sum(compared) == 3  # of six pairs three meet, each in three keys and three windows


def test_events_are_clustered_once_for_all_windows(spark, monkeypatch):
    from datetime import date, datetime, timedelta

    from straitline.operators import point_in_time

    rows = [(i, "c", 3, 0.5, datetime(2024, 1, 1) + timedelta(hours=7 * i), f"title {i % 5}") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, corridor string, severity int, confidence double, ts timestamp, title string")
    corridors = spark.createDataFrame([("c", 0.1)], "name string, baseline_risk double")
    windows = spark.createDataFrame([(f"w{i}", "c", date(2024, 1, 3), date(2024, 1, 8 + i)) for i in range(4)], "event string, corridor string, chart_start date, end date")
    seen, cluster = [], point_in_time.cluster_stories
    monkeypatch.setattr(point_in_time, "cluster_stories", lambda e, keys: seen.append(e.count()) or cluster(e, keys))
    series, tops = point_in_time.score_series(events, corridors, windows)
    assert sum(seen) <= 40
    found = {(r.event, r.day): (r.raw, r.stories, r.events) for r in series.collect()}
    assert len(found) == 6 + 7 + 8 + 9
    for (event, day), told in found.items():  # a shorter window reads as a longer one does
        assert told == found["w3", day]
    assert found["w3", date(2024, 1, 11)][2] == sum(r[4] <= datetime(2024, 1, 11, 16, 30) for r in rows)


def test_windows_meet_a_row_a_story_and_day_not_the_events(spark, monkeypatch):
    from datetime import date, datetime, timedelta

    from straitline.operators import point_in_time

    start = datetime(2024, 1, 1)
    rows = [(i, "c", i % 5 + 1, 0.5, start + timedelta(minutes=12 * i), ("oil tanker seized", "port closed at night")[i % 2]) for i in range(1000)]
    rows += [(1000 + d, "c", 4, 0.25, datetime(2024, 1, 3 + d, 16, 30), "port closed at night") for d in range(4)]  # on the instant
    events = spark.createDataFrame(rows, "event_id long, corridor string, severity int, confidence double, ts timestamp, title string")
    corridors = spark.createDataFrame([("c", 0.1)], "name string, baseline_risk double")
    windows = spark.createDataFrame([(f"w{i}", "c", date(2024, 1, 2 + i), date(2024, 1, 6)) for i in range(4)], "event string, corridor string, chart_start date, end date")
    stored, keep, found = [], point_in_time.checkpointed, {}

    def spy(df):
        out = keep(df)
        stored.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(point_in_time, "checkpointed", spy)
    series, tops = point_in_time.score_series(events, corridors, windows, k=10)
    of_stories = [n for columns, n in stored if "story_id" in columns]
    # Six days see some of four stories; before, every window stored them for itself.
    assert of_stories and max(of_stories) <= 6 * 4
    for r in series.collect():
        assert r.events == sum(e[4] <= r.as_of for e in rows)
        assert found.setdefault(r.day, (r.raw, r.stories, r.events)) == (r.raw, r.stories, r.events)
    kept = tops.collect()
    assert len(kept) > 0 and all(r.members <= sum(e[4] <= datetime(r.day.year, r.day.month, r.day.day, 16, 30) for e in rows) for r in kept)
    per_day = {}
    for r in kept:
        per_day.setdefault((r.day, r.story_id), set()).add((r.members, r.weight, r.title, r.place))
    assert all(len(told) == 1 for told in per_day.values())
    # Every event belongs to one story, and all stories of these days are placed.
    for r in series.collect():
        assert sum(t.members for t in kept if (t.event, t.day) == (r.event, r.day)) == r.events


def test_similar_titles_of_copies_read_each_event_a_few_times(spark, monkeypatch):
    from datetime import datetime, timedelta

    from straitline.operators import stories as ST

    monkeypatch.setattr(ST, "TILE", 20)
    monkeypatch.setattr(ST, "SLICE", 30, raising=False)
    titles = ["oil tanker seized", "port closed at night", "oil tanker seized again", "far away"]
    rows = [(i, "c", datetime(2024, 1, 1) + timedelta(minutes=35 * (i // 2)), titles[i * i % 7 % 4]) for i in range(600)]
    read, spread = [], ST._spread
    monkeypatch.setattr(ST, "_spread", lambda df, *keys: read.append(df.count()) or spread(df, *keys))
    got = {r.event_id: r.similar_id for r in ST.similar_titles(spark.createDataFrame(rows, "event_id long, corridor string, ts timestamp, title string")).collect()}
    alike, want = {titles[0], titles[2]}, {}
    for i, (_, _, ts, title) in enumerate(rows):
        for j, _, at, other in rows[:i]:
            if ts - at <= timedelta(days=3) and (title == other or {title, other} == alike):
                want[i] = j
                break
    assert got == want and len(want) > 500
    assert sum(read) <= 4 * len(rows)


def test_token_blocks_are_read_one_at_a_time(spark, tmp_path, monkeypatch):
    from straitline.llm import rans

    docs = spark.createDataFrame([(i, f"word{i} " * (i % 9)) for i in range(300)] + [(None, None), (7, "again")], "doc_id long, text string")
    tokens = rans.stored(rans.tokenize(docs, "doc_id", "text"), "tokens")
    want = sorted((r.id is not None, r.id or 0, bytes(r.ids)) for r in tokens.collect())
    # Everything in one partition of many blocks, as a large file has them.
    rans.write_tokens(tokens, f"{tmp_path}/t", block_tokens=64, narrow=rans.stored_type())
    monkeypatch.setattr(rans, "arrow_map", None)  # reads several hundred blocks before it gives anything
    rows = rans.read_tokens(spark, f"{tmp_path}/t").collect()
    import numpy as np

    assert sorted((r.id is not None, r.id or 0, np.frombuffer(r.ids, "<u4").astype(rans.stored_type()).tobytes()) for r in rows) == want
    assert sorted(r.start for r in rows)[0] == 0 and len({r.start for r in rows}) == len(rows)


def test_refinery_inflow_stores_no_row_per_refinery_and_scenario(spark, monkeypatch):
    from straitline.operators import criticality, flow, network, ordered

    rows = [("n", 0, "SOURCE", f"s{c}", None, 90.0) for c in "ab"] + [("n", 1, f"s{c}", c, None, 90.0) for c in "ab"]
    rows += [("n", 2, c, p, c, 40.0 + 10 * (c == p)) for c in "ab" for p in "abz" if p != "z"]
    rows += [("n", 3, "abz"[i % 3], f"r{i:03}", None, 1.0 + i % 4) for i in range(150)]  # nothing reaches port z
    rows += [("n", 4, f"r{i:03}", "SINK", None, 2.5) for i in range(151)]  # nothing feeds the last one
    edges = spark.createDataFrame([r + (r[-1],) for r in rows], "network_id string, layer int, src string, dst string, corridor string, volume double, effective_capacity double")
    scenarios = spark.createDataFrame(
        [("n", f"{c}{pct}", c, float(pct), None) for c in "ab" for pct in (20, 50, 80, 100)] + [("n", "supply", None, None, 120.0)],
        "network_id string, scenario_id string, corridor string, degradation_pct double, supply_reduction double")
    stored, keep = [], flow.checkpointed

    def spy(df):
        out = keep(df)
        stored.append(out.count())
        return out

    for module in (flow, ordered, criticality):
        monkeypatch.setattr(module, "checkpointed", spy)
    monkeypatch.setattr(flow, "CUT_BLOCKS", 4)
    impact, affected = criticality.scenario_impact(edges, scenarios)
    told = {r.scenario_id: r for r in impact.collect()}
    lost = {}
    for r in affected.collect():
        lost.setdefault(r.scenario_id, []).append(r.baseline - r.current)
    assert max(stored) <= 2 * 151  # before: one row per refinery and scenario
    for c in "ab":
        for pct in (20, 50, 80, 100):
            copy = network.degrade_corridor(edges, scenarios.filter(f"scenario_id = '{c}{pct}'")).drop("scenario_id")
            now = {r.refinery: r.inflow for r in flow.sink_inflow(copy).collect()}
            assert len(now) == 151 and now["r150"] == 0 and now["r002"] == 0
            assert abs(sum(now.values()) - told[f"{c}{pct}"].flow_after) < 1e-9
            assert told[f"{c}{pct}"].affected_count == len(lost.get(f"{c}{pct}", [])) and told["a100"].affected_count > 0


def test_stateful_stories_of_few_titles_are_settled_by_title(monkeypatch):
    import random

    import pandas as pd

    from straitline.functions.similarity import WINDOW_MICROS
    from straitline.streaming import stateful

    rng = random.Random(3)
    titles = ["", "oil tanker seized", "oil tanker seized again", "port closed", "port closed at night", "far away"]
    at = sorted(rng.randrange(5 * WINDOW_MICROS) for _ in range(5000))
    rows = pd.DataFrame({"at": at, "event_id": rng.sample(range(10 ** 6), 5000), "norm": [rng.choice(titles) for _ in at]})
    rows = rows.sort_values(["at", "event_id"], ignore_index=True)
    monkeypatch.setattr(stateful, "TITLES", 0, raising=False)
    want, founders = [], []
    for start in (0, 1700, 3400):
        part, founders = stateful.settle_against(founders, rows.iloc[start : start + 1700 if start < 3400 else None])
        want.append((part, founders))
    monkeypatch.undo()
    monkeypatch.setattr(stateful, "resolve_batch", None)  # slice by slice
    founders = []
    for start, told in zip((0, 1700, 3400), want):
        got = stateful.settle_against(founders, rows.iloc[start : start + 1700 if start < 3400 else None])
        founders = got[1]
        assert got == told and len(founders) > 0
