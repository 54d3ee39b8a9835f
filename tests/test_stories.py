"""Stories against a plain greedy loop, batch and streaming, and point-in-time series against single days."""

import random
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from math import exp

import pytest
from pyspark.sql import functions as F

from straitline.operators import stories as ST
from straitline.operators import title_groups
from straitline.operators.point_in_time import score_series
from straitline.streaming import stateful
from straitline.streaming.slices import stream_stories

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, corridor string, severity int, confidence double, ts timestamp, title string"
WORDS = "tanker hormuz strait oil navy attack closed port crude ship crew seized iran missile drone talks".split()


def corpus(seed, corridor="c", days=10, first_id=0):
    rng, rows = random.Random(seed), []
    for i in range(rng.randint(5, 90)):
        if rows and rng.random() < 0.3:
            title = rng.choice(rows)[5]
        elif rows and rng.random() < 0.3:
            words = (rng.choice(rows)[5] or "x").split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            title = " ".join(words)
        else:
            title = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9)))
        title = "" if rng.random() < 0.05 else title
        ts = START + timedelta(seconds=rng.randrange(days * 86400) // 3600 * 3600)
        rows.append((first_id + i, corridor, rng.randint(1, 5), rng.randint(1, 10) / 10, ts, title))
    return rows


def norm(title):
    return " ".join(re.sub("[^a-z0-9 ]+", " ", (title or "").lower()).split())


def greedy(rows):
    leaders, story = [], {}
    for event_id, _, _, _, ts, title in sorted(rows, key=lambda r: (r[4], r[0])):
        text = norm(title)
        for leader_id, at, other in leaders:
            if text and other and abs((ts - at).total_seconds()) <= 3 * 86400 and (
                    text == other or SequenceMatcher(None, text, other).ratio() >= 0.6):
                story[event_id] = leader_id
                break
        else:
            leaders.append((event_id, ts, text))
            story[event_id] = event_id
    return story


@pytest.mark.parametrize("batch", [7, 1000])
def test_stories_equal_the_greedy_loop(spark, batch):
    corpora = {f"c{s}": corpus(s, f"c{s}") for s in range(40 if batch == 1000 else 12)}
    df = spark.createDataFrame([r for rows in corpora.values() for r in rows], SCHEMA)
    got = {(r.corridor, r.event_id): r.story_id for r in ST.cluster_stories(df, batch=batch).collect()}
    want = {(c, e): s for c, rows in corpora.items() for e, s in greedy(rows).items()}
    assert got == want


def test_many_copies_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(ST, "CHUNK", 5)
    rows = corpus(1) + [(1000 + i, "c", 2, 0.5, START + timedelta(minutes=20 * i), "same old headline about oil") for i in range(400)]
    got = {r.event_id: r.story_id for r in ST.cluster_stories(spark.createDataFrame(rows, SCHEMA), batch=20).collect()}
    assert got == greedy(rows)


@pytest.mark.parametrize("links", [0, 10 ** 6])
def test_components_hold_every_chain_of_similar_titles(spark, monkeypatch, links):
    monkeypatch.setattr(title_groups, "TILE", 9)
    monkeypatch.setattr(title_groups, "LINKS", links)
    rows = corpus(21, days=20) + corpus(22, "d", days=3, first_id=300)
    df = ST._titled(spark.createDataFrame(rows, SCHEMA), ("corridor",)).filter("norm <> ''")
    part = {r.event_id: (r.story_key, r.part) for r in title_groups.split_keys(df).collect()}
    assert len(part) == sum(bool(norm(r[5])) for r in rows)
    story = {**greedy([r for r in rows if r[1] == "c"]), **greedy([r for r in rows if r[1] == "d"])}
    assert all(part[e] == part[s] for e, s in story.items() if e in part) and len(set(part.values())) > 2
    # Against components by brute force of what may meet: neighbouring windows, either order of the ratio.
    root = {e: e for e in part}

    def find(e):
        return e if root[e] == e else find(root[e])

    told = [(r[0], r[1], int(r[4].timestamp() // (3 * 86400)), norm(r[5])) for r in rows if norm(r[5])]
    for x in told:
        for y in told:
            same = x[3] == y[3] or abs(x[2] - y[2]) <= 1 and SequenceMatcher(None, x[3], y[3]).ratio() >= 0.6
            if x[1] == y[1] and same:
                root[find(x[0])] = find(y[0])
    groups = {}
    for e in part:
        groups.setdefault(find(e), set()).add(part[e])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(part.values()))


def test_few_titles_of_many_events_need_no_rounds(spark, monkeypatch):
    """A family of few titles is settled by its titles, however many events it has and however often its stories begin anew."""
    rows = [(i, "c", 1, 0.5, START + timedelta(minutes=11 * i), "tanker " + "a" * (i * 7 % 23) + "b" * (i % 5)) for i in range(3000)]
    rounds = []
    settle = ST._settled_in_rounds
    monkeypatch.setattr(ST, "_settled_in_rounds", lambda p, b: rounds.append(settle(p, b)) or rounds[-1])
    got = {r.event_id: r.story_id for r in ST.cluster_stories(spark.createDataFrame(rows, SCHEMA), batch=100).collect()}
    assert got == greedy(rows)
    assert max(len(parts) for parts in rounds) <= 1


@pytest.mark.parametrize("pairs", [ST.PAIRS, 0])
def test_many_titles_are_settled_by_their_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(ST, "TITLES", 0)
    monkeypatch.setattr(ST, "PAIRS", pairs)
    monkeypatch.setattr(title_groups, "TILE", 9)
    met, match = [], ST._chunked_match
    monkeypatch.setattr(ST, "_chunked_match", lambda *frames: met.append(1) or match(*frames))
    lists = [corpus(seed, f"c{seed}", first_id=1000 * seed) for seed in range(2, 8)]
    df = spark.createDataFrame([r for rows in lists for r in rows], SCHEMA)
    got = {r.event_id: r.story_id for r in ST.assign_stories(df, batch=7).collect()}
    assert got == {k: v for rows in lists for k, v in greedy(rows).items()}
    assert bool(met) == (not pairs)  # rounds are only for components of too many pairs


def test_rounds_of_many_distinct_titles(spark, monkeypatch):
    rng, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "c", 1, 0.5, START + timedelta(seconds=12 * i), " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(4)))
            for i in range(6000)]
    rows += [(10_000 + i, "c", 1, 0.5, START + timedelta(seconds=30 * i), f"tanker leaves port number {i} for sea") for i in range(900)]
    rounds = []
    settle = ST._settled_in_rounds
    monkeypatch.setattr(ST, "_settled_in_rounds", lambda p, b: rounds.append(settle(p, b)) or rounds[-1])
    got = {r.event_id: r.story_id for r in ST.cluster_stories(spark.createDataFrame(rows, SCHEMA), batch=500).collect()}
    assert max(len(parts) for parts in rounds) <= 6  # 14 batches of 500 without components
    assert {got[10_000 + i] for i in range(900)} == {10_000} and sum(got[i] == i for i in range(6000)) > 5900


def test_long_titles_and_window_edge(spark):
    long = " ".join(["corridor"] * 60)
    rows = [(0, "c", 1, 1.0, START, long), (1, "c", 1, 1.0, START + timedelta(days=3), long),
            (2, "c", 1, 1.0, START + timedelta(days=3, seconds=1), long)]
    got = {r.event_id: r.story_id for r in ST.cluster_stories(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_similar_titles_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ST, "TILE", 6)
    rows = corpus(3)
    got = {r.event_id: r.similar_id for r in ST.similar_titles(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    ordered = sorted((r for r in rows if norm(r[5])), key=lambda r: (r[4], r[0]))
    for i, r in enumerate(ordered):
        for other in ordered[:i]:
            a, b = norm(r[5]), norm(other[5])
            if (r[4] - other[4]).total_seconds() <= 3 * 86400 and (a == b or SequenceMatcher(None, a, b).ratio() >= 0.6):
                want[r[0]] = other[0]
                break
    assert got == want


def test_strongest_member_prefers_the_earliest_on_ties(spark):
    rows = [(0, "c", 3, 0.5, START, "b one"), (1, "c", 3, 0.5, START, "a two"), (2, "c", 1, 0.5, START, "c")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("story_id", F.lit(0).cast("long"))
    best = ST.strongest_members(df, F.lit("2024-01-02").cast("timestamp")).first()
    assert (best.title, best.members) == ("b one", 3)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(corpus(5, days=12) + corpus(6, "d", days=12, first_id=500), key=lambda r: (r[4], r[0]))
    parts = [rows[i : i + 25] for i in range(0, len(rows), 25)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i:03d}"))
        query = stream_stories(
            spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")),
            str(tmp_path / "store"), str(tmp_path / "cp"))
        query.awaitTermination()
        assert query.exception() is None
    got = {r.event_id: r.story_id for r in spark.read.parquet(str(tmp_path / "store" / "members")).collect()}
    assert got == {**greedy([r for r in rows if r[1] == "c"]), **greedy([r for r in rows if r[1] == "d"])}


def test_series_equals_scoring_each_day_alone(spark):
    rng = random.Random(9)
    rows = corpus(11, days=6) + [
        (500 + i, "c", rng.randint(1, 5), rng.randint(1, 10) / 10, START - timedelta(days=178) + timedelta(hours=13 * i), " ".join(rng.sample(WORDS, 4)))
        for i in range(12)]
    windows = spark.createDataFrame([("w", "c", START.date(), (START + timedelta(days=8)).date())], "event string, corridor string, chart_start date, end date")
    corridors = spark.createDataFrame([("c", 0.2), ("quiet", 0.05)], "name string, baseline_risk double")
    series, tops = score_series(spark.createDataFrame(rows, SCHEMA), corridors, windows)
    got = {(r.corridor, r.day): r for r in series.collect()}
    best = {}
    for r in tops.collect():
        best.setdefault(r.day, []).append((r.place, r.weight, r.members))
    for d in range(9):
        day = (START + timedelta(days=d)).date()
        as_of = START + timedelta(days=d, hours=16, minutes=30)
        seen = [r for r in rows if as_of - timedelta(days=180) <= r[4] <= as_of]
        story, weights, members = greedy(seen), {}, {}
        for r in seen:
            w = r[2] * r[3] * exp(-0.1 * (as_of - r[4]).total_seconds() / 86400)
            weights[story[r[0]]] = max(w, weights.get(story[r[0]], 0))
            members[story[r[0]]] = members.get(story[r[0]], 0) + 1
        raw = sum(sorted(weights.values(), reverse=True)[:3]) / 3
        row = got[("c", day)]
        assert (row.events, row.stories) == (len(seen), len(weights))
        assert row.raw == pytest.approx(raw, abs=1e-4)
        assert row.score == pytest.approx(0.2 + 0.8 * min(1, raw / 5) if raw else 0.2, abs=1e-4)
        want = sorted(weights, key=lambda s: -weights[s])[:3]
        assert [w for _, w, _ in sorted(best.get(day, []))] == pytest.approx([weights[s] for s in want], abs=1e-3)
        quiet = got[("quiet", day)]
        assert (quiet.score, quiet.events, quiet.raw) == (0.05, 0, 0.0)


def test_stateful_stream_equals_batch_and_forgets(spark, tmp_path):
    rows = sorted(corpus(5, days=12) + corpus(6, "d", days=12, first_id=500), key=lambda r: (r[4], r[0]))
    rows += [(2000, "e", 1, 1.0, START + timedelta(days=40), "much later"), (2001, "c", 1, 1.0, START, "far too late")]
    held = []
    for i in range(0, len(rows), 25):
        spark.createDataFrame(rows[i : i + 25], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i:03d}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = stateful.append_table(stateful.story_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        assert query.exception() is None
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # Another row makes the watermark of the last ones count: keys that went quiet are gone.
    spark.createDataFrame([(3000, "e", 1, 1.0, START + timedelta(days=80), "later still"), (3001, "c", 1, 1.0, START, "far too late")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "q"))
    query = stateful.append_table(stateful.story_stream(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = {r.event_id: (r.story_id, r.held) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {**greedy([r for r in rows if r[1] == "c" and r[0] != 2001]), **greedy([r for r in rows if r[1] == "d"]), 2000: 2000, 3000: 3000}
    assert {e: s for e, (s, _) in got.items() if e not in (2001,)} == {**want}
    founders = {r[0]: r[4] for r in rows if want.get(r[0]) == r[0]}
    most = max(sum(at <= b <= at + timedelta(days=3) for b in founders.values()) for at in founders.values())
    assert max(h for _, h in got.values()) <= most < len(founders) / 2


def test_closed_windows_and_late_slices(spark, tmp_path):
    schema = "path string, slice_ts timestamp, line_no int, line string, readable boolean"
    slice_ = lambda minutes, readable=True: (f"s{minutes}", START + timedelta(minutes=minutes), 0, "", readable)
    landed = [[slice_(0), slice_(0), slice_(15), slice_(30, False)], [slice_(60), slice_(300)], [slice_(45), slice_(600)], [slice_(1000)]]  # 45 comes 4 hours late
    for i, part in enumerate(landed):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stateful.append_table(stateful.slices_read(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {int((r.start - START).total_seconds() // 3600): r.slices_read for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 2, 1: 1, 5: 1, 10: 1}
