"""Flow, centrality, criticality and response against brute force and known schedules."""

import random
from collections import deque
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from straitline.operators import criticality as C
from straitline.operators import flow as flows
from straitline.operators import network as N
from straitline.operators import response as R
from straitline.operators.centrality import betweenness
from straitline.operators.flow import flow_by_scenario, flow_value, sink_inflow

EDGES = "network_id string, layer int, src string, dst string, corridor string, volume double, effective_capacity double"


def random_network(seed, network_id):
    rng = random.Random(seed)
    S, Cn, P, Rf = ([f"{k}{i}" for i in range(rng.randint(2, n))] for k, n in (("s", 4), ("c", 3), ("p", 4), ("r", 5)))
    rows, v = [], lambda: float(rng.randint(1, 9))
    for s in S:
        rows.append((network_id, 0, "SOURCE", s, None, v()))
        rows += [(network_id, 1, s, c, None, v()) for c in rng.sample(Cn, rng.randint(1, len(Cn)))]
    for c in Cn:
        rows += [(network_id, 2, c, p, c, v()) for p in rng.sample(P, rng.randint(1, len(P)))]
    for r in Rf:
        rows += [(network_id, 3, p, r, None, v()) for p in rng.sample(P, rng.randint(1, min(2, len(P))))]
        rows.append((network_id, 4, r, "SINK", None, v()))
    return [row + (row[-1] * (rng.choice([0.5, 1.0]) if row[1] == 2 else 1.0),) for row in rows]


def max_flow(rows, capacity=6, scale=lambda row: 1.0):
    cap = {}
    for row in rows:
        a, b = (row[1], row[2]), (row[1] + 1, row[3])
        cap.setdefault(a, {}).setdefault(b, 0.0)
        cap[a][b] += row[capacity] * scale(row)
        cap.setdefault(b, {}).setdefault(a, 0.0)
    total = 0.0
    while True:
        parent, queue = {(0, "SOURCE"): None}, deque([(0, "SOURCE")])
        while queue:
            u = queue.popleft()
            for w, c in cap[u].items():
                if c > 1e-12 and w not in parent:
                    parent[w] = u
                    queue.append(w)
        end = (5, "SINK")
        if end not in parent:
            return total
        path, w = [], end
        while parent[w] is not None:
            path.append((parent[w], w))
            w = parent[w]
        push = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= push
            cap[b][a] += push
        total += push


@pytest.fixture(scope="module")
def nets(spark):
    networks = {f"n{i}": random_network(i, f"n{i}") for i in range(25)}
    df = spark.createDataFrame([r for rows in networks.values() for r in rows], EDGES).cache()
    return networks, df


def test_flow_equals_augmenting_paths(nets):
    networks, df = nets
    for column, index in (("volume", 5), ("effective_capacity", 6)):
        got = {r.network_id: r.flow for r in flow_value(df, column).collect()}
        assert got == pytest.approx({n: max_flow(rows, index) for n, rows in networks.items()})


def test_scenarios_equal_degraded_copies(spark, nets):
    networks, df = nets
    shocks = spark.createDataFrame(
        [("half c0", "c0", 50.0, None), ("no c1", "c1", 100.0, None), ("supply", None, None, 4.0)],
        "scenario_id string, corridor string, degradation_pct double, supply_reduction double")
    got = {(r.network_id, r.scenario_id): r.flow for r in flow_by_scenario(df, shocks).collect()}
    for name, rows in networks.items():
        total = sum(r[6] for r in rows if r[1] == 0)
        assert got[name, "half c0"] == pytest.approx(max_flow(rows, scale=lambda r: 0.5 if r[4] == "c0" else 1.0))
        assert got[name, "no c1"] == pytest.approx(max_flow(rows, scale=lambda r: 0.0 if r[4] == "c1" else 1.0))
        assert got[name, "supply"] == pytest.approx(max_flow(rows, scale=lambda r: max(0, 1 - 4 / total) if r[1] == 0 else 1.0))
    copies = N.degrade_corridor(df, shocks.filter("corridor = 'c0'")).drop("scenario_id")
    direct = {r.network_id: r.flow for r in flow_value(copies).collect()}
    assert direct == pytest.approx({n: got[n, "half c0"] for n in networks})


@pytest.mark.parametrize("blocks", [64, 2, 1])
def test_sink_inflow_is_the_prefix_split(nets, monkeypatch, blocks):
    monkeypatch.setattr(flows, "CUT_BLOCKS", blocks)
    networks, df = nets
    got = {}
    for r in sink_inflow(df).collect():
        got.setdefault(r.network_id, {})[r.refinery] = r.inflow
    for name, rows in networks.items():
        before = 0.0
        refineries = sorted({r[2] for r in rows if r[1] == 4})
        for i in range(len(refineries)):
            kept = set(refineries[: i + 1])
            flow = max_flow([r for r in rows if r[1] != 4 or r[2] in kept])
            assert got[name][refineries[i]] == pytest.approx(flow - before, abs=1e-9)
            before = flow


def test_few_sides_are_tried_per_refinery(spark):
    rng, rows = random.Random(5), []
    corridors = [f"c{i}" for i in range(6)]
    for i, c in enumerate(corridors):
        rows += [("n", 0, "SOURCE", f"s{i}", None, 40.0 + i), ("n", 1, f"s{i}", c, None, 40.0 + i)]
        rows += [("n", 2, c, f"p{k}", c, float(rng.randint(1, 15))) for k in range(4)]
    for r in range(150):
        rows += [("n", 3, f"p{k}", f"r{r:03}", None, float(rng.randint(1, 5))) for k in rng.sample(range(4), 1 + r % 2)]
        rows.append(("n", 4, f"r{r:03}", "SINK", None, float(rng.randint(1, 6))))
    rows = [r + (r[-1],) for r in rows]
    df = spark.createDataFrame(rows, EDGES)
    bits, parts = flows.corridor_bits(df).cache(), flows.port_components(df)
    factors = flows.scenario_factors(df, None, bits, "volume").cache()
    terms = flows._refinery_terms(df, parts, "volume").join(flows._name_blocks(df, True), ["network_id", "refinery"])
    suppliers = flows._over_subsets(flows.supplier_terms(df, bits, factors, "volume"), bits).groupBy(*flows.SCENARIO, "x").agg(
        F.sum("value").alias("suppliers"))
    cuts = flows._block_cuts(terms, flows._port_inflow(df, bits, factors, parts, "volume"), suppliers, bits)
    tried = flows.candidate_sides(cuts, bits).join(flows._name_blocks(df, True), ["network_id", "block"]).count()
    assert 150 <= tried <= 150 * (len(corridors) + 1)
    got = {r.refinery: r.inflow for r in sink_inflow(df).collect()}
    for upto in (1, 20, 75, 149, 150):
        want = max_flow([r for r in rows if r[1] != 4 or r[2] < f"r{upto:03}"])
        assert sum(v for r, v in got.items() if r < f"r{upto:03}") == pytest.approx(want)


def brute_betweenness(rows, length):
    out, nodes, dist = {}, set(), {}
    for r in rows:
        a, b = (r[1], r[2]), (r[1] + 1, r[3])
        nodes |= {a, b}
        out.setdefault(a, []).append((b, length(r)))
    paths = {}
    def walk(start, node, path, d):
        paths.setdefault((start, node), []).append((d, path))
        for nxt, step in out.get(node, []):
            walk(start, nxt, path + [nxt], d + step)
    for node in nodes:
        walk(node, node, [node], 0.0)
    score = dict.fromkeys(nodes, 0.0)
    for (s, t), found in paths.items():
        best = min(d for d, _ in found)
        short = [p for d, p in found if d <= best + 1e-9]
        for p in short:
            for v in p[1:-1]:
                score[v] += 1 / len(short)
    n = len(nodes)
    return {v: b / ((n - 1) * (n - 2)) for v, b in score.items()}


def test_betweenness_equals_all_paths(nets):
    networks, df = nets
    for weight, length in ((None, lambda r: 1.0), ("effective_capacity", lambda r: 1.0 / max(r[6], 1e-9))):
        got = {}
        for r in betweenness(df, weight).collect():
            got.setdefault(r.network_id, {})[(r.layer, r.node)] = r.centrality
        for name, rows in networks.items():
            assert got[name] == pytest.approx(brute_betweenness(rows, length))


def test_betweenness_tables_follow_kinds_of_refineries(spark, monkeypatch):
    """Refineries of equal ways, and those off the shortest ways of their only port, are one node of the path tables."""
    from straitline.operators import centrality

    def rows(refineries):
        found = [(0, "SOURCE", "s", 9.0), (1, "s", "c", 9.0), (2, "c", "p0", 4.0), (2, "c", "p1", 5.0)]
        for i in range(refineries):
            found += [(3, f"p{i % 2}", f"r{i}", 1.0 + i % 7), (4, f"r{i}", "SINK", 2.0 + i % 5)]
        found += [(3, "p0", "both", 7.0), (3, "p1", "both", 7.0), (4, "both", "SINK", 6.0)]
        return [("n", a, b, c, b if a == 2 else None, v, v) for a, b, c, v in found]

    made = []
    keep = centrality.checkpointed
    for refineries in (70, 280):
        edges = spark.createDataFrame(rows(refineries), EDGES)
        for weight, length in ((None, lambda r: 1.0), ("effective_capacity", lambda r: 1.0 / r[6])):
            sizes = []
            monkeypatch.setattr(centrality, "checkpointed", lambda df: [x := keep(df), sizes.append(x.count())][0])
            got = {(r.layer, r.node): r.centrality for r in centrality.betweenness(edges, weight).collect()}
            assert got == pytest.approx(brute_betweenness(rows(refineries), length))
            made.append(sizes[1:])  # the first is the network itself
    assert made[:2] == made[2:]


def test_networks_of_odd_parts(spark, tmp_path):
    """Lines of unknown parts belong to no network, those of repeated parts count for each; suppliers do not move by part."""
    import catalog.base as base

    tables = {
        "region": [(0, "ASIA")], "nation": [(0, 0)], "supplier": [(1, 0), (2, 0)], "part": [(1, "A", 3), (2, "B", 4), (2, "B", 9)],
        "lineitem": [("N", 1, 1, 5.0), ("N", 1, 2, 7.0), ("N", 2, 3, 11.0), ("N", 2, None, 1.0), ("N", 9, 1, 1.0), ("R", 2, 1, 2.0)]}
    columns = {
        "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_regionkey int", "supplier": "s_suppkey long, s_nationkey int",
        "part": "p_partkey long, p_brand string, p_size int", "lineitem": "l_returnflag string, l_suppkey long, l_partkey long, l_quantity double"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, columns[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    parts = {k: sorted(map(tuple, df.collect())) for k, df in base.network_parts(spark, str(tmp_path)).items()}
    assert parts["suppliers"] == [("N", "S1", "ASIA", 19.0), ("R", "S2", "ASIA", 2.0)]
    assert parts["ports"] == [("N", "ASIA", "A", 5.0), ("N", "ASIA", "B", 14.0), ("R", "ASIA", "A", 2.0)]
    assert parts["feeds"] == [("N", "A", "P1", 4.5), ("N", "B", "P2", 14 * 0.9), ("R", "A", "P1", 1.8)]
    assert parts["refineries"] == [("N", "P1", 320.0), ("N", "P2", 560.0), ("R", "P1", 320.0)]


def test_criticality_ranks_and_losses(spark, nets):
    networks, df = nets
    risk = spark.createDataFrame([("c0", 0.4), ("c1", 0.9)], "corridor string, risk double")
    for r in C.corridor_criticality(df, risk).collect():
        rows = networks[r.network_id]
        cut = max_flow(rows, scale=lambda e: 0.0 if e[4] == r.corridor else 1.0)
        assert r.capacity_loss == pytest.approx(max_flow(rows) - cut, abs=1e-9)
        assert r.rank_shift == r.static_rank - r.risk_rank


def test_grade_compatibility_rules(spark):
    crude = spark.createDataFrame([("n", "s", "c", 1.0, 30.5, 1.0), ("n", "s", "d", 1.0, None, None)],
                                  "network_id string, supplier string, corridor string, volume double, api_gravity double, sulfur_pct double")
    ports = spark.createDataFrame([("n", "c", "p", 1.0), ("n", "d", "q", 1.0)], "network_id string, corridor string, port string, volume double")
    feeds = spark.createDataFrame([("n", "p", "fits"), ("n", "p", "sour"), ("n", "q", "fits"), ("n", "x", "fits")], "network_id string, port string, refinery string")
    fleet = spark.createDataFrame([("n", "fits", 30.0, 31.0, 1.0), ("n", "sour", 30.0, 31.0, 0.9)],
                                  "network_id string, refinery string, api_gravity_min double, api_gravity_max double, sulfur_tolerance double")
    got = {(r.port, r.refinery): r.grade_compatible for r in N.grade_compatible(crude, ports, feeds, fleet).collect()}
    assert got == {("p", "fits"): True, ("p", "sour"): False, ("q", "fits"): False, ("x", "fits"): True}


def test_bad_scenarios_fail(spark, nets):
    _, df = nets
    bad = "scenario_id string, network_id string, corridor string, degradation_pct double, supply_reduction double"
    for row in (("a", "n0", "nowhere", 10.0, None), ("a", "n0", "c0", 110.0, None)):
        with pytest.raises(Exception, match="unknown corridor|must be in"):
            C.scenario_impact(df, spark.createDataFrame([row], bad), refineries=False)[0].collect()


def drawdown(spark, profiles, **kw):
    rows = [(name, day, gap) for name, gaps in profiles.items() for day, gap in enumerate(gaps)]
    df = spark.createDataFrame(rows, "disruption_id string, day int, gap double")
    schedule = R.reserve_drawdown(df, **kw)
    release = {}
    for r in schedule.orderBy("day").collect():
        release.setdefault(r.disruption_id, []).append(r.release)
    summary = {r.disruption_id: r for r in R.reserve_summary(schedule, **kw).collect()}
    return release, summary


def test_drawdown_schedules(spark):
    release, summary = drawdown(spark, {"step": [2.0] * 5 + [0.5] * 20, "none": [0.0] * 4}, total=8.0, floor=0.0)
    assert release["step"] == pytest.approx([1.0] * 5 + [0.5] * 6 + [0.0] * 14)
    assert summary["step"].reserve_exhausted_day == 10
    assert release["none"] == [0.0] * 4 and not summary["none"].insufficient
    release, summary = drawdown(spark, {
        "down": [0.9, 0.9, 0.6, 0.6, 0.2, 0.0], "residual": [2.0] * 5 + [0.7] * 25, "capped": [2.0] * 10 + [0.0] * 4, "long": [0.9] * 60})
    assert release["down"] == pytest.approx([0.9, 0.9, 0.6, 0.6, 0.2, 0.0])
    assert release["residual"][5:] == pytest.approx([0.7] * 25)
    assert summary["residual"].reserve_exhausted_day is None
    assert release["capped"] == pytest.approx([1.0] * 10 + [0.0] * 4)
    assert summary["capped"].gap_covered_pct == pytest.approx(50.0)
    # Too little for a long even gap: every day gets the same share.
    assert release["long"] == pytest.approx([36.87 * 0.8 / 60] * 60)
    assert summary["long"].total_released == pytest.approx(36.87 * 0.8)


def test_drawdown_is_never_beaten_on_a_grid(spark):
    """No schedule on a coarse grid serves more, or equally much with a lower peak."""
    rng = random.Random(4)
    profiles = {f"g{i}": [rng.choice([0.0, 0.5, 1.0, 1.5]) for _ in range(4)] for i in range(12)}
    release, _ = drawdown(spark, profiles, total=2.0, floor=0.0)
    for name, gaps in profiles.items():
        got = release[name]
        assert sum(got) <= 2.0 + 1e-9 and all(0 <= r <= min(1.0, g) + 1e-9 for r, g in zip(got, gaps))
        mine = (sum(gaps) - sum(got), max(g - r for g, r in zip(gaps, got)))
        for other in product(*[[x for x in (0.0, 0.25, 0.5, 0.75, 1.0) if x <= min(1.0, g)] for g in gaps]):
            if sum(other) <= 2.0:
                theirs = (sum(gaps) - sum(other), max(g - r for g, r in zip(gaps, other)))
                assert mine[0] <= theirs[0] + 1e-9
                assert mine[0] < theirs[0] - 1e-9 or mine[1] <= theirs[1] + 1e-9


def test_alternatives_and_timeline(spark):
    alts = spark.createDataFrame(
        [("near", 5, 1.0, 32.0, 1.0, False, [], 0.4), ("far", 20, 1.0, 32.0, 1.0, False, ["Cape"], 0.5),
         ("banned", 1, 0.0, 32.0, 1.0, True, [], 9.0), ("through", 2, 0.5, 32.0, 1.0, False, ["Hormuz"], 1.0)],
        "name string, transit_days int, price_premium_usd double, api_gravity double, sulfur_pct double, sanctioned boolean, transits_corridors array<string>, max_incremental_mbd double")
    fleet = spark.createDataFrame([(1.0, 30.0, 35.0, 2.0), (3.0, 40.0, 45.0, 2.0)],
                                  "capacity_mbd double, api_gravity_min double, api_gravity_max double, sulfur_tolerance double")
    asked = spark.createDataFrame(
        [("h", "Hormuz", "normal", 0.8, 25, False), ("zero", "Hormuz", "severe", 0.0, 3, False), ("supply", None, "normal", 1.0, 3, True)],
        "disruption_id string, corridor string, crisis string, gap double, duration_days int, include_sanctioned boolean")
    ranked = R.rank_alternatives(asked, alts, fleet)
    rows = {(r.disruption_id, r.name): r for r in ranked.collect()}
    assert {n for d, n in rows if d == "h"} == {"near", "far"}
    assert {n for d, n in rows if d == "supply"} == {"near", "far", "banned", "through"}
    near = rows["h", "near"]
    assert near.cost_score == 1.0 and near.compat_score == pytest.approx(0.25)  # a tied criterion counts fully
    assert near.score == pytest.approx(0.40 + 0.35 + 0.25 * 0.25) and near.place == 1
    line = {r.disruption_id: r for r in R.replacement_timeline(asked, ranked).collect()}
    assert (line["h"].transit_days, line["h"].covers_gap, line["h"].alternatives_used) == (20, True, 2)
    assert (line["zero"].transit_days, line["zero"].alternatives_used, line["zero"].covers_gap) == (None, 0, True)
    gaps = {r.day: r.gap for r in R.daily_gap(asked, ranked).filter("disruption_id = 'h'").collect()}
    assert gaps[4] == 0.8 and gaps[5] == pytest.approx(0.4) and gaps[20] == 0.0


def test_prefixes_looked_up_equal_lists_read_through(spark):
    rng = random.Random(3)
    alts = spark.createDataFrame(
        [(f"a{i:03d}", rng.choice([-1, 0, 2, 5, 9, 14, 30]), rng.choice([1.0, 2.0, 2.5]), 32.0, 1.0, i % 5 == 0, rng.sample(["H", "C"], i % 2), rng.choice([0.0, 0.25, 0.5, 1.0]))
         for i in range(120)],
        "name string, transit_days int, price_premium_usd double, api_gravity double, sulfur_pct double, sanctioned boolean, transits_corridors array<string>, max_incremental_mbd double")
    fleet = spark.createDataFrame([(1.0, 30.0, 35.0, 2.0)], "capacity_mbd double, api_gravity_min double, api_gravity_max double, sulfur_tolerance double")
    # One case is asked by a third of all and more; gaps of nothing, on the edge of an alternative, and beyond all of them.
    asked = spark.createDataFrame(
        [(f"d{i}", rng.choice(["H", "H", "C", None]), rng.choice(["normal", "severe"]), rng.choice([0.0, 0.25, 0.5, 3.0, 7.75, 500.0]), rng.choice([1, 12, 40]), rng.choice([True, False, None]))
         for i in range(150)],
        "disruption_id string, corridor string, crisis string, gap double, duration_days int, include_sanctioned boolean")
    ranked = R.rank_alternatives(asked, alts, fleet)
    cases = R.rank_cases(asked, alts, fleet)
    got = R.procured(asked, cases)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.prefix_timeline(got).fillna(-9)) == rows(R.replacement_timeline(asked, ranked).fillna(-9))
    assert rows(R.prefix_daily_gap(got, cases)) == rows(R.daily_gap(asked, ranked))
    # No join of disruptions and alternatives: each side is read as it is, and the lookups keep the number of disruptions.
    assert got.count() == 150
    none = alts.filter("false")
    assert {r.alternatives_used for r in R.prefix_timeline(R.procured(asked, R.rank_cases(asked, none, fleet))).collect()} == {0}
    assert R.prefix_timeline(R.procured(asked.filter("false"), cases)).count() == 0


def test_trigger_order_and_strictness(spark):
    rows = spark.createDataFrame([("n", "a", 0.15, 0.75), ("n", "b", 0.5, 0.1), ("n", "c", 0.01, 0.9), ("z", "a", 0.0, 0.1)],
                                 "network_id string, corridor string, capacity_loss double, live_risk_score double")
    base = spark.createDataFrame([("n", 1.0), ("z", 0.0)], "network_id string, flow double")
    out = {r.network_id: r for r in C.triggered(C.check_threshold(rows, base)).collect()}
    assert out["n"].triggered == ["b", "c"] and out["n"].triggered_corridor == "b"  # bars are strict
    assert not out["z"].threshold_crossed and out["z"].reason == "no corridor crossed either clause"


def test_open_gravity_windows_have_no_bands_beyond_the_crudes(spark):
    """Windows of a million million degrees, none at all, and inverted ones."""
    windows = [("r0", -1e12, 1e12, 2.0, 3.0), ("r1", 31.5, 1e12, 2.0, 1.0), ("r2", -1e12, 10.0, 9.0, 4.0), ("r3", 40.0, 20.0, 9.0, 2.0), ("r4", None, 50.0, 9.0, 1.0)]
    refineries = spark.createDataFrame([("n", *w) for w in windows],
                                       "network_id string, refinery string, api_gravity_min double, api_gravity_max double, sulfur_tolerance double, capacity_mbd double")
    grades = [(30.5, 1.0), (31.4, 3.0), (31.5, 2.0), (None, 1.0)]
    total = sum(w[4] for w in windows)
    fit = lambda g, w: g[0] is not None and w[1] is not None and w[1] <= g[0] <= w[2] and g[1] <= w[3]
    got = R.fleet_compatibility(spark.createDataFrame(grades, "api_gravity double, sulfur_pct double"), refineries).collect()
    assert {(r.api_gravity, r.sulfur_pct): r.compat for r in got if r.api_gravity} == pytest.approx(
        {g: sum(w[4] for w in windows if fit(g, w)) / total for g in grades if g[0]})
    crude = spark.createDataFrame([("n", "c", *g) for g in grades], "network_id string, corridor string, api_gravity double, sulfur_pct double")
    ports = spark.createDataFrame([("n", "c", "p")], "network_id string, corridor string, port string")
    feeds = spark.createDataFrame([("n", "p", w[0]) for w in windows] + [("n", "dry", "r3")], "network_id string, port string, refinery string")
    out = {(r.port, r.refinery): r.grade_compatible for r in N.grade_compatible(crude, ports, feeds, refineries).collect()}
    assert out == {**{("p", w[0]): any(fit(g, w) for g in grades) for w in windows}, ("dry", "r3"): True}


def test_equal_losses_rank_by_name_whatever_the_order_of_their_sums(spark):
    rows = [("n", 0, "SOURCE", "s", None, 9.0), ("n", 1, "s", "a", None, 9.0), ("n", 1, "s", "b", None, 9.0), ("n", 1, "s", "c", None, 9.0),
            ("n", 2, "a", "p", "a", 0.3), ("n", 2, "b", "p", "b", 0.1), ("n", 2, "b", "q", "b", 0.2), ("n", 2, "c", "o", "c", 0.7),
            ("n", 3, "p", "r", None, 9.0), ("n", 3, "q", "t", None, 9.0), ("n", 4, "r", "SINK", None, 9.0), ("n", 4, "t", "SINK", None, 9.0)]
    edges = spark.createDataFrame([(*r, r[5]) for r in rows], EDGES)
    risk = edges.filter("layer = 2").select("corridor", F.lit(0.0).alias("risk")).distinct()
    found = {r.corridor: (r.capacity_loss, r.risk_rank) for r in C.corridor_criticality(edges, risk).collect()}
    assert found["a"][0] == found["b"][0] == pytest.approx(0.3) and found["c"][0] == 0.0
    assert [found[c][1] for c in "abc"] == [1, 2, 3]


def test_losses_of_nothing_are_nothing(spark):
    rows = spark.createDataFrame([(10432.66, -3.6e-12), (10432.66, 3.6e-12), (0.0, 0.0), (1e6, 901.0)], "base double, loss double")
    assert [r[0] for r in rows.select(C.told_loss(F.col("base"), F.col("loss"))).collect()] == [0.0, 0.0, 0.0, 901.0]


def test_cascade_counts_the_refineries_it_affects(spark, monkeypatch):
    from catalog import network_queries

    rows = [("n", 0, "SOURCE", "s", None, 10.0), ("n", 1, "s", "c", None, 10.0), ("n", 2, "c", "p", "c", 10.0)]
    for r in ("r1", "r2"):
        rows += [("n", 3, "p", r, None, 5.0), ("n", 4, r, "SINK", None, 5.0)]
    df = spark.createDataFrame([r + (r[-1],) for r in rows], EDGES)
    monkeypatch.setattr(network_queries, "risky_network", lambda spark, sf: df)
    got = {r.scenario_id: (r.flow_after, r.affected_count, r.refinery_shortfall) for r in network_queries.cascade_curve(spark, "").collect()}
    assert len(got) == 10  # r1 comes first in name order, so r2 loses until nothing is left for it
    assert got["c@10"] == (9.0, 1, 1.0) and got["c@50"] == (5.0, 1, 5.0) and got["c@60"] == (4.0, 2, 6.0) and got["c@100"] == (0.0, 2, 10.0)


def test_block_inflows_do_not_depend_on_how_many_refineries_are_made_at_a_time(monkeypatch):
    rng, terms, cuts = random.Random(7), [], []
    for i in range(40):
        terms += [("n", 0, f"p{i % 3}", f"r{i:02}", o, rng.uniform(0, 3) * o) for o in (1, 2, 3)[: 3 if i % 3 else 1]]
    for sid, x in (("a", 3), ("a", 1), ("b", 2), ("b", 0)):
        for p in range(3):
            cuts += [("n", 0, f"p{p}", sid, x, 5.0 + x, o, rng.uniform(0, 30), 2.0 * o) for o in (0, 1, 2, 3)[: 4 if p else 2]]
    terms, cuts = (pa.table(dict(zip(names, map(list, zip(*rows))))) for names, rows in (
        (("network_id", "block", "component", "refinery", "open_ports", "value"), terms),
        (("network_id", "block", "component", "scenario_id", "x", "start", "open_ports", "inflow", "base"), cuts)))
    whole = flows._block_inflows(terms, cuts).to_pylist()
    monkeypatch.setattr(flows, "ROWS", 7)
    assert len(whole) == 40 and flows._block_inflows(terms.take(pa.array(rng.sample(range(len(terms)), len(terms)))), cuts).to_pylist() == whole
