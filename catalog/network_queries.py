"""Queries over supply networks, what-if scenarios and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ALT, BASE_SCEN, CUT_SCEN, DIS, LISTS, NET, RANKED, RISKY, STATIC, alternatives, disruptions, fleet, flow_ctes, network,
    network_parts, query, r6, region_risk, risky_network, table,
)
from catalog.risk_queries import _CAND, STATS, _statistics
from catalog.base import risk_corridors
from straitline.operators import criticality as C
from straitline.operators import network as N
from straitline.operators import response as R
from straitline.operators import scoring as S
from straitline.operators.centrality import betweenness
from straitline.operators.flow import flow_by_scenario, flow_value, sink_inflow
from straitline.plans.response import response_plan
from straitline.session import checkpointed

# --- structure ------------------------------------------------------------------------


@query("network_edges", f"""WITH {NET} SELECT net AS network_id, 0 AS layer, 'SOURCE' AS src, s AS dst, CAST(NULL AS VARCHAR) AS corridor, round(sum(v), 6) AS volume FROM sc GROUP BY net, s
UNION ALL SELECT net, 1, s, c, NULL, round(v, 6) FROM sc UNION ALL SELECT net, 2, c, p, c, round(v, 6) FROM cp
UNION ALL SELECT net, 3, p, r, NULL, round(v, 6) FROM pr UNION ALL SELECT net, 4, r, 'SINK', NULL, round(cap, 6) FROM rt""")
def network_edges(spark, sf):
    return network(spark, sf).select("network_id", "layer", "src", "dst", "corridor", r6("volume").alias("volume"))


@query("supplier_totals", f"WITH {NET} SELECT net AS network_id, s AS supplier, round(sum(v), 6) AS volume FROM sc GROUP BY ALL")
def supplier_totals(spark, sf):
    return N.supplier_totals(network_parts(spark, sf)["suppliers"]).withColumn("volume", r6("volume"))


@query("network_name_problems", """WITH se AS (SELECT DISTINCT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pe AS (SELECT DISTINCT r_name, p_brand FROM region CROSS JOIN (SELECT DISTINCT p_brand FROM part) b), fe AS (SELECT DISTINCT p_brand, p_name FROM part),
ds AS (SELECT s_name FROM supplier WHERE s_acctbal >= 0), dc AS (SELECT r_name FROM region WHERE r_name <> 'ASIA'),
dp AS (SELECT DISTINCT p_brand FROM part WHERE p_retailprice > 998), dr AS (SELECT DISTINCT p_name FROM part WHERE p_size = 7)
SELECT DISTINCT 'supplier_to_corridor' AS edge_list, 'supplier' AS kind, s_name AS name FROM se WHERE s_name NOT IN (FROM ds)
UNION ALL SELECT DISTINCT 'supplier_to_corridor', 'corridor', r_name FROM se WHERE r_name NOT IN (FROM dc)
UNION ALL SELECT DISTINCT 'corridor_to_port', 'corridor', r_name FROM pe WHERE r_name NOT IN (FROM dc)
UNION ALL SELECT DISTINCT 'corridor_to_port', 'port', p_brand FROM pe WHERE p_brand NOT IN (FROM dp)
UNION ALL SELECT DISTINCT 'port_to_refinery', 'port', p_brand FROM fe WHERE p_brand NOT IN (FROM dp)
UNION ALL SELECT DISTINCT 'port_to_refinery', 'refinery', p_name FROM fe WHERE p_name NOT IN (FROM dr)""")
def network_name_problems(spark, sf):
    t = lambda n: table(spark, sf, n)
    region, part, supplier = t("region"), t("part"), t("supplier")
    nation = t("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    edges = {
        "supplier_to_corridor": supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_name").alias("supplier"), F.col("r_name").alias("corridor")),
        # Every region ships to every brand: 5 x 25 names.
        "corridor_to_port": region.join(part.select("p_brand").distinct()).select(F.col("r_name").alias("corridor"), F.col("p_brand").alias("port")),
        "port_to_refinery": part.select(F.col("p_brand").alias("port"), F.col("p_name").alias("refinery")),
    }
    dims = {
        "suppliers": supplier.filter("s_acctbal >= 0").select(F.col("s_name").alias("name")),
        "corridors": region.filter("r_name <> 'ASIA'").select(F.col("r_name").alias("name")),
        "ports": part.filter("p_retailprice > 998").select(F.col("p_brand").alias("name")).distinct(),
        "refineries": part.filter("p_size = 7").select(F.col("p_name").alias("name")).distinct(),
    }
    return N.check_network_names(edges, dims)


@query("network_problems", f"""WITH {NET} SELECT net AS network_id, 'corridor not connected' AS problem, x AS name FROM (SELECT DISTINCT net FROM cp) n CROSS JOIN (SELECT r_name AS x FROM region UNION SELECT 'POLAR') a
  WHERE (net, x) NOT IN (SELECT (net, c) FROM cp)
UNION ALL SELECT net, 'refinery without inflow', 'P' || p_partkey FROM (SELECT DISTINCT net FROM cp) n CROSS JOIN part WHERE (net, 'P' || p_partkey) NOT IN (SELECT (net, r) FROM pr)""")
def network_problems(spark, sf):
    edges = network(spark, sf)
    nets = edges.select("network_id").distinct()
    names = table(spark, sf, "region").select(F.col("r_name").alias("name"))
    names = names.unionByName(names.agg(F.lit("POLAR").alias("name")))
    parts = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("name"))
    # Expected nodes: every name in each of the few networks.
    return N.network_checks(edges, nets.join(names), nets.join(parts))


@query("compatible_grades", f"""WITH {NET}, crude AS (SELECT DISTINCT net, c, CAST(CAST(substr(s, 2) AS BIGINT) % 50 AS DOUBLE) AS api, CAST(CAST(substr(s, 2) AS BIGINT) % 7 AS DOUBLE) / 2 AS sulfur FROM sc),
atp AS (SELECT DISTINCT net, p, api, sulfur FROM cp JOIN crude USING (net, c) WHERE p <> 'Brand#7'),
wnd AS (SELECT 'P' || p_partkey AS r, p_size - 3 AS lo, p_size AS hi, CAST(p_size % 3 AS DOUBLE) / 2 AS tol FROM part),
pw AS (SELECT DISTINCT net, p, lo, hi, tol FROM pr JOIN wnd USING (r)),
fit AS (SELECT net, p, lo, hi, tol, bool_or(api BETWEEN lo AND hi AND sulfur <= tol) AS f FROM pw JOIN atp USING (net, p) GROUP BY ALL)
SELECT net AS network_id, p AS port, r AS refinery, coalesce(f, true) AS grade_compatible FROM pr JOIN wnd USING (r) LEFT JOIN fit USING (net, p, lo, hi, tol)""")
def compatible_grades(spark, sf):
    p = network_parts(spark, sf)
    number = F.substring("supplier", 2, 20).cast("bigint")
    crude = p["suppliers"].withColumn("api_gravity", (number % 50).cast("double")).withColumn("sulfur_pct", (number % 7) / F.lit(2.0))
    windows = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("refinery"), (F.col("p_size") - 3).cast("double").alias("api_gravity_min"),
        F.col("p_size").cast("double").alias("api_gravity_max"), ((F.col("p_size") % 3) / F.lit(2.0)).alias("sulfur_tolerance"))
    feeds = p["feeds"].select("network_id", "port", "refinery")
    fleet_windows = feeds.select("network_id", "refinery").join(windows, "refinery")
    return N.grade_compatible(crude, p["ports"].filter("port <> 'Brand#7'"), feeds, fleet_windows)


@query("risky_edges", f"WITH {NET} SELECT net AS network_id, c AS corridor, p AS port, round(e, 6) AS effective_capacity FROM cpr")
def risky_edges(spark, sf):
    return risky_network(spark, sf).filter("layer = 2").select(
        "network_id", "corridor", F.col("dst").alias("port"), r6("effective_capacity").alias("effective_capacity"))


@query("stale_corridors", f"WITH {NET} SELECT DISTINCT net AS network_id, c AS corridor FROM sc JOIN risk USING (c) WHERE risk > 0 AND c <> 'EUROPE'")
def stale_corridors(spark, sf):
    """Risk reached one corridor's edges only."""
    risk = region_risk(spark, sf)
    return N.stale_risk(N.apply_risk(network(spark, sf), risk.filter("corridor = 'EUROPE'")), risk)


def _region_scenarios(spark, sf):
    """Each region degraded by ten percent per key, and one supply cut."""
    r = table(spark, sf, "region")
    corridor = r.select(
        F.concat(F.lit("hit:"), F.col("r_name")).alias("scenario_id"), F.col("r_name").alias("corridor"),
        (F.col("r_regionkey") * 10 + 30).cast("double").alias("degradation_pct"), F.lit(None).cast("double").alias("supply_reduction"))
    supply = r.agg(F.lit("cut supply").alias("scenario_id"), F.lit(None).cast("string").alias("corridor"),
                   F.lit(None).cast("double").alias("degradation_pct"), (F.sum("r_regionkey") * 10000.0).alias("supply_reduction"))
    return corridor.unionByName(supply)


SHOCKS = """SELECT net, 'hit:' || c AS sid, c AS hit, 1 - CAST(r_regionkey * 10 + 30 AS DOUBLE) / 100 AS keep, CAST(1 AS DOUBLE) AS supply FROM (SELECT DISTINCT net FROM cp) n CROSS JOIN risk
UNION ALL SELECT net, 'cut supply', NULL, CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 1 - (SELECT sum(r_regionkey) * CAST(10000 AS DOUBLE) FROM risk) / sum(v)) FROM sc GROUP BY net"""


@query("degraded_corridors", f"""WITH {NET}, scen AS ({SHOCKS}) SELECT net AS network_id, sid AS scenario_id, c AS corridor, round(sum(CASE WHEN c = hit THEN e * keep ELSE e END), 6) AS capacity
FROM cpr JOIN scen USING (net) GROUP BY ALL""")
def degraded_corridors(spark, sf):
    out = N.degrade_corridor(risky_network(spark, sf), _region_scenarios(spark, sf))
    return out.filter("layer = 2").groupBy("network_id", "scenario_id", "corridor").agg(r6(F.sum("effective_capacity")).alias("capacity"))


@query("degraded_supply", f"""WITH {NET}, scen AS ({SHOCKS}) SELECT net AS network_id, sid AS scenario_id, s AS supplier, round(sum(v) * any_value(supply), 6) AS capacity
FROM sc JOIN scen USING (net) GROUP BY net, sid, s""")
def degraded_supply(spark, sf):
    out = N.degrade_supply(risky_network(spark, sf), _region_scenarios(spark, sf))
    return out.filter("layer = 0").select("network_id", "scenario_id", F.col("dst").alias("supplier"), r6("effective_capacity").alias("capacity"))


RESIDUAL = """need AS (SELECT net, p, sum(v) AS need FROM pr GROUP BY ALL), tot AS (SELECT net, p, sum(v) AS t FROM cp GROUP BY ALL),
resid AS (SELECT net, p, c, greatest(CAST(0 AS DOUBLE), need - (t - v)) AS residual FROM cp JOIN tot USING (net, p) JOIN need USING (net, p))"""


@query("residual_port_need", f"WITH {NET}, {RESIDUAL} SELECT net AS network_id, p AS port, c AS corridor, round(residual, 6) AS residual FROM resid")
def residual_port_need(spark, sf):
    return N.residual_port_need(network(spark, sf)).withColumn("residual", r6("residual"))


@query("port_criticality", f"""WITH {NET}, {RESIDUAL} SELECT net AS network_id, p AS port, round(any_value(t), 6) AS naive_inflow, round(any_value(need), 6) AS downstream_need,
  round(sum(residual), 6) AS total_residual, round(greatest(CAST(0 AS DOUBLE), any_value(t) - any_value(need)), 6) AS stranded, count(*) AS corridors
FROM resid JOIN tot USING (net, p) JOIN need USING (net, p) GROUP BY net, p""")
def port_criticality(spark, sf):
    out = N.port_criticality(network(spark, sf)).withColumn("corridors", F.size("corridors").cast("bigint"))
    for c in ("naive_inflow", "downstream_need", "total_residual", "stranded"):
        out = out.withColumn(c, r6(c))
    return out


# --- flow and criticality ----------------------------------------------------------------

@query("static_flow", f"WITH {NET}, {STATIC}, {flow_ctes(BASE_SCEN)} SELECT net AS network_id, round(flow, 4) AS flow FROM flows")
def static_flow(spark, sf):
    return flow_value(network(spark, sf), "volume").withColumn("flow", F.round("flow", 4))


@query("risk_weighted_flow", f"WITH {NET}, {RISKY}, {flow_ctes(BASE_SCEN)} SELECT net AS network_id, round(flow, 4) AS flow FROM flows")
def risk_weighted_flow(spark, sf):
    return flow_value(risky_network(spark, sf)).withColumn("flow", F.round("flow", 4))


LOSS = "(SELECT f.net, substr(f.sid, 5) AS c, b.flow - f.flow AS loss FROM {t} f JOIN {t} b ON b.net = f.net AND b.sid = 'base' WHERE f.sid <> 'base')"


@query("corridor_cut_losses", f"WITH {NET}, {RISKY}, {flow_ctes(CUT_SCEN)} SELECT net AS network_id, c AS corridor, round(loss, 4) AS loss FROM {LOSS.format(t='flows')}")
def corridor_cut_losses(spark, sf):
    from straitline.operators.flow import port_components

    edges = risky_network(spark, sf)
    return C.cut_losses(edges, "effective_capacity", port_components(edges)).withColumn("loss", F.round("loss", 4))


_TWO_FLOWS = f"""rf AS (WITH {RISKY}, {flow_ctes(CUT_SCEN)} SELECT * FROM flows), sf AS (WITH {STATIC}, {flow_ctes(CUT_SCEN)} SELECT * FROM flows),
crit AS (SELECT a.net, a.c, a.loss AS capacity_loss, b.loss AS static_capacity_loss FROM {LOSS.format(t='rf')} a JOIN {LOSS.format(t='sf')} b USING (net, c))"""


@query("corridor_criticality", f"""WITH {NET}, {RESIDUAL}, {_TWO_FLOWS},
rk AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY static_capacity_loss DESC, c) AS static_rank, row_number() OVER (PARTITION BY net ORDER BY capacity_loss DESC, c) AS risk_rank FROM crit)
SELECT net AS network_id, c AS corridor, round(capacity_loss, 4) AS capacity_loss, round(static_capacity_loss, 4) AS static_capacity_loss, risk AS live_risk_score,
  static_rank, risk_rank, static_rank - risk_rank AS rank_shift, (SELECT round(sum(residual), 4) FROM resid WHERE resid.net = rk.net AND resid.c = rk.c) AS residual_load_bearing FROM rk JOIN risk USING (c)""")
def corridor_criticality(spark, sf):
    out = C.corridor_criticality(risky_network(spark, sf), region_risk(spark, sf))
    return out.select("network_id", "corridor", F.round("capacity_loss", 4).alias("capacity_loss"), F.round("static_capacity_loss", 4).alias("static_capacity_loss"),
                      "live_risk_score", "static_rank", "risk_rank", "rank_shift", F.round("residual_load_bearing", 4).alias("residual_load_bearing"))


@query("rank_shifts", f"""WITH {NET}, x AS (SELECT net, c, sum(v) AS a, sum(e) AS b FROM cpr GROUP BY ALL)
SELECT net AS network_id, c AS corridor, row_number() OVER (PARTITION BY net ORDER BY a DESC, c) - row_number() OVER (PARTITION BY net ORDER BY b DESC, c) AS rank_shift FROM x""")
def rank_shifts(spark, sf):
    rows = risky_network(spark, sf).filter("layer = 2").groupBy("network_id", "corridor").agg(
        F.sum("volume").alias("a"), F.sum("effective_capacity").alias("b"))
    return C.rank_shift(rows, "a", "b").select("network_id", "corridor", "rank_shift")


# Betweenness on a coarser network: supplier nation -> region -> brand -> part type.
def _coarse(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").repartition("l_partkey")
    met = lines.join(p.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    # As many rows as nations, brands and types have combinations, and all totals follow from them.
    flat = checkpointed(met.groupBy(
        F.lit("all").alias("network_id"), F.col("n_name").alias("supplier"), F.col("r_name").alias("corridor"), F.col("p_brand").alias("port"),
        F.col("p_type").alias("refinery")).agg(F.sum("l_quantity").alias("q")))
    total = lambda *k: flat.groupBy("network_id", *k).agg(F.sum("q").alias("volume"))
    return N.build_network(total("supplier", "corridor"), total("corridor", "port"), total("port", "refinery"), total("refinery").withColumnRenamed("volume", "capacity"))


_COARSE = """f AS (SELECT n_name AS s, r_name AS c, p_brand AS p, p_type AS r, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
e AS (SELECT 0 AS l, 'SOURCE' AS a, s AS b, sum(q) AS v FROM f GROUP BY s UNION ALL SELECT 1, s, c, sum(q) FROM f GROUP BY s, c UNION ALL SELECT 2, c, p, sum(q) FROM f GROUP BY c, p
  UNION ALL SELECT 3, p, r, sum(q) FROM f GROUP BY p, r UNION ALL SELECT 4, r, 'SINK', sum(q) FROM f GROUP BY r)"""


def betweenness_sql(length: str) -> str:
    """All-pairs path counting, layer by layer."""
    steps, prev = [], "SELECT l AS sl, a AS s, l + 1 AS tl, b AS t, d, CAST(1 AS DOUBLE) AS n FROM w"
    steps.append(f"p1 AS ({prev})")
    for i in range(2, 6):
        steps.append(f"""c{i} AS (SELECT p.sl, p.s, w.l + 1 AS tl, w.b AS t, p.d + w.d AS d, p.n FROM p{i - 1} p JOIN w ON w.l = p.tl AND w.a = p.t),
m{i} AS (SELECT sl, s, tl, t, min(d) AS m FROM c{i} GROUP BY ALL),
p{i} AS (SELECT sl, s, tl, t, min(d) AS d, sum(n) AS n FROM c{i} JOIN m{i} USING (sl, s, tl, t) WHERE d <= m + 1e-9 GROUP BY ALL)""")
    union = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, 6))
    return f"""WITH {_COARSE}, w AS (SELECT l, a, b, {length} AS d FROM e), {', '.join(steps)}, allp AS ({union}),
nodes AS (SELECT DISTINCT l, a FROM e UNION SELECT DISTINCT l + 1, b FROM e),
bc AS (SELECT x.tl AS l, x.t AS node, sum(x.n * y.n / z.n) AS b FROM allp x JOIN allp y ON y.sl = x.tl AND y.s = x.t JOIN allp z ON z.sl = x.sl AND z.s = x.s AND z.tl = y.tl AND z.t = y.t WHERE x.d + y.d <= z.d + 1e-9 GROUP BY ALL)
SELECT nodes.l AS layer, nodes.a AS node, round(coalesce(b, 0) / CAST(((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2) AS DOUBLE), 9) AS centrality FROM nodes LEFT JOIN bc ON bc.l = nodes.l AND bc.node = nodes.a"""


@query("structural_betweenness", betweenness_sql("CAST(1 AS DOUBLE)"))
def structural_betweenness(spark, sf):
    return betweenness(_coarse(spark, sf)).select("layer", "node", F.round("centrality", 9).alias("centrality"))


@query("weighted_betweenness", betweenness_sql("1 / greatest(v, CAST(1e-9 AS DOUBLE))"))
def weighted_betweenness(spark, sf):
    return betweenness(_coarse(spark, sf), "effective_capacity").select("layer", "node", F.round("centrality", 9).alias("centrality"))


@query("network_summary", f"""WITH {NET}, {STATIC}, {flow_ctes(CUT_SCEN)}, l AS {LOSS.format(t='flows')}
SELECT net AS network_id, (SELECT count(DISTINCT s) FROM sc WHERE sc.net = f.net) AS suppliers, (SELECT count(DISTINCT c) FROM cp WHERE cp.net = f.net) AS corridors,
  (SELECT count(DISTINCT p) FROM pr WHERE pr.net = f.net) AS ports, (SELECT count(*) FROM rt WHERE rt.net = f.net) AS refineries,
  round((SELECT sum(v) FROM sc WHERE sc.net = f.net), 4) AS supply, round(flow, 4) AS flow, round((SELECT sum(v) FROM sc WHERE sc.net = f.net) - flow, 4) AS unroutable,
  (SELECT round(max(loss), 4) FROM l WHERE l.net = f.net) AS worst_cut FROM flows f WHERE sid = 'base'""")
def network_summary(spark, sf):
    out = C.network_summary(network(spark, sf))
    return out.select("network_id", "suppliers", "corridors", "ports", "refineries", F.round("supply", 4).alias("supply"), F.round("flow", 4).alias("flow"),
                      F.round("unroutable", 4).alias("unroutable"), F.round(F.array_max(F.map_values("flow_lost")), 4).alias("worst_cut"))


# --- what-if -------------------------------------------------------------------------------

_CASCADE = f"""{BASE_SCEN} UNION ALL SELECT net, c || '@' || pct, c, 1 - CAST(pct AS DOUBLE) / 100, CAST(1 AS DOUBLE) FROM (SELECT DISTINCT net, c FROM cp) n CROSS JOIN (SELECT unnest(range(10, 101, 10)) AS pct) q"""


# Canonical split: what the flow gains when a refinery joins those before it in name order.
_SPLIT = """one AS (SELECT net, p, r, least(v, cap) AS u FROM pr JOIN rt USING (net, r)),
cum AS (SELECT *, sum(u) OVER (PARTITION BY net, p ORDER BY r ROWS UNBOUNDED PRECEDING) AS k FROM one),
gain AS (SELECT i.net, i.sid, i.x, r, least(i, k) - least(i, k - u) AS g FROM cum JOIN inflow i USING (net, p)),
pre AS (SELECT net, sid, x, r, g, sum(g) OVER (PARTITION BY net, sid, x ORDER BY r ROWS UNBOUNDED PRECEDING) AS h FROM gain),
sink AS (SELECT net, sid, r, greatest(CAST(0 AS DOUBLE), min(h + coalesce(sv, 0)) - min(h - g + coalesce(sv, 0))) AS inflow FROM pre LEFT JOIN sup USING (net, sid, x) GROUP BY ALL)"""


@query("refinery_inflow", f"WITH {NET}, {RISKY}, {flow_ctes(BASE_SCEN)}, {_SPLIT} SELECT net AS network_id, r AS refinery, round(inflow, 4) AS inflow FROM sink")
def refinery_inflow(spark, sf):
    return sink_inflow(risky_network(spark, sf)).select("network_id", "refinery", F.round("inflow", 4).alias("inflow"))


def impact_ctes(scenarios: str) -> str:
    return f"""{NET}, {RISKY}, {flow_ctes(scenarios)}, {_SPLIT},
aff AS (SELECT n.net, n.sid, n.r, b.inflow AS baseline, n.inflow AS now FROM sink n JOIN sink b ON b.net = n.net AND b.r = n.r AND b.sid = 'base' WHERE n.sid <> 'base' AND b.inflow > 0 AND n.inflow < b.inflow * CAST(0.95 AS DOUBLE)),
imp AS (SELECT f.net, f.sid, b.flow AS base, f.flow, b.flow - f.flow AS loss, (SELECT count(*) FROM aff WHERE aff.net = f.net AND aff.sid = f.sid) AS affected,
  coalesce((SELECT sum(baseline - now) FROM aff WHERE aff.net = f.net AND aff.sid = f.sid), 0) AS shortfall FROM flows f JOIN flows b ON b.net = f.net AND b.sid = 'base' WHERE f.sid <> 'base')"""


@query("cascade_curve", f"""WITH {impact_ctes(_CASCADE)} SELECT net AS network_id, sid AS scenario_id, round(flow, 4) AS flow_after, round(loss, 4) AS capacity_loss,
  affected AS affected_count, round(shortfall, 3) AS refinery_shortfall FROM imp""")
def cascade_curve(spark, sf):
    impact, _ = C.cascade_curve(risky_network(spark, sf))
    return impact.select("network_id", "scenario_id", F.round("flow_after", 4).alias("flow_after"), F.round("capacity_loss", 4).alias("capacity_loss"),
                         "affected_count", F.round("refinery_shortfall", 3).alias("refinery_shortfall"))


_IMPACT = impact_ctes(BASE_SCEN + ' UNION ALL ' + SHOCKS)


def _impact_scenarios(spark, sf, edges):
    return edges.select("network_id").distinct().join(_region_scenarios(spark, sf))  # three networks x six scenarios


@query("scenario_impact", f"""WITH {_IMPACT} SELECT net AS network_id, sid AS scenario_id, round(base, 4) AS baseline_flow, round(flow, 4) AS flow_after, round(loss, 4) AS capacity_loss,
  affected AS affected_count, round(shortfall, 3) AS refinery_shortfall FROM imp""")
def scenario_impact(spark, sf):
    edges = risky_network(spark, sf)
    impact, _ = C.scenario_impact(edges, _impact_scenarios(spark, sf, edges))
    return impact.select("network_id", "scenario_id", F.round("baseline_flow", 4).alias("baseline_flow"), F.round("flow_after", 4).alias("flow_after"),
                         F.round("capacity_loss", 4).alias("capacity_loss"), "affected_count", F.round("refinery_shortfall", 3).alias("refinery_shortfall"))


@query("affected_refineries", f"""WITH {_IMPACT} SELECT net AS network_id, sid AS scenario_id, r AS refinery, round(baseline, 4) AS baseline, round(now, 4) AS current FROM aff""")
def affected_refineries(spark, sf):
    edges = risky_network(spark, sf)
    _, affected = C.scenario_impact(edges, _impact_scenarios(spark, sf, edges))
    return affected.select("network_id", "scenario_id", "refinery", F.round("baseline", 4).alias("baseline"), F.round("current", 4).alias("current"))


@query("supply_gaps", f"""WITH {_IMPACT} SELECT net AS network_id, sid AS scenario_id, round(greatest(CAST(0 AS DOUBLE), loss), 4) AS gap,
  round(greatest(CAST(0 AS DOUBLE), greatest(CAST(0 AS DOUBLE), loss) - shortfall), 3) AS deadband_unattributed, round(greatest(CAST(0 AS DOUBLE), loss) * 14, 3) AS total_shortfall,
  CASE WHEN sid = 'cut supply' THEN 0 ELSE (SELECT count(*) FROM cp WHERE cp.net = imp.net AND cp.c = substr(sid, 5)) END AS load_bearing_ports FROM imp""")
def supply_gaps(spark, sf):
    edges = risky_network(spark, sf)
    gaps, _ = C.supply_gap(edges, _impact_scenarios(spark, sf, edges).withColumn("duration_days", F.lit(14)))
    return gaps.select("network_id", "scenario_id", F.round("gap", 4).alias("gap"), F.round("deadband_unattributed", 3).alias("deadband_unattributed"),
                       F.round("total_shortfall", 3).alias("total_shortfall"), F.size("load_bearing_ports").cast("bigint").alias("load_bearing_ports"))


@query("threshold_triggers", f"""WITH {NET}, {RISKY}, {flow_ctes(CUT_SCEN)}, x AS (SELECT l.net, l.c, CASE WHEN b.flow > 1e-9 THEN loss / b.flow ELSE 0 END AS frac, risk FROM {LOSS.format(t='flows')} l JOIN flows b ON b.net = l.net AND b.sid = 'base' JOIN risk USING (c)),
y AS (SELECT *, frac > CAST(0.15 AS DOUBLE) AS lc, risk > CAST(0.5 AS DOUBLE) AS rc FROM x)
SELECT net AS network_id, c AS corridor, round(frac, 6) AS loss_fraction, lc AS loss_crossed, rc AS risk_crossed,
  CASE WHEN lc OR rc THEN row_number() OVER (PARTITION BY net, lc OR rc ORDER BY frac DESC, risk DESC, c) END AS trigger_order FROM y""")
def threshold_triggers(spark, sf):
    from straitline.operators.flow import port_components

    edges = risky_network(spark, sf)
    losses = C.cut_losses(edges, "effective_capacity", port_components(edges)).withColumnRenamed("loss", "capacity_loss") \
        .join(region_risk(spark, sf).withColumnRenamed("risk", "live_risk_score"), "corridor")
    out = C.check_threshold(losses, flow_value(edges), risk_alone=0.5)
    return out.select("network_id", "corridor", r6("loss_fraction").alias("loss_fraction"), "loss_crossed", "risk_crossed", "trigger_order")


# One network per candidate: nation -> region -> brand -> (brand, type), regions scored as the event types in the same alphabetical place.
_CANDIDATE_NETS = STATS + f""", cs AS ({_CAND}), t5 AS (SELECT corridor, row_number() OVER (ORDER BY corridor) AS i FROM base),
risk AS (SELECT r_name AS c, r_regionkey, row_number() OVER (ORDER BY r_name) AS i FROM region),
scored AS (SELECT candidate AS net, c, score FROM cs JOIN t5 USING (corridor) JOIN risk USING (i)), nets AS (SELECT DISTINCT net FROM scored), {_COARSE},
sc AS (SELECT net, s, c, sum(q) AS v FROM f CROSS JOIN nets GROUP BY ALL), cp AS (SELECT net, c, p, sum(q) AS v FROM f CROSS JOIN nets GROUP BY ALL),
pr AS (SELECT net, p, p || '/' || r AS r, sum(q) AS v FROM f CROSS JOIN nets GROUP BY ALL), rt AS (SELECT net, r, v AS cap FROM pr),
cpr AS (SELECT net, c, p, v, v * (1 - least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), score))) AS e FROM cp JOIN scored USING (net, c)),
down AS (SELECT net, p, sum(least(v, cap)) AS d FROM pr JOIN rt USING (net, r) GROUP BY ALL), {_TWO_FLOWS},
rk AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY static_capacity_loss DESC, c) AS static_rank, row_number() OVER (PARTITION BY net ORDER BY capacity_loss DESC, c) AS risk_rank FROM crit)"""


@query("candidate_criticality", f"""{_CANDIDATE_NETS} SELECT net AS candidate, c AS corridor, round(capacity_loss, 4) AS capacity_loss, risk_rank, static_rank - risk_rank AS rank_shift,
  round(100 * (b.flow - a.flow) / b.flow, 4) AS lost_pct FROM rk JOIN rf a USING (net) JOIN sf b USING (net) WHERE a.sid = 'base' AND b.sid = 'base'""")
def candidate_criticality(spark, sf):
    """Each formula's scores of the five event types put on the five regions, in alphabetical order."""
    from pyspark.sql import Window as W

    scores = S.candidate_scores(_statistics(spark, sf), risk_corridors(spark, sf)).select("candidate", "corridor", "score")
    names = table(spark, sf, "region").select("r_name", F.row_number().over(W.orderBy("r_name")).alias("i"))  # five rows
    types = risk_corridors(spark, sf).select(F.col("name").alias("corridor"), F.row_number().over(W.orderBy("name")).alias("i"))
    mapped = scores.join(types, "corridor").join(names, "i").select("candidate", F.col("r_name").alias("corridor"), "score")
    out = C.candidate_criticality(_coarse_single_port(spark, sf), mapped)
    return out.select("candidate", "corridor", F.round("capacity_loss", 4).alias("capacity_loss"), "risk_rank", "rank_shift", F.round("lost_pct", 4).alias("lost_pct"))


def _coarse_single_port(spark, sf):
    """Nation -> region -> brand -> (brand, type)."""
    e = _coarse(spark, sf)
    feeds = e.filter("layer = 3").withColumn("dst", F.concat_ws("/", "src", "dst"))
    sinks = feeds.select("network_id", F.lit(4).alias("layer"), F.col("dst").alias("src"), F.lit("SINK").alias("dst"), "corridor", "volume", "effective_capacity")
    return e.filter("layer < 3").unionByName(feeds).unionByName(sinks)


# --- response ----------------------------------------------------------------------------------

@query("eligible_alternatives", f"WITH {ALT} SELECT r_name AS corridor, name FROM alt JOIN region ON r_name <> transits WHERE NOT sanctioned")
def eligible_alternatives(spark, sf):
    a = alternatives(spark, sf)
    # Each corridor of the five-row region table asks for every alternative.
    asked = a.join(table(spark, sf, "region").select(F.col("r_name").alias("corridor")))
    return R.eligible_alternatives(asked, F.col("corridor"), F.lit(False)).select("corridor", "name")


@query("fleet_compatibility", f"WITH {ALT} SELECT api AS api_gravity, sulfur AS sulfur_pct, round(compat, 6) AS compat FROM compat")
def fleet_compatibility(spark, sf):
    return R.fleet_compatibility(alternatives(spark, sf), fleet(spark, sf)).withColumn("compat", r6("compat"))


@query("scored_alternatives", f"""WITH {RANKED} SELECT DISTINCT c AS corridor, scored.crisis, sanc AS include_sanctioned, name, round(cost, 6) AS cost_score, round(trans, 6) AS transit_score, round(score, 6) AS score FROM scored JOIN dis USING (id)""")
def scored_alternatives(spark, sf):
    out = R.score_alternatives(disruptions(spark, sf), alternatives(spark, sf), fleet(spark, sf))
    return out.select("corridor", "crisis", "include_sanctioned", "name", r6("cost_score").alias("cost_score"), r6("transit_score").alias("transit_score"), r6("score").alias("score"))


@query("ranked_alternatives", f"""WITH {RANKED} SELECT id AS disruption_id, name, place, cum AS cumulative_coverage, round(CASE WHEN gap <= 1e-9 THEN 100 ELSE least(CAST(100 AS DOUBLE), cum / gap * 100) END, 6) AS cumulative_coverage_pct, cum >= gap - 1e-9 AS covers_gap FROM ranked""")
def ranked_alternatives(spark, sf):
    out = R.rank_alternatives(disruptions(spark, sf), alternatives(spark, sf), fleet(spark, sf))
    return out.select("disruption_id", "name", "place", "cumulative_coverage", r6("cumulative_coverage_pct").alias("cumulative_coverage_pct"), "covers_gap")


_USED = "used AS (SELECT * FROM ranked WHERE cum - vol < gap - 1e-9)"
USED = f"{RANKED}, {_USED}"


@query("replacement_timeline", f"""WITH {USED}, u AS (SELECT id, max(transit) AS t, sum(vol) AS v, count(*) AS n FROM used GROUP BY id)
SELECT id AS disruption_id, t AS transit_days, coalesce(n, 0) AS alternatives_used, coalesce(v, 0) AS covered, greatest(CAST(0 AS DOUBLE), gap - coalesce(v, 0)) AS residual_gap, coalesce(v, 0) >= gap - 1e-9 AS covers_gap FROM dis LEFT JOIN u USING (id)""")
def replacement_timeline(spark, sf):
    d = disruptions(spark, sf)
    return R.prefix_timeline(R.procured(d, R.rank_cases(d, alternatives(spark, sf), fleet(spark, sf))))


_DAILY = """g AS (SELECT id, gap, unnest(range(days)) AS day FROM dis),
daily AS (SELECT g.id, g.day, greatest(CAST(0 AS DOUBLE), g.gap - coalesce((SELECT sum(vol) FROM used u WHERE u.id = g.id AND u.transit <= g.day), 0)) AS gap FROM g)"""
DAILY = f"{USED}, {_DAILY}"


@query("daily_gaps", f"WITH {DAILY} SELECT id AS disruption_id, day, round(gap, 6) AS gap FROM daily")
def daily_gaps(spark, sf):
    d = disruptions(spark, sf)
    cases = checkpointed(R.rank_cases(d, alternatives(spark, sf), fleet(spark, sf)))  # read for the prefixes and for the days
    return R.prefix_daily_gap(R.procured(d, cases), cases).withColumn("gap", r6("gap"))


def order_gaps(spark, sf):
    """Daily gap per customer group and day of a 30-day horizon, from its orders."""
    o = table(spark, sf, "orders")
    g = o.groupBy((F.col("o_custkey") % 50).alias("disruption_id"), (F.datediff("o_orderdate", F.lit("1995-01-01")) % 30).alias("day")).agg(F.count("*").alias("n"))
    # Fill the horizon: 50 groups x 30 days.
    groups = g.select("disruption_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return groups.join(g, ["disruption_id", "day"], "left").select("disruption_id", "day", (F.coalesce("n", F.lit(0)) % 23 / F.lit(8.0)).alias("gap"))


_ORDER_GAPS = """g0 AS (SELECT o_custkey % 50 AS id, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS day, count(*) AS n FROM orders GROUP BY ALL),
g1 AS (SELECT a.id, d.day, (coalesce(n, 0) % 23) / CAST(8 AS DOUBLE) AS gap FROM (SELECT DISTINCT id FROM g0) a CROSS JOIN (SELECT unnest(range(30)) AS day) d LEFT JOIN g0 ON g0.id = a.id AND g0.day = d.day)"""
# The schedule of 30 days from g1(id, day, gap).
_SCHEDULE = """t AS (SELECT id, sum(gap) AS req, least(CAST(36.87 AS DOUBLE) * CAST(0.8 AS DOUBLE), sum(least(gap, 1))) AS used, sum(greatest(0, gap - 1)) AS forced, max(greatest(0, gap - 1)) AS mx FROM g1 GROUP BY id),
lv AS (SELECT id, day, gap, coalesce(sum(gap) OVER (PARTITION BY id ORDER BY gap, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre, 31 - row_number() OVER (PARTITION BY id ORDER BY gap, day) AS remaining FROM g1),
lw AS (SELECT id, arg_min((req - used - pre) / remaining, (gap, day)) AS w FROM lv JOIN t USING (id) WHERE pre + gap * remaining >= req - used - 1e-12 GROUP BY id),
pk AS (SELECT t.id, req, used, forced, greatest(mx, coalesce(w, 0), 0) AS peak FROM t LEFT JOIN lw USING (id)),
rm AS (SELECT g1.id, day, gap, greatest(0, gap - 1) AS f, least(gap, peak) - greatest(0, gap - 1) AS room, greatest(0, req - used - forced) AS pour FROM g1 JOIN pk USING (id)),
un AS (SELECT id, day, gap, f + greatest(0, least(room, pour - coalesce(sum(room) OVER (PARTITION BY id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS unmet FROM rm),
sch AS (SELECT id, day, gap, greatest(0, gap - unmet) AS release, unmet, sum(greatest(0, gap - unmet)) OVER (PARTITION BY id ORDER BY day) AS released FROM un)"""
RESERVE = f"{_ORDER_GAPS}, {_SCHEDULE}"


@query("reserve_drawdown", f"WITH {RESERVE} SELECT id AS disruption_id, CAST(day AS INTEGER) AS day, gap, round(release, 6) AS release, round(unmet, 6) AS unmet, round(released, 6) AS released FROM sch")
def reserve_drawdown(spark, sf):
    out = R.reserve_drawdown(order_gaps(spark, sf))
    return out.select("disruption_id", "day", "gap", r6("release").alias("release"), r6("unmet").alias("unmet"), r6("released").alias("released"))


@query("reserve_summary", f"""WITH {RESERVE}, l AS (SELECT *, max(unmet) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM sch)
SELECT id AS disruption_id, round(sum(release), 6) AS total_released, round(sum(unmet), 6) AS total_unmet, CAST(min(day) FILTER (WHERE released >= CAST(36.87 AS DOUBLE) * CAST(0.8 AS DOUBLE) - 1e-6 AND later > 1e-6) AS INTEGER) AS reserve_exhausted_day,
  round(CASE WHEN least(arg_min(gap, day), 1) > 1e-9 THEN CAST(36.87 AS DOUBLE) * CAST(0.8 AS DOUBLE) / least(arg_min(gap, day), 1) END, 6) AS days_of_cover, sum(unmet) > 1e-6 AS insufficient FROM l GROUP BY id""")
def reserve_summary(spark, sf):
    out = R.reserve_summary(R.reserve_drawdown(order_gaps(spark, sf)))
    return out.select("disruption_id", r6("total_released").alias("total_released"), r6("total_unmet").alias("total_unmet"), "reserve_exhausted_day", r6("days_of_cover").alias("days_of_cover"), "insufficient")


_PLANS = f"""WITH {impact_ctes(CUT_SCEN)}, {ALT},
dis AS (SELECT net || '/' || substr(sid, 5) AS id, substr(sid, 5) AS c, 'normal' AS crisis, greatest(CAST(0 AS DOUBLE), loss) AS gap, affected, 30 AS days, false AS sanc FROM imp),
{LISTS}, {_USED}, {_DAILY}, g1 AS (SELECT id, day, gap FROM daily), {_SCHEDULE},
later AS (SELECT *, max(unmet) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM sch)"""


def _region_plans(spark, sf):
    """Every region closed in every network, answered by the suppliers of other regions."""
    edges = risky_network(spark, sf)
    regions = table(spark, sf, "region").select(F.col("r_name").alias("corridor"))
    asked = edges.select("network_id").distinct().join(regions).select(
        F.concat_ws("/", "network_id", "corridor").alias("disruption_id"), "network_id", "corridor", F.lit(None).cast("string").alias("scenario"),
        F.lit(100.0).alias("degradation_pct"), F.lit(30).alias("duration_days"), F.lit("normal").alias("crisis"), F.lit(False).alias("include_sanctioned"))
    return response_plan(edges, asked, alternatives(spark, sf), fleet(spark, sf))


@query("response_plans", f"""{_PLANS}, u AS (SELECT id, count(*) AS n, sum(vol) AS v FROM used GROUP BY id),
s AS (SELECT id, sum(release) AS released, CAST(min(day) FILTER (WHERE released >= CAST(36.87 AS DOUBLE) * CAST(0.8 AS DOUBLE) - 1e-6 AND later > 1e-6) AS INTEGER) AS dry FROM later GROUP BY id)
SELECT id AS disruption_id, round(gap, 4) AS gap, affected AS affected_count, coalesce(n, 0) AS alternatives_used, round(greatest(CAST(0 AS DOUBLE), gap - coalesce(v, 0)), 4) AS residual_gap,
  round(s.released, 6) AS total_released, dry AS reserve_exhausted_day FROM dis LEFT JOIN u USING (id) LEFT JOIN s USING (id)""")
def response_plans(spark, sf):
    plan = _region_plans(spark, sf)
    return plan["gaps"].select(F.col("scenario_id").alias("disruption_id"), F.round("gap", 4).alias("gap"), "affected_count").join(
        plan["timeline"].select("disruption_id", "alternatives_used", F.round("residual_gap", 4).alias("residual_gap")), "disruption_id").join(
        plan["reserve"].select("disruption_id", r6("total_released").alias("total_released"), "reserve_exhausted_day"), "disruption_id")


@query("response_schedules", f"""{_PLANS} SELECT id AS disruption_id, CAST(day AS INTEGER) AS day, round(gap, 4) AS gap, round(release, 4) AS release, round(unmet, 4) AS unmet FROM sch""")
def response_schedules(spark, sf):
    return _region_plans(spark, sf)["schedule"].select(
        "disruption_id", "day", *[F.round(c, 4).alias(c) for c in ("gap", "release", "unmet")])


@query("response_lists", f"""{_PLANS} SELECT id AS disruption_id, place, name, round(score, 6) AS score, cum AS cumulative_coverage, cum >= gap - 1e-9 AS covers_gap FROM ranked""")
def response_lists(spark, sf):
    return _region_plans(spark, sf)["ranked"].select("disruption_id", "place", "name", r6("score").alias("score"), "cumulative_coverage", "covers_gap")
