"""Layered supply networks as edge tables; many networks and scenarios run in one job.

Edges: (network_id, layer, src, dst, corridor, volume, effective_capacity). Layers: 0 source to
supplier, 1 supplier to corridor, 2 corridor to port (the only layer that carries the corridor
tag), 3 port to refinery, 4 refinery to sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from straitline import constants as K

EDGE_COLUMNS = ("network_id", "layer", "src", "dst", "corridor", "volume", "effective_capacity")


def check_network_names(edges: dict[str, DataFrame], dims: dict[str, DataFrame]) -> DataFrame:
    """(edge_list, kind, name) of every name in an edge list that its dimension table lacks.

    ``edges``: supplier_to_corridor, corridor_to_port, port_to_refinery; ``dims``: suppliers,
    corridors, ports, refineries with a ``name`` column.
    """
    checks = (
        ("supplier_to_corridor", "supplier", "suppliers"), ("supplier_to_corridor", "corridor", "corridors"),
        ("corridor_to_port", "corridor", "corridors"), ("corridor_to_port", "port", "ports"),
        ("port_to_refinery", "port", "ports"), ("port_to_refinery", "refinery", "refineries"),
    )
    problems = None
    for edge_list, kind, dim in checks:
        names = edges[edge_list].select(F.col(kind).alias("name")).distinct()
        lost = names.join(dims[dim].select("name"), "name", "left_anti").select(
            F.lit(edge_list).alias("edge_list"), F.lit(kind).alias("kind"), "name")
        problems = lost if problems is None else problems.unionByName(lost)
    return problems


def supplier_totals(supplier_edges: DataFrame) -> DataFrame:
    """Capacity of each supplier: the sum of its corridor volumes."""
    return supplier_edges.groupBy("network_id", "supplier").agg(F.sum("volume").alias("volume"))


def build_network(supplier_edges: DataFrame, port_edges: DataFrame, refinery_edges: DataFrame,
                  refineries: DataFrame) -> DataFrame:
    """Unified edges from (network_id, supplier, corridor, volume), (network_id, corridor, port,
    volume), (network_id, port, refinery, volume) and (network_id, refinery, capacity)."""
    def layer(df, number, src, dst, volume="volume", corridor=None):
        return df.select(
            "network_id", F.lit(number).alias("layer"), src.alias("src"), dst.alias("dst"),
            (F.lit(None).cast("string") if corridor is None else corridor).alias("corridor"),
            F.col(volume).cast("double").alias("volume"), F.col(volume).cast("double").alias("effective_capacity"))

    c = F.col
    return (
        layer(supplier_totals(supplier_edges), 0, F.lit(K.SOURCE), c("supplier"))
        .unionByName(layer(supplier_edges, 1, c("supplier"), c("corridor")))
        .unionByName(layer(port_edges, 2, c("corridor"), c("port"), corridor=c("corridor")))
        .unionByName(layer(refinery_edges, 3, c("port"), c("refinery")))
        .unionByName(layer(refineries, 4, c("refinery"), F.lit(K.SINK), "capacity"))
    )


def network_from_seed(seed: dict[str, DataFrame], network_id: str = "seed") -> DataFrame:
    net = F.lit(network_id).alias("network_id")
    return build_network(
        seed["supplier_to_corridor"].select(net, "supplier", "corridor", F.col("volume_mbd").alias("volume")),
        seed["corridor_to_port"].select(net, "corridor", "port", F.col("volume_mbd").alias("volume")),
        seed["port_to_refinery"].select(net, "port", "refinery", F.col("volume_mbd").alias("volume")),
        seed["refineries"].select(net, F.col("name").alias("refinery"), F.col("capacity_mbd").alias("capacity")))


def grade_compatible(supplier_edges: DataFrame, port_edges: DataFrame, refinery_edges: DataFrame,
                     refineries: DataFrame) -> DataFrame:
    """Whether any crude that reaches the port of a port-refinery edge fits the refinery's window.

    A port no crude reaches is compatible; a port reached only by crudes of unknown grade is not.
    Crudes and windows are reduced to distinct ones per port, and windows meet crudes only in the
    whole-degree gravity bands they cover.
    """
    port, window = ["network_id", "port"], ["api_gravity_min", "api_gravity_max", "sulfur_tolerance"]
    crudes = supplier_edges.groupBy("network_id", "corridor", "api_gravity").agg(F.min("sulfur_pct").alias("sulfur_pct"))
    at_port = port_edges.select("network_id", "corridor", "port").distinct().join(crudes, ["network_id", "corridor"]) \
        .groupBy(*port, "api_gravity").agg(F.min("sulfur_pct").alias("sulfur_pct"))
    rows = refinery_edges.select("network_id", "port", "refinery").join(
        refineries.select("network_id", "refinery", *window), ["network_id", "refinery"])
    # A window open to one side has bands only as far as crudes of the port occur.
    span = at_port.groupBy(*port).agg(F.floor(F.min("api_gravity")).alias("low"), F.floor(F.max("api_gravity")).alias("high"))
    bands = rows.filter("api_gravity_min <= api_gravity_max").select(*port, *window).distinct().join(span, port).withColumns({
        "low": F.greatest("low", F.floor("api_gravity_min")), "high": F.least("high", F.floor("api_gravity_max"))}) \
        .filter("low <= high").withColumn("band", F.explode(F.sequence("low", "high"))).drop("low", "high")
    # At one gravity the least sulfur decides whether any crude fits.
    fits = at_port.withColumn("band", F.floor("api_gravity")).join(bands, [*port, "band"]).filter(
        "api_gravity BETWEEN api_gravity_min AND api_gravity_max AND sulfur_pct <= sulfur_tolerance") \
        .select(*port, *window).distinct().withColumn("fits", F.lit(True))
    reached = at_port.select(*port).distinct().withColumn("reached", F.lit(True))
    return rows.join(fits, [*port, *window], "left").join(reached, port, "left").select(
        "network_id", "port", "refinery",
        (F.coalesce("fits", F.lit(False)) | F.col("reached").isNull()).alias("grade_compatible"))


def apply_risk(edges: DataFrame, risk: DataFrame) -> DataFrame:
    """Scale tagged edges by 1 - risk, clamped to [0, 1]; others stay as they are.

    ``risk`` holds (corridor, risk) and, when it differs by network, network_id.
    """
    keys = ["network_id", "corridor"] if "network_id" in risk.columns else ["corridor"]
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk")))
    scaled = F.when(F.col("risk").isNotNull(), F.col("volume") * (1.0 - clamped)).otherwise(F.col("effective_capacity"))
    return edges.join(risk.select(*keys, "risk"), keys, "left").withColumn("effective_capacity", scaled).select(*EDGE_COLUMNS)


def stale_risk(edges: DataFrame, risk: DataFrame) -> DataFrame:
    """Scored corridors none of whose edges is below its volume: the risk never reached the edges."""
    touched = edges.filter(
        F.col("corridor").isNotNull() & (F.col("effective_capacity") < F.col("volume") - 1e-9)
    ).select("network_id", "corridor").distinct()
    scored = edges.filter("layer = 1").select("network_id", F.col("dst").alias("corridor")).distinct() \
        .join(risk.filter("risk > 0").select("corridor"), "corridor")
    return scored.join(touched, ["network_id", "corridor"], "left_anti").select("network_id", "corridor")


def network_checks(edges: DataFrame, corridors: DataFrame, refineries: DataFrame) -> DataFrame:
    """(network_id, problem, name): unconnected corridors, refineries without inflow, no path.

    ``corridors`` and ``refineries``: (network_id, name) of the nodes that should be connected.
    """
    def ends(layer, column):
        return edges.filter(F.col("layer") == layer).select("network_id", F.col(column).alias("name")).distinct()

    linked = ends(1, "dst").join(ends(2, "src"), ["network_id", "name"])
    loose = corridors.select("network_id", "name").join(linked, ["network_id", "name"], "left_anti").select(
        "network_id", F.lit("corridor not connected").alias("problem"), "name")
    dry = refineries.select("network_id", "name").join(ends(3, "dst"), ["network_id", "name"], "left_anti").select(
        "network_id", F.lit("refinery without inflow").alias("problem"), "name")
    live_ports = ends(2, "dst").join(
        edges.filter("layer = 2").select("network_id", F.col("src").alias("c"), F.col("dst").alias("name"))
        .join(linked.withColumnRenamed("name", "c"), ["network_id", "c"], "left_semi")
        .select("network_id", "name").distinct(), ["network_id", "name"], "left_semi")
    fed = edges.filter("layer = 3").join(
        live_ports.withColumnRenamed("name", "src"), ["network_id", "src"], "left_semi").select(
            "network_id", F.col("dst").alias("name")).distinct()
    reached = ends(4, "src").join(fed, ["network_id", "name"]).select("network_id").distinct()
    broken = edges.select("network_id").distinct().join(reached, "network_id", "left_anti").select(
        "network_id", F.lit("no path from source to sink").alias("problem"), F.lit(None).cast("string").alias("name"))
    return loose.unionByName(dry).unionByName(broken)


def require_percent(scenarios: DataFrame, column: str = "degradation_pct") -> DataFrame:
    """Fail the job on a percentage outside [0, 100]."""
    bad = F.col(column).isNotNull() & ~F.col(column).between(0, 100)
    return scenarios.withColumn(column, F.when(bad, F.raise_error(
        F.concat(F.lit(f"{column} must be in [0, 100], got "), F.col(column).cast("string")))).otherwise(F.col(column)))


def degrade_corridor(edges: DataFrame, scenarios: DataFrame, capacity: str = "effective_capacity") -> DataFrame:
    """One copy of each network per scenario with the scenario's corridor scaled by 1 - pct/100.

    ``scenarios`` (scenario_id, corridor, degradation_pct), with network_id when they differ by
    network; a scenario without corridor leaves its copy unchanged.
    """
    keys = ["network_id"] if "network_id" in scenarios.columns else []
    chosen = require_percent(scenarios).select(
        *keys, "scenario_id", F.col("corridor").alias("hit"), "degradation_pct")
    copies = edges.join(chosen, keys) if keys else edges.join(chosen)  # each scenario needs each edge
    factor = F.when(F.col("corridor") == F.col("hit"), 1.0 - F.col("degradation_pct") / 100.0).otherwise(1.0)
    return copies.withColumn(capacity, F.col(capacity) * factor).drop("hit", "degradation_pct")


def degrade_supply(edges: DataFrame, scenarios: DataFrame, capacity: str = "effective_capacity") -> DataFrame:
    """One copy of each network per scenario with source edges cut in proportion to lose ``supply_reduction``."""
    keys = ["network_id"] if "network_id" in scenarios.columns else []
    bad = F.col("supply_reduction") < 0
    chosen = scenarios.select(*keys, "scenario_id", F.when(bad, F.raise_error(F.lit("supply_reduction must be >= 0")))
                              .otherwise(F.col("supply_reduction")).alias("supply_reduction"))
    totals = edges.filter("layer = 0").groupBy("network_id").agg(F.sum(capacity).alias("total"))
    factors = (totals.join(chosen, keys) if keys else totals.join(chosen)).select(
        "network_id", "scenario_id",
        F.when(F.col("total") <= K.CAPACITY_EPS, 1.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.coalesce("supply_reduction", F.lit(0.0)) / F.col("total"))).alias("factor"))
    scaled = F.when(F.col("layer") == 0, F.col(capacity) * F.col("factor")).otherwise(F.col(capacity))
    return edges.join(factors, "network_id").withColumn(capacity, scaled).drop("factor")


def residual_port_need(edges: DataFrame) -> DataFrame:
    """Per port and corridor: downstream need the other corridors of the port could not cover."""
    need = edges.filter("layer = 3").groupBy("network_id", F.col("src").alias("port")).agg(F.sum("volume").alias("need"))
    inflow = edges.filter("layer = 2").groupBy("network_id", F.col("dst").alias("port"), "corridor").agg(F.sum("volume").alias("own"))
    totals = inflow.groupBy("network_id", "port").agg(F.sum("own").alias("inflow"))
    residual = F.greatest(F.lit(0.0), F.coalesce("need", F.lit(0.0)) - (F.col("inflow") - F.col("own")))
    return inflow.join(totals, ["network_id", "port"]).join(need, ["network_id", "port"], "left").select(
        "network_id", "port", "corridor", residual.alias("residual"))


def residual_by_corridor(edges: DataFrame) -> DataFrame:
    return residual_port_need(edges).groupBy("network_id", "corridor").agg(F.sum("residual").alias("residual_load_bearing"))


def port_criticality(edges: DataFrame) -> DataFrame:
    """Per port: inflow, need, residual per corridor and in total, and stranded oversupply."""
    ports = edges.filter("layer = 2").select("network_id", F.col("dst").alias("port")).unionByName(
        edges.filter("layer = 3").select("network_id", F.col("src").alias("port"))).distinct()
    inflow = edges.filter("layer = 2").groupBy("network_id", F.col("dst").alias("port")).agg(F.sum("volume").alias("naive_inflow"))
    need = edges.filter("layer = 3").groupBy("network_id", F.col("src").alias("port")).agg(F.sum("volume").alias("downstream_need"))
    # One entry per corridor of the port, at most MAX_CORRIDORS.
    residual = residual_port_need(edges).groupBy("network_id", "port").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("corridor", "residual")))).alias("corridors"),
        F.sum("residual").alias("total_residual"))
    key = ["network_id", "port"]
    return (
        ports.join(inflow, key, "left").join(need, key, "left").join(residual, key, "left")
        .fillna(0.0, ["naive_inflow", "downstream_need", "total_residual"])
        .withColumn("stranded", F.greatest(F.lit(0.0), F.col("naive_inflow") - F.col("downstream_need")))
        .orderBy("network_id", F.desc("stranded"), "port")
    )
