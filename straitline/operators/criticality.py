"""Criticality of corridors, what-if scenarios and the response trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from straitline import constants as K
from straitline.operators.centrality import betweenness
from straitline.operators.flow import SCENARIO, corridor_bits, flow_by_scenario, flow_value, inflow_lists, port_components
from straitline.operators.network import apply_risk, residual_by_corridor, residual_port_need
from straitline.session import checkpointed

BASE = "base"
#: Losses are told to this share of a network's flow: far above what the order of a sum changes, far below what matters.
LOSS_BITS = 40
RANK_KEYS = {"capacity_loss": ("static_capacity_loss", "capacity_loss"), "centrality": ("static_centrality", "centrality")}


def rank_shift(rows: DataFrame, static_key: str, risk_key: str) -> DataFrame:
    """Ranks by two measures (largest first, then name) and how far a corridor moved up.

    One row per corridor and network, so the windows are short.
    """
    place = lambda c: F.row_number().over(W.partitionBy("network_id").orderBy(F.desc(c), "corridor"))
    return rows.withColumn("static_rank", place(static_key)).withColumn("risk_rank", place(risk_key)).withColumn(
        "rank_shift", F.col("static_rank") - F.col("risk_rank"))


def cut_scenarios(edges: DataFrame) -> DataFrame:
    """The unchanged network and one full cut per corridor."""
    cuts = corridor_bits(edges).select(
        "network_id", F.concat(F.lit("cut:"), F.col("corridor")).alias("scenario_id"), "corridor",
        F.lit(100.0).alias("degradation_pct"), F.lit(None).cast("double").alias("supply_reduction"))
    return cuts.unionByName(_base_scenarios(edges))


def _base_scenarios(edges: DataFrame) -> DataFrame:
    return edges.select("network_id").distinct().select(
        "network_id", F.lit(BASE).alias("scenario_id"), F.lit(None).cast("string").alias("corridor"),
        F.lit(None).cast("double").alias("degradation_pct"), F.lit(None).cast("double").alias("supply_reduction"))


def cut_losses(edges: DataFrame, capacity: str, components: DataFrame) -> DataFrame:
    """(network_id, corridor, loss): flow lost when the corridor is closed.

    Flows are sums in no fixed order, so that equal losses would differ in their last bits, and a loss of nothing could be
    negative. Losses are therefore multiples of a power of two, 2 ** -LOSS_BITS of the network's flow: equal ones compare equal.
    """
    flows = checkpointed(flow_by_scenario(edges, cut_scenarios(edges), capacity, components))
    base = flows.filter(F.col("scenario_id") == BASE).select("network_id", F.col("flow").alias("base"))
    return flows.filter(F.col("scenario_id") != BASE).join(base, "network_id").select(
        "network_id", F.substring_index("scenario_id", "cut:", -1).alias("corridor"),
        told_loss(F.col("base"), F.col("base") - F.col("flow")).alias("loss"))


def told_loss(base: Column, loss: Column) -> Column:
    """``loss`` as a multiple of 2 ** -LOSS_BITS of ``base``, rounded up to a power of two; never below zero."""
    grid = F.pow(F.lit(2.0), F.ceil(F.log2(base)) - LOSS_BITS)
    return F.when(base > 0, F.greatest(F.lit(0.0), F.rint(loss / grid) * grid)).otherwise(F.lit(0.0))


def corridor_criticality(edges: DataFrame, risk: DataFrame, rank_by: str = "capacity_loss") -> DataFrame:
    """Per network and corridor: losses and centralities on volumes and on today's risk, ranks, shift.

    ``edges`` carry today's effective capacity; ``risk`` (corridor, risk) is reported with it.
    """
    if rank_by not in RANK_KEYS:
        raise ValueError(f"rank_by must be one of {tuple(RANK_KEYS)}, got {rank_by!r}")
    components = port_components(edges)
    key = ["network_id", "corridor"]
    # Each measure is one row per corridor; materialising them keeps the combined plan small.
    central = lambda weight, name: checkpointed(betweenness(edges, weight).filter("layer = 2").select(
        "network_id", F.col("node").alias("corridor"), F.col("centrality").alias(name)))
    risk_keys = key if "network_id" in risk.columns else ["corridor"]
    rows = (
        corridor_bits(edges).select("network_id", "corridor")
        .join(central("effective_capacity", "centrality"), key, "left")
        .join(central(None, "static_centrality"), key, "left")
        .join(cut_losses(edges, "effective_capacity", components).withColumnRenamed("loss", "capacity_loss"), key)
        .join(cut_losses(edges, "volume", components).withColumnRenamed("loss", "static_capacity_loss"), key)
        .join(risk.select(*risk_keys, F.col("risk").alias("live_risk_score")), risk_keys, "left")
        .join(residual_by_corridor(edges), key, "left")
        .fillna(0.0, ["live_risk_score", "residual_load_bearing", "centrality", "static_centrality"])
    )
    return rank_shift(rows, *RANK_KEYS[rank_by]).orderBy("network_id", "risk_rank")


def affected_sinks(base: DataFrame, now: DataFrame, below: float = K.AFFECTED_BELOW) -> DataFrame:
    """Refineries whose inflow fell below a share of their own baseline.

    ``base`` (network_id, refinery, inflow), ``now`` (network_id, scenario_id, refinery, inflow).
    """
    before = base.select("network_id", "refinery", F.col("inflow").alias("baseline")).filter("baseline > 0")
    return now.join(before, ["network_id", "refinery"]).filter(F.col("inflow") < F.col("baseline") * below).select(
        *SCENARIO, "refinery", "baseline", F.col("inflow").alias("current"),
        (F.col("inflow") / F.col("baseline")).alias("pct_of_baseline"), (F.col("baseline") - F.col("inflow")).alias("shortfall"))


def _affected_in_lists(lists: DataFrame, below: float = K.AFFECTED_BELOW) -> DataFrame:
    """``affected_sinks`` of the lists of ``inflow_lists``: a refinery's baseline lies beside its scenarios, so nothing is joined."""
    baseline = F.get(F.filter("inflows", lambda s: s["scenario_id"] == BASE), F.lit(0))["inflow"]
    rows = lists.withColumn("baseline", baseline).filter("baseline > 0").select("network_id", "refinery", "baseline", F.inline("inflows"))
    return rows.filter((F.col("scenario_id") != BASE) & (F.col("inflow") < F.col("baseline") * below)).select(
        *SCENARIO, "refinery", "baseline", F.col("inflow").alias("current"),
        (F.col("inflow") / F.col("baseline")).alias("pct_of_baseline"), (F.col("baseline") - F.col("inflow")).alias("shortfall"))


def scenario_table(spark: SparkSession) -> DataFrame:
    """The named scenarios with their cited figures (metadata, not model output)."""
    fields = [("scenario_id", StringType()), ("name", StringType()), ("mechanism", StringType()), ("corridor", StringType()),
              ("degradation_pct", DoubleType()), ("supply_reduction", DoubleType()), ("price_impact_usd", DoubleType()),
              ("affected_volume_mbd", DoubleType()), ("transit_day_increase", IntegerType()),
              ("india_impact_mbd", DoubleType()), ("source", StringType())]
    return spark.createDataFrame(list(K.SCENARIOS), StructType([StructField(n, t) for n, t in fields]))


def known_corridors_only(scenarios: DataFrame, edges: DataFrame) -> DataFrame:
    """Fail the job on a scenario (network_id, corridor) its network does not have: a typo must not read as no gap."""
    names = corridor_bits(edges).select("network_id", "corridor", F.lit(True).alias("known"))
    return scenarios.join(names, ["network_id", "corridor"], "left").withColumn("corridor", F.when(
        F.col("corridor").isNotNull() & F.col("known").isNull(),
        F.raise_error(F.concat(F.lit("unknown corridor "), F.col("corridor")))).otherwise(F.col("corridor"))).drop("known")


def scenario_impact(edges: DataFrame, scenarios: DataFrame, refineries: bool = True):
    """Flow before and after each scenario and the refineries it affects.

    ``scenarios``: network_id, scenario_id, corridor, degradation_pct, supply_reduction; other
    columns are carried along. Returns (impact, affected); ``affected`` is None without ``refineries``.
    """
    checked = known_corridors_only(scenarios, edges)
    core = checked.select("network_id", "scenario_id", "corridor", "degradation_pct", "supply_reduction")
    asked = core.unionByName(_base_scenarios(edges))
    components = port_components(edges)
    flows = checkpointed(flow_by_scenario(edges, asked, components=components))
    base = flows.filter(F.col("scenario_id") == BASE).select("network_id", F.col("flow").alias("baseline_flow"))
    impact = checked.join(flows.filter(F.col("scenario_id") != BASE), list(SCENARIO)).join(base, "network_id") \
        .withColumnRenamed("flow", "flow_after").withColumn("capacity_loss", F.col("baseline_flow") - F.col("flow_after"))
    if not refineries:
        return impact, None
    affected = _affected_in_lists(inflow_lists(edges, asked, components=components))
    counts = affected.groupBy(*SCENARIO).agg(
        F.count("*").alias("affected_count"), F.sum("shortfall").alias("refinery_shortfall"))
    impact = impact.join(counts, list(SCENARIO), "left").fillna(0, ["affected_count"]).fillna(0.0, ["refinery_shortfall"])
    return impact, affected


def cascade_scenarios(edges: DataFrame, step: int = 10, corridors: DataFrame | None = None) -> DataFrame:
    """Every corridor degraded from ``step`` to 100 percent; ``corridors`` narrows the choice."""
    chosen = corridor_bits(edges).select("network_id", "corridor")
    if corridors is not None:
        chosen = chosen.join(corridors, "corridor", "left_semi")
    grid = chosen.withColumn("pct", F.explode(F.sequence(F.lit(step), F.lit(100), F.lit(step))))
    return grid.select(
        "network_id", F.concat_ws("@", "corridor", F.col("pct").cast("string")).alias("scenario_id"), "corridor",
        F.col("pct").cast("double").alias("degradation_pct"), F.lit(None).cast("double").alias("supply_reduction"))


def cascade_curve(edges: DataFrame, step: int = 10, corridors: DataFrame | None = None, refineries: bool = True):
    """Flow, loss and affected refineries of every corridor at every step."""
    return scenario_impact(edges, cascade_scenarios(edges, step, corridors), refineries)


def load_bearing_ports(edges: DataFrame) -> DataFrame:
    """(network_id, corridor, load_bearing_ports): the residual need at each port the corridor feeds."""
    return residual_port_need(edges).groupBy("network_id", "corridor").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("port", "residual")))).alias("load_bearing_ports"))


def supply_gap(edges: DataFrame, scenarios: DataFrame):
    """Gap of each scenario (with ``duration_days``), how refineries share it, and the ports it bears on.

    Supply shocks have no corridor, hence no load-bearing ports. Returns (gaps, affected).
    """
    bad = F.col("duration_days") <= 0
    checked = scenarios.withColumn("duration_days", F.when(
        bad, F.raise_error(F.lit("duration_days must be > 0"))).otherwise(F.col("duration_days")))
    impact, affected = scenario_impact(edges, checked)
    gap = F.greatest(F.lit(0.0), F.col("capacity_loss"))
    empty = F.create_map().cast("map<string,double>")
    gaps = (
        impact.join(load_bearing_ports(edges), ["network_id", "corridor"], "left")
        .withColumn("gap", gap)
        .withColumn("deadband_unattributed", F.greatest(F.lit(0.0), F.col("gap") - F.col("refinery_shortfall")))
        .withColumn("load_bearing_ports", F.coalesce("load_bearing_ports", empty))
        .withColumn("total_shortfall", F.col("gap") * F.col("duration_days"))
    )
    return gaps, affected


def check_threshold(criticality: DataFrame, baseline: DataFrame, loss_fraction: float = K.LOSS_FRACTION_THRESHOLD,
                    risk_alone: float = K.RISK_ALONE_THRESHOLD) -> DataFrame:
    """Evaluate each corridor: loss share of the baseline flow, or risk alone, strictly above its bar.

    ``criticality`` (network_id, corridor, capacity_loss, live_risk_score), ``baseline`` (network_id,
    flow). Crossed corridors are ordered by share, risk and name; the first has trigger_order 1.
    """
    for name, value in (("loss_fraction", loss_fraction), ("risk_alone", risk_alone)):
        if not 0 < value <= 1:
            raise ValueError(f"{name} must be in (0, 1], got {value}")
    share = F.when(F.col("flow") > K.CAPACITY_EPS, F.col("capacity_loss") / F.col("flow")).otherwise(0.0)
    rows = criticality.join(baseline, "network_id").select(
        "network_id", "corridor", "capacity_loss", share.alias("loss_fraction"), "live_risk_score") \
        .withColumn("loss_crossed", F.col("loss_fraction") > loss_fraction) \
        .withColumn("risk_crossed", F.col("live_risk_score") > risk_alone) \
        .withColumn("crossed", F.col("loss_crossed") | F.col("risk_crossed"))
    order = W.partitionBy("network_id", "crossed").orderBy(F.desc("loss_fraction"), F.desc("live_risk_score"), "corridor")
    reason = F.concat_ws(
        "; ",
        F.when(F.col("loss_crossed"), F.format_string(
            f"capacity loss %.1f%% of baseline flow > {loss_fraction * 100:.0f}%%", F.col("loss_fraction") * 100)),
        F.when(F.col("risk_crossed"), F.format_string(f"risk score %.3f > {risk_alone:.2f}", "live_risk_score")))
    return rows.withColumn("trigger_order", F.when(F.col("crossed"), F.row_number().over(order))) \
        .withColumn("reason", F.when(F.col("crossed"), reason).otherwise("neither clause crossed"))


def triggered(evaluated: DataFrame) -> DataFrame:
    """One row per network: whether it triggered, by which corridor, why, and all crossed corridors in order."""
    return evaluated.groupBy("network_id").agg(
        F.max("crossed").alias("threshold_crossed"),
        F.max(F.when(F.col("trigger_order") == 1, F.col("corridor"))).alias("triggered_corridor"),
        F.coalesce(F.max(F.when(F.col("trigger_order") == 1, F.col("reason"))), F.lit("no corridor crossed either clause")).alias("reason"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("crossed"), F.struct("trigger_order", "corridor")))),
                    lambda x: x["corridor"]).alias("triggered"))


def evaluate_networks(edges: DataFrame, risk: DataFrame, rank_by: str = "capacity_loss") -> DataFrame:
    rows = corridor_criticality(edges, risk, rank_by)
    return check_threshold(rows, flow_value(edges))


def network_summary(edges: DataFrame, top: int = 5) -> DataFrame:
    """Node counts, supply, flow and unroutable volume, loss per corridor cut and most central nodes."""
    nodes = edges.filter("layer > 0").groupBy("network_id").agg(
        F.count_distinct(F.when(F.col("layer") == 1, F.col("src"))).alias("suppliers"),
        F.count_distinct(F.when(F.col("layer") == 2, F.col("src"))).alias("corridors"),
        F.count_distinct(F.when(F.col("layer") == 3, F.col("src"))).alias("ports"),
        F.count_distinct(F.when(F.col("layer") == 4, F.col("src"))).alias("refineries"))
    supply = edges.filter("layer = 0").groupBy("network_id").agg(F.sum("volume").alias("supply"))
    components = port_components(edges)
    flow = checkpointed(flow_value(edges, "volume", components))
    cuts = cut_losses(edges, "volume", components).groupBy("network_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("corridor", "loss")))).alias("flow_lost"))
    order = W.partitionBy("network_id").orderBy(F.desc("centrality"), "node")
    central = betweenness(edges).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top) \
        .groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct("place", "node", "centrality"))).alias("most_central"))
    return nodes.join(supply, "network_id").join(flow, "network_id").join(cuts, "network_id").join(central, "network_id") \
        .withColumn("unroutable", F.col("supply") - F.col("flow"))


def candidate_criticality(edges: DataFrame, scores: DataFrame, static_flow: DataFrame | None = None) -> DataFrame:
    """Criticality repeated under each candidate's scores; candidates are networks of one run.

    ``scores`` (candidate, corridor, score). Adds the share of the static flow lost to risk.
    """
    # Candidates are a handful of formula names: each gets its own copy of the network.
    names = scores.select("candidate").distinct()
    copies = edges.join(names).withColumn("network_id", F.concat_ws("|", "network_id", "candidate")).drop("candidate")
    networks = edges.select("network_id").distinct().join(names).select(
        "network_id", "candidate", F.concat_ws("|", "network_id", "candidate").alias("copy_id"))
    risk = networks.join(scores, "candidate").select(F.col("copy_id").alias("network_id"), "corridor", F.col("score").alias("risk"))
    risky = checkpointed(apply_risk(copies, risk))
    rows = corridor_criticality(risky, risk)
    flows = flow_value(risky).join(flow_value(copies, "volume").withColumnRenamed("flow", "static_flow"), "network_id")
    lost = 100.0 * (F.col("static_flow") - F.col("flow")) / F.col("static_flow")
    return rows.join(flows, "network_id").withColumn("lost_pct", lost).withColumnRenamed("network_id", "copy_id") \
        .join(networks, "copy_id").select(
            "network_id", "candidate", "corridor", "capacity_loss", "static_capacity_loss", "risk_rank", "rank_shift",
            F.col("flow").alias("risk_flow"), "static_flow", "lost_pct")
