"""Betweenness on layered networks: counts of shortest paths forwards, their dependencies backwards, layer by layer.

A start carries its distance and number of shortest paths from layer to layer, as rows (start, node). Back from the sink,
each node passes to those before it their part of the paths that go through it. No row ever names a way or a pair of ends:
the largest table has one row per start and edge. Suppliers whose corridors lie equally far from them, apart from a
constant, are one start with a multiplicity. Refineries with equal ways in and out are one node with a multiplicity, and so are
all that only one port feeds and that lie on none of its shortest ways to the sink. Weighted distance of an edge is
1 / max(capacity, 1e-9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from straitline import constants as K
from straitline.session import checkpointed

_TIE = 1e-9
#: Ways of one port to the sink that are longer than its shortest by more than this tie with it from no start: far above the
#: rounding of the longest distance (four edges of 1e9 at most).
_NEAR = 1e-5
_START = ["network_id", "start"]


def _tight(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, start, mult, src, src_paths, dst, dist, ..): the edges on shortest paths of each start.

    ``src_copies`` and ``dst_copies`` say for how many nodes an end of the edge stands, each with an edge of its own.
    """
    steps = reached.join(edges, ["network_id", "src"]).select(
        *_START, "mult", "src", F.col("paths").alias("src_paths"), "dst", (F.col("dist") + F.col("length")).alias("dist"), "src_copies", "dst_copies")
    least = steps.groupBy(*_START, "dst").agg(F.min("dist").alias("least"))
    # Read on the way there, on the way back and for the shares.
    return checkpointed(steps.join(least, [*_START, "dst"]).filter(F.col("dist") <= F.col("least") + _TIE).drop("least"))


def _reached(tight: DataFrame) -> DataFrame:
    """The nodes that the edges lead to, with distance and number of shortest paths."""
    return tight.groupBy(*_START, F.col("dst").alias("src")).agg(
        F.first("mult").alias("mult"), F.min("dist").alias("dist"), F.sum("src_paths").alias("paths"))


def _begins(nodes: DataFrame, kind: str) -> DataFrame:
    """Each node as a start of its own."""
    return nodes.select("network_id", F.concat(F.lit(f"{kind}:"), "src").alias("start"), "src", F.lit(1).cast("long").alias("mult"),
                        F.lit(0.0).alias("dist"), F.lit(1.0).alias("paths"))


def _supplier_classes(links: DataFrame) -> DataFrame:
    """Suppliers with equal relative distances as one start, at the corridors they touch."""
    profile = links.groupBy("network_id", "src").agg(
        F.min("length").alias("least"), F.sort_array(F.collect_list(F.struct("dst", "length"))).alias("entries"))  # the corridors of a node
    shape = F.transform("entries", lambda e: F.struct(e["dst"].alias("src"), F.round(e["length"] - F.col("least"), 9).alias("dist")))
    classes = profile.select("network_id", shape.alias("shape")).groupBy("network_id", "shape").agg(F.count("*").alias("mult"))
    return classes.select("network_id", F.concat(F.lit("class:"), F.to_json("shape")).alias("start"), "mult", F.inline("shape")).select(
        "network_id", "start", "src", "mult", "dist", F.lit(1.0).alias("paths"))


def _refinery_kinds(ways_in: DataFrame, ways_out: DataFrame) -> DataFrame:
    """(network_id, node, entries, exits): the ways of each refinery that some port feeds.

    Paths to a refinery of one port all come through that port, however long the last edge is. If its way through is not the
    port's shortest it passes nothing on: then neither lengths nor exits matter, and it is like all such refineries of the port.
    """
    into = ways_in.groupBy("network_id", F.col("dst").alias("node")).agg(
        F.sort_array(F.collect_list(F.struct("src", "length"))).alias("entries"))  # the ports of a refinery
    out = ways_out.groupBy("network_id", F.col("src").alias("node")).agg(F.sort_array(F.collect_list("length")).alias("exits"))
    none = F.array().cast("array<double>")
    ways = into.join(out, ["network_id", "node"], "left").withColumn("exits", F.coalesce("exits", none)).withColumn(
        "port", F.when(F.size("entries") == 1, F.get("entries", F.lit(0))["src"])).withColumn(
        "through", F.get("entries", F.lit(0))["length"] + F.get("exits", F.lit(0)))
    least = ways.filter("port IS NOT NULL").groupBy("network_id", "port").agg(F.min("through").alias("least"))  # a row per port
    passes = F.col("port").isNull() | F.coalesce(F.col("through") <= F.col("least") + _NEAR, F.lit(False))
    end = F.transform("entries", lambda e: F.struct(e["src"].alias("src"), F.lit(0.0).alias("length")))
    return ways.join(least, ["network_id", "port"], "left").select(
        "network_id", "node", F.when(passes, F.col("entries")).otherwise(end).alias("entries"), F.when(passes, F.col("exits")).otherwise(none).alias("exits"))


def _passed_back(tight: DataFrame, ahead: DataFrame | None) -> DataFrame:
    """What the starts of paths through ``src`` depend on it, given (network_id, start, src, depends) one layer ahead.

    A node's own path counts once and what lies behind it ``depends`` times; both are shared out among the edges on shortest
    paths to it by the number of paths that take them.
    """
    counts = tight.groupBy(*_START, "dst").agg(F.sum(F.col("src_paths") * F.col("src_copies")).alias("dst_paths"))
    if ahead is None:
        counts = counts.withColumn("depends", F.lit(0.0))
    else:
        counts = counts.join(ahead.select(*_START, F.col("src").alias("dst"), "depends"), [*_START, "dst"], "left")
    return tight.join(counts, [*_START, "dst"]).groupBy(*_START, "src").agg(
        F.first("mult").alias("mult"), F.sum(
            F.col("dst_copies") * F.col("src_paths") / F.col("dst_paths") * (1.0 + F.coalesce("depends", F.lit(0.0)))).alias("depends"))


def betweenness(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(network_id, layer, node, centrality) of every node, divided by (n-1)(n-2).

    ``weight`` names a capacity column; without it every edge has length one. Networks are read once.
    """
    length = F.lit(1.0) if weight is None else 1.0 / F.greatest(F.col(weight), F.lit(K.CAPACITY_EPS))
    links = checkpointed(edges.select("network_id", "layer", "src", "dst", length.alias("length")))
    one = F.lit(1).cast("long")
    layer = lambda n: links.filter(F.col("layer") == n).select("*", one.alias("src_copies"), one.alias("dst_copies")).drop("layer")
    kinds = _refinery_kinds(layer(3), layer(4))
    kind = F.to_json(F.struct("entries", "exits")).alias("kind")
    classes = checkpointed(kinds.groupBy("network_id", "entries", "exits").agg(F.count("*").alias("copies")).select("*", kind))
    feeds = classes.select("network_id", F.col("kind").alias("dst"), F.inline("entries"), one.alias("src_copies"), F.col("copies").alias("dst_copies"))
    sinks = classes.select("network_id", F.col("kind").alias("src"), F.lit(K.SINK).alias("dst"), F.explode("exits").alias("length"),
                           F.col("copies").alias("src_copies"), one.alias("dst_copies"))

    # From the source all suppliers are reached at once; the starts behind them join in layer by layer.
    source = layer(0).select("network_id", F.lit("source").alias("start"), F.col("dst").alias("src"), F.lit(1).cast("long").alias("mult"),
                             F.col("length").alias("dist"), F.lit(1.0).alias("paths"))
    to_corridors = _tight(source, layer(1))
    at_corridors = _reached(to_corridors).unionByName(_supplier_classes(layer(1))).unionByName(
        _begins(layer(2).select("network_id", "src").distinct(), "corridor"))
    to_ports = _tight(at_corridors, layer(2))
    at_ports = _reached(to_ports).unionByName(_begins(layer(3).select("network_id", "src").distinct(), "port"))
    to_refineries = _tight(at_ports, feeds)
    to_sink = _tight(_reached(to_refineries), sinks)

    refineries = _passed_back(to_sink, None)
    ports = _passed_back(to_refineries, refineries)
    corridors = _passed_back(to_ports, ports)
    suppliers = _passed_back(to_corridors, corridors)

    # A start is not passed by its own paths.
    found = None
    for number, part, own in ((1, suppliers, None), (2, corridors, "corridor:"), (3, ports, "port:"), (4, refineries, None)):
        passed = part if own is None else part.filter(~F.col("start").startswith(own))
        rows = passed.groupBy("network_id", F.col("src").alias("node")).agg(F.sum(F.col("mult") * F.col("depends")).alias("b")) \
            .withColumn("layer", F.lit(number))
        if number == 4:  # each refinery has what its class has
            rows = kinds.select("network_id", "node", kind).join(rows.withColumnRenamed("node", "kind"), ["network_id", "kind"]).select(rows.columns)
        found = rows if found is None else found.unionByName(rows)
    nodes = links.select("network_id", "layer", F.col("src").alias("node")).unionByName(
        links.select("network_id", (F.col("layer") + 1).alias("layer"), F.col("dst").alias("node"))).distinct()
    size = nodes.groupBy("network_id").agg(F.count("*").alias("n"))
    scale = (F.col("n") - 1.0) * (F.col("n") - 2.0)
    return nodes.join(found, ["network_id", "layer", "node"], "left").join(size, "network_id").select(
        "network_id", "layer", "node", (F.coalesce("b", F.lit(0.0)) / scale).alias("centrality"))
