"""Explicit schemas of landed and stored tables; nothing is inferred."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType,
    StructField, StructType, TimestampType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_S, _D, _I, _L, _B, _T = StringType(), DoubleType(), IntegerType(), LongType(), BooleanType(), TimestampType()

SLICE_LINES = _table(path=_S, slice_ts=_T, line_no=_L, line=_S, readable=_B)

SEARCH_DUMP = StructType([
    StructField("articles", ArrayType(_table(url=_S, title=_S, domain=_S, sourcecountry=_S, seendate=_S)), True),
])

FEED_ENTRIES = _table(
    feed=_S, pos=_I, link=_S, title=_S, summary=_S, description=_S, published=_T, updated=_T,
)

SANCTIONS = _table(
    ent_num=_S, name=_S, entity_type=_S, program=_S, title=_S, call_sign=_S, vessel_type=_S,
    tonnage=_S, grt=_S, vessel_flag=_S, vessel_owner=_S, remarks=_S,
)

PRICE_REPLY = _table(period=_S, series=_S, value=_S)

ARTICLES = _table(url=_S, source=_S, title=_S, raw_text=_S, ingested_at=_T, processed=_B)

EVENTS = _table(
    event_id=_L, corridor=_S, actor=_S, event_type=_S, severity=_I, confidence=_D, ts=_T,
    article_url=_S, title=_S,
)

RISK_SCORES = _table(corridor=_S, score=_D, raw_score=_D, computed_at=_T)

SUPPLIERS = _table(name=_S, country_code=_S, region=_S, avg_export_mbd=_D, sanctioned=_B)
CORRIDORS = _table(name=_S, capacity_mbd=_D, transit_days=_I, baseline_risk=_D)
PORTS = _table(name=_S, lat=_D, lon=_D, state=_S, throughput_mbd=_D)
REFINERIES = _table(
    name=_S, company=_S, lat=_D, lon=_D, capacity_mbd=_D, min_run_rate=_D, api_gravity_min=_D,
    api_gravity_max=_D, sulfur_tolerance=_D, connected_port=_S,
)
ALTERNATIVES = StructType(
    _table(
        name=_S, country=_S, route_description=_S, avoids_corridor=_S, transit_days=_I,
        price_premium_usd=_D, api_gravity=_D, sulfur_pct=_D, sanctioned=_B,
        max_incremental_mbd=_D,
    ).fields
    + [StructField("transits_corridors", ArrayType(_S), True)]
)
EDGE_LISTS = StructType([
    StructField("supplier_to_corridor", ArrayType(_table(
        supplier=_S, corridor=_S, volume_mbd=_D, api_gravity=_D, sulfur_pct=_D, crude_grade=_S)), True),
    StructField("corridor_to_port", ArrayType(_table(
        corridor=_S, port=_S, volume_mbd=_D, transit_days=_I)), True),
    StructField("port_to_refinery", ArrayType(_table(port=_S, refinery=_S, volume_mbd=_D)), True),
])

NETWORK_EDGES = _table(
    network_id=_S, layer=_I, src=_S, dst=_S, corridor=_S, volume=_D, effective_capacity=_D,
)

LEDGER = _table(
    event=_S, day=DateType(), status=_S, slices_read=_L, slices_total=_L, stored=_L, pulled_at=_T,
)
