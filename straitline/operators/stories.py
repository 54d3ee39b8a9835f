"""Near-duplicate headlines to stories.

An event joins the earliest story of its corridor whose first headline resembles its own and
is at most three days older; otherwise it founds a story. The rule is order dependent. A key with
many events is first split into components of similar titles, which no story crosses (see
``title_groups``); the rule is then resolved in rounds. Each round takes the next ``batch`` undecided events of every key
(a bounded group), settles them among themselves, and matches the founders found against the
later undecided events inside the window. The later events are split into bounded chunks, so
a corridor that holds a third of all rows is spread over many tasks and no pair is ever
emitted: an event leaves a chunk with at most one founder. Copies of a settled headline are
all settled in the same round. A component of many events but few titles is settled title by title, without rounds; so is one of
many titles, if all its pairs of similar titles, found block by block in many tasks, are few enough for the task that settles it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from straitline import constants as K
from straitline.functions.scoring import event_weight
from straitline.functions.similarity import WINDOW_MICROS, first_leaders, first_titles, resolve_batch, resolve_near, resolve_titles
from straitline.functions.text import normalize_title
from straitline.operators.title_groups import similar_pairs, split_keys
from straitline.session import checkpointed

BATCH = 2000  # events settled per corridor and round, and founders a chunk meets
CHUNK = 1000  # later events per chunk
TITLES, EVENTS = 2000, 2_000_000  # distinct titles and events (some 100 bytes each) of a component that one task settles by titles
PAIRS = 10_000_000  # ordered pairs of similar titles (16 bytes each) up to which a component of more titles is settled by them


def _with_key(events: DataFrame, keys: tuple) -> DataFrame:
    """One text key per group of stories; key parts cannot run into each other."""
    return events.withColumn("story_key", F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))


def _titled(events: DataFrame, keys: tuple) -> DataFrame:
    return _with_key(events, keys).select(
        "story_key", "event_id", F.unix_micros("ts").alias("at"), normalize_title(F.col("title")).alias("norm"))


_SETTLED = StructType([
    StructField("story_key", StringType()), StructField("event_id", LongType()),
    StructField("at", LongType()), StructField("norm", StringType()),
    StructField("story_id", LongType()),
])


def _settle(batch: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values(["at", "event_id"], ignore_index=True)
    leader = resolve_batch(batch["at"].to_numpy(), batch["norm"].tolist())
    batch["story_id"] = batch["event_id"].to_numpy()[leader]
    return batch[["story_key", "event_id", "at", "norm", "story_id"]]


def _match_chunk(rows: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
    rows = rows[["story_key", "event_id", "at", "norm"]].reset_index(drop=True)
    if rows.empty or leaders.empty:
        return rows.assign(story_id=pd.Series([pd.NA] * len(rows), dtype="Int64"))
    leaders = leaders.sort_values(["at", "event_id"], ignore_index=True)
    hit = first_leaders(rows["at"].to_numpy(), rows["norm"].tolist(),
                        leaders["at"].to_numpy(), leaders["norm"].tolist())
    ids = pd.Series(leaders["event_id"].to_numpy()[np.maximum(hit, 0)], dtype="Int64")
    return rows.assign(story_id=ids.mask(hit < 0))


def _chunked_match(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """Earliest matching leader of every row (null if none), in chunks of bounded size.

    Leaders per key are at most one batch, so each chunk sees at most CHUNK rows and BATCH leaders.
    """
    sizes = rows.groupBy("story_key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    left = rows.join(sizes, "story_key").withColumn(
        "chunk", F.pmod(F.xxhash64("event_id"), F.col("chunks")).cast("int")).drop("chunks")
    right = leaders.join(sizes, "story_key").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    group = ["story_key", "chunk"]
    return _spread(left, *group).groupBy(group).cogroup(_spread(right, *group).groupBy(group)).applyInPandas(
        _match_chunk, _SETTLED)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions of a fixed number: small in bytes but heavy in work, so never coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def match_stored_leaders(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """Earliest matching leader of every row (null if none) among any number of leaders per key.

    Rows and leaders (story_key, event_id, at, norm) are both cut into bounded chunks; every pair of
    chunks reports at most one leader per row and the earliest of those wins.
    """
    sized = leaders.groupBy("story_key").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("parts"))
    cut = leaders.join(sized, "story_key").withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int"))
    keyed = lambda df: df.withColumn("story_key", F.concat_ws("#", "part", "story_key"))
    spread = rows.join(sized, "story_key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["story_key", "event_id", "at", "norm"]
    found = _chunked_match(keyed(spread).select(columns), keyed(cut).select(columns)).filter("story_id IS NOT NULL") \
        .withColumn("story_key", F.regexp_replace("story_key", "^[0-9]+#", ""))
    at = leaders.select("story_key", F.col("event_id").alias("story_id"), F.col("at").alias("leader_at"))
    best = found.join(at, ["story_key", "story_id"]).groupBy("story_key", "event_id").agg(
        F.min(F.struct("leader_at", "story_id")).alias("b")).select("story_key", "event_id", F.col("b.story_id").alias("story_id"))
    return rows.select(columns).join(best, ["story_key", "event_id"], "left")


def _settled_in_rounds(pending: DataFrame, batch: int) -> list[DataFrame]:
    """(story_key, event_id, story_id) of all events, a table a round: as many rounds as the largest key has batches."""
    parts, order = [], W.partitionBy("story_key").orderBy("at", "event_id")
    while not pending.isEmpty():
        head = pending.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= batch).drop("place")
        settled = checkpointed(_spread(head, "story_key").groupBy("story_key").applyInPandas(_settle, _SETTLED))
        parts.append(settled.select("story_key", "event_id", "story_id"))
        leaders = settled.filter("story_id = event_id").select("story_key", "event_id", "at", "norm")
        reach = settled.groupBy("story_key").agg(
            F.max(F.struct("at", "event_id")).alias("front"), F.count("*").alias("taken"),
            F.max(F.when(F.col("story_id") == F.col("event_id"), F.col("at"))).alias("last_leader"),
        ).filter(F.col("taken") == batch)
        rest = pending.join(reach, "story_key").filter(F.struct("at", "event_id") > F.col("front"))
        near = F.col("at") <= F.coalesce(F.col("last_leader"), F.lit(-(2 ** 62))) + WINDOW_MICROS
        columns = ["story_key", "event_id", "at", "norm"]
        rest = checkpointed(rest.withColumn("near", near).select(*columns, "near"))
        if rest.isEmpty():
            break
        matched = checkpointed(_chunked_match(rest.filter("near").select(columns), leaders))
        parts.append(matched.filter("story_id is not null").select("story_key", "event_id", "story_id"))
        pending = checkpointed(
            rest.filter("not near").select(columns).unionByName(matched.filter("story_id is null").select(columns)))
    return parts


def _settle_titles(rows: pa.Table) -> pa.Table:
    """Stories of the events of one component, by its distinct titles."""
    rows = rows.take(pc.sort_indices(rows, [("at", "ascending"), ("event_id", "ascending")]))
    norm = rows.column("norm").combine_chunks().dictionary_encode()
    leader = resolve_titles(rows.column("at").to_numpy(), norm.indices.to_numpy(), norm.dictionary.to_pylist())
    return rows.select(["story_key", "event_id"]).append_column("story_id", rows.column("event_id").take(pa.array(leader)))


def _settle_linked(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Stories of the events of one component, by the pairs of its similar titles."""
    rows = rows.take(pc.sort_indices(rows, [("at", "ascending"), ("event_id", "ascending")]))
    tids, code = np.unique(rows.column("tid").to_numpy(), return_inverse=True)
    later, earlier = (np.searchsorted(tids, pairs.column(c).to_numpy()) for c in ("a", "b"))
    order = np.argsort(earlier, kind="stable")
    later, bounds = later[order], np.searchsorted(earlier[order], np.arange(len(tids) + 1))
    leader = resolve_near(rows.column("at").to_numpy(), code, len(tids), lambda t: np.append(later[bounds[t]:bounds[t + 1]], t))
    return rows.select(["story_key", "event_id"]).append_column("story_id", rows.column("event_id").take(pa.array(leader)))


def assign_stories(events: DataFrame, keys: tuple = ("corridor",), batch: int = BATCH) -> DataFrame:
    """(story_key, event_id, story_id) of every event; story_id is the founding event's id.

    ``events`` needs the key columns, event_id (unique within a key), ts and title. A key of more events than a batch is split
    into the components of its similar titles first, which are settled side by side: rounds follow the largest component that is
    settled neither by its titles nor by its pairs of similar titles. A component of one event founds its story without being looked at.
    """
    titled = checkpointed(_titled(events, keys))
    founds = lambda df: df.select("story_key", "event_id", F.col("event_id").alias("story_id"))
    pending = titled.filter("norm <> ''")
    big = pending.groupBy("story_key").agg(F.count("*").alias("n")).filter(F.col("n") > batch)
    parts = [founds(titled.filter("norm = ''"))]
    if big.isEmpty():
        return reduce(DataFrame.unionByName, parts + _settled_in_rounds(pending, batch))
    split = split_keys(pending.join(big.select("story_key"), "story_key", "left_semi"))
    sizes = split.groupBy("story_key", "part").agg(F.count("*").alias("n"), F.approx_count_distinct("norm").alias("titles"))
    sized = checkpointed(split.join(sizes, ["story_key", "part"]))
    parts.append(founds(sized.filter("n = 1")))
    named = lambda df, part: df.select(F.concat(part, F.lit("#"), "story_key").alias("story_key"), "event_id", "at", "norm")
    small = pending.join(big.select("story_key"), "story_key", "left_anti")
    whole = (F.col("n") > batch) & (F.col("n") <= EVENTS)
    hot = whole & (F.col("titles") <= TITLES)
    part = F.col("part").cast("string")
    wide = sized.filter(whole & ~hot).select(F.concat(part, F.lit("#"), "story_key").alias("story_key"), "event_id", "at", "norm", "tid")
    rest = named(sized.filter((F.col("n") > 1) & ~whole), part).unionByName(named(small, F.lit("")))
    if not wide.isEmpty():
        pairs = checkpointed(similar_pairs(wide))
        dense = pairs.groupBy("story_key").agg(F.count("*").alias("pairs")).filter(F.col("pairs") > PAIRS).select("story_key")
        rest = rest.unionByName(wide.join(dense, "story_key", "left_semi").drop("tid"))
        left = wide.join(dense, "story_key", "left_anti").select("story_key", "event_id", "at", "tid")
        right = pairs.join(dense, "story_key", "left_anti")
        parts.append(checkpointed(_spread(left, "story_key").groupBy("story_key").cogroup(_spread(right, "story_key").groupBy("story_key")).applyInArrow(
            _settle_linked, "story_key string, event_id long, story_id long")).withColumn("story_key", F.regexp_replace("story_key", "^-?[0-9]*#", "")))
    rest = checkpointed(rest)
    by_titles = checkpointed(_spread(named(sized.filter(hot), part), "story_key").groupBy("story_key").applyInArrow(
        _settle_titles, "story_key string, event_id long, story_id long"))
    return reduce(DataFrame.unionByName, parts + [
        done.withColumn("story_key", F.regexp_replace("story_key", "^-?[0-9]*#", "")) for done in [by_titles, *_settled_in_rounds(rest, batch)]])


def cluster_stories(events: DataFrame, keys: tuple = ("corridor",), batch: int = BATCH) -> DataFrame:
    """The events with their ``story_id``."""
    settled = assign_stories(events, keys, batch)
    return _with_key(events, keys).join(settled, ["story_key", "event_id"]).drop("story_key")


def strongest_members(clustered: DataFrame, now: Column, keys: tuple = ("corridor",)) -> DataFrame:
    """One row per story: its strongest member (earliest on ties), its weight, and the member count."""
    weight = event_weight(F.col("severity"), F.col("confidence"), F.col("ts"), now)
    rank = F.struct(
        weight.alias("weight"), (-F.unix_micros("ts")).alias("early"), (-F.col("event_id")).alias("low"),
        F.col("severity").alias("severity"), F.col("confidence").alias("confidence"),
        F.col("ts").alias("ts"), F.col("title").alias("title"))
    return (
        clustered.groupBy(*keys, "story_id")
        .agg(F.max(rank).alias("best"), F.count("*").alias("members"))
        .select(*keys, "story_id", "best.weight", "best.severity", "best.confidence", "best.ts", "best.title", "members")
    )


def build_stories(events: DataFrame, now: Column, keys: tuple = ("corridor",)) -> DataFrame:
    """Events to stories in one call."""
    return strongest_members(cluster_stories(events, keys), now, keys)


def syndication(clustered: DataFrame, keys: tuple = ("corridor",)) -> DataFrame:
    """Events per story and the biggest story of each corridor."""
    per_story = clustered.groupBy(*keys, "story_id").agg(F.count("*").alias("members"))
    return per_story.groupBy(*keys).agg(
        F.sum("members").alias("events"), F.count("*").alias("stories"),
        F.max("members").alias("biggest_story"),
        (F.sum("members") / F.count("*")).alias("ratio"))


TILE = 2000  # titles of a tile
SLICE = 100_000  # events of a key and window that one task looks back for


def _first_similar_tile(later: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
    """Earliest similar earlier event of each row of one cell: two titles are compared once, and only as far as some event asks."""
    empty = pd.DataFrame({"story_key": [], "event_id": [], "match_at": [], "match_id": []}, dtype=object)
    if later.empty or earlier.empty:
        return empty
    earlier = earlier.rename(columns=lambda c: c.removeprefix("e_")).sort_values(["at", "event_id"], ignore_index=True)
    at, ids = earlier["at"].to_numpy(), earlier["event_id"].to_numpy()
    titles, code = np.unique(earlier["norm"].to_numpy(dtype=object), return_inverse=True)
    found = []
    asked = later.groupby("norm", sort=False).indices
    near = first_titles(list(asked), titles.tolist())
    their_at, their_id = later["at"].to_numpy(), later["event_id"].to_numpy()
    for (maybe, similar), rows in zip(near, asked.values()):
        mine, own = their_at[rows], their_id[rows]
        place, sure = np.flatnonzero(maybe[code]), set()
        while True:  # each round settles titles for good: one that is not similar leaves with all its events
            first = np.searchsorted(at[place], mine - WINDOW_MICROS, side="left")
            inside = first < len(place)
            new = [t for t in np.unique(code[place[first[inside]]]).tolist() if t not in sure]
            wrong = [t for t in new if not similar(t)]
            sure.update(new)
            if not wrong:
                break
            place = place[~np.isin(code[place], wrong)]
        hit, mine, own = place[first[inside]], mine[inside], own[inside]
        before = (at[hit] < mine) | ((at[hit] == mine) & (ids[hit] < own))
        found.append((own[before], at[hit][before], ids[hit][before]))
    if not found:
        return empty
    event_id, match_at, match_id = (np.concatenate(c) for c in zip(*found))
    key = np.full(len(event_id), later["story_key"].iloc[0], dtype=object)
    return pd.DataFrame({"story_key": key, "event_id": event_id, "match_at": match_at, "match_id": match_id})


def similar_titles(events: DataFrame, keys: tuple = ("corridor",)) -> DataFrame:
    """Earliest earlier event within the window whose title resembles the event's own.

    Time is cut into story windows, and those of a key with many events into slices. An event looks back on all events of the
    slice one window before its own, and of the slices in between only on the first of each title: what a cell reads follows
    its own events and the distinct titles. Titles are dealt into tiles of bounded size, and cells meet tile by tile; a cell
    reports at most one row per event, so dense copies stay linear.
    """
    rows = checkpointed(_titled(events, keys).filter("norm <> ''").withColumn("bucket", F.floor(F.col("at") / WINDOW_MICROS)))
    sizes = rows.groupBy("story_key", "bucket").agg(F.count("*").alias("n"), F.approx_count_distinct("norm").alias("titles")) \
        .groupBy("story_key").agg(F.ceil(F.max("n") / SLICE).cast("int").alias("slices"), F.ceil(F.max("titles") / TILE).cast("int").alias("tiles"))
    placed = rows.join(sizes, "story_key").withColumn("slice", F.floor(
        (F.col("at") - F.col("bucket") * WINDOW_MICROS) * F.col("slices") / WINDOW_MICROS).cast("int")) \
        .withColumn("tile", F.pmod(F.xxhash64("norm"), F.col("tiles")).cast("int"))
    columns = ["story_key", "bucket", "slice", "tile", "earlier_tile", "event_id", "at", "norm"]
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    later = placed.withColumn("earlier_tile", every)
    full = placed.withColumn("bucket", F.col("bucket") + 1)
    firsts = placed.groupBy("story_key", "bucket", "slice", "slices", "tile", "tiles", "norm").agg(
        F.min(F.struct("at", "event_id")).alias("first")).select("*", "first.at", "first.event_id")
    same = firsts.withColumn("slice", F.explode(F.sequence("slice", F.col("slices") - 1)))
    after = firsts.filter("slice > 0").withColumn("bucket", F.col("bucket") + 1).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slice") - 1)))
    seen = ["story_key", "bucket", "slice", "tile", "tiles", "event_id", "at", "norm"]
    earlier = full.select(seen).unionByName(same.select(seen)).unionByName(after.select(seen)) \
        .withColumnRenamed("tile", "earlier_tile").withColumn("tile", every)
    group = ["story_key", "bucket", "slice", "tile", "earlier_tile"]
    # Both sides read the same rows: fresh aliases keep the two apart.
    right = earlier.select([F.col(c).alias(f"e_{c}") for c in columns])
    found = _spread(later.select(columns), *group).groupBy(group).cogroup(
        _spread(right, *[f"e_{c}" for c in group]).groupBy([f"e_{c}" for c in group])
    ).applyInPandas(_first_similar_tile, "story_key string, event_id long, match_at long, match_id long")
    best = found.groupBy("story_key", "event_id").agg(F.min(F.struct("match_at", "match_id")).alias("m"))
    return (
        _with_key(events, keys).join(best, ["story_key", "event_id"])
        .select(*keys, "event_id", F.col("m.match_id").alias("similar_id"))
    )
