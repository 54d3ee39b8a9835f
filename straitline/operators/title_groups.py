"""Headlines that can share a story: components of the similarity of titles within one key.

The story rule of a key is order dependent, but an event can only join the story of a headline that is linked to its own
by a chain of similar headlines. Components of that relation can therefore be settled apart from each other, all at once.
Only distinct titles meet, and only those that occur within neighbouring story windows; what leaves a block of titles is a
spanning forest of its links, never its pairs, so that a dense family of headlines stays linear.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from straitline.functions.similarity import SimilarPairs, WINDOW_MICROS
from straitline.session import checkpointed

TILE = 2000  # titles of a tile; a block is a pair of tiles
LINKS = 1_000_000  # links of a key that one task joins up (16 MB)


def _meeting(rows: pd.DataFrame, count: int) -> np.ndarray:
    """Which of the ``count`` titles of a block one key has within neighbouring windows; its ``rows`` have code and windows."""
    size = rows["windows"].str.len().to_numpy()
    windows, column = np.unique(np.concatenate(rows["windows"].to_numpy()), return_inverse=True)
    where = np.repeat(rows["code"].to_numpy(), size)
    here = np.zeros((count, len(windows)), np.float32)
    here[where, column] = 1
    around = here.copy()
    for c in np.flatnonzero(np.diff(windows) == 1):
        around[:, c] += here[:, c + 1]
        around[:, c + 1] += here[:, c]
    return (here @ around.T) > 0


def _compared(block: pd.DataFrame, found_of) -> pd.DataFrame:
    """``found_of`` the pairs of titles of one pair of tiles that each key has; a pair of titles is compared once for all keys."""
    titles, block["code"] = np.unique(block["norm"].to_numpy(dtype=object), return_inverse=True)
    left, right, tile = (block[c].iloc[0] if c != "tile" else block[c].to_numpy() for c in ("left", "right", "tile"))
    keys = [(key, rows) for key, rows in block.groupby("story_key", sort=False)]
    # Within a tile each pair once; of two tiles only pairs across, since the others meet in their own block.
    asked = np.zeros((len(titles), len(titles)), bool)
    for _, rows in keys:
        asked |= _meeting(rows, len(titles))
    if left != right:
        own = np.zeros(len(titles), bool)
        own[block["code"].to_numpy()[tile == left]] = True
        asked &= own[:, None] & ~own[None, :]
    else:
        asked = np.triu(asked, 1)
    compared = SimilarPairs(titles.tolist(), *np.nonzero(asked))
    found = []
    for key, rows in keys:
        tid = np.zeros(len(titles), np.int64)
        tid[rows["code"].to_numpy()] = rows["tid"].to_numpy()
        meets = _meeting(rows, len(titles)) if len(keys) > 1 else asked
        found += [(key, tid[a], tid[b]) for a, b in found_of(compared, meets[compared.rows, compared.cols])]
    return pd.DataFrame(found, columns=["story_key", "a", "b"])


def _forest(block: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest, for every key, of the similar titles of one pair of tiles."""
    return _compared(block, SimilarPairs.forest)


def _ordered(block: pd.DataFrame) -> pd.DataFrame:
    """All pairs of similar titles of one pair of tiles, the later one first: similarity depends on the order."""
    return _compared(block, SimilarPairs.ordered)


def title_links(titled: DataFrame) -> DataFrame:
    """``story_key, a, b``: links that connect each component of similar titles; a title is named by ``tid``."""
    return _in_blocks(titled, _forest).distinct()


def similar_pairs(titled: DataFrame) -> DataFrame:
    """``story_key, a, b``: every pair of titles (``tid``) that meet and of which ``a`` resembles the earlier ``b``."""
    return _in_blocks(titled, _ordered)


def _in_blocks(titled: DataFrame, work) -> DataFrame:
    """What ``work`` finds in each pair of tiles of titles that meet.

    ``titled`` has story_key, tid, norm and at. Titles that a key has in the same story window or in neighbouring ones meet.
    A title belongs to a tile of bounded size, by the window that saw it first, whatever its key; every pair of tiles that some
    key has in neighbouring windows is one task's block, so that two titles are compared once however many keys and windows have
    both.
    """
    seen = titled.select("story_key", "tid", "norm", F.floor(F.col("at") / WINDOW_MICROS).alias("window"))
    rows = seen.groupBy("story_key", "tid", "norm").agg(F.collect_set("window").alias("windows"))  # as many as the events span
    first = seen.groupBy("norm").agg(F.min("window").alias("since"))
    sizes = first.groupBy("since").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    tiles = first.join(sizes, "since").select("norm", F.concat_ws(
        ":", "since", F.pmod(F.xxhash64("norm"), F.col("tiles"))).alias("tile"))
    rows = checkpointed(rows.join(tiles, "norm"))
    held = rows.select("story_key", "tile", F.explode("windows").alias("window")).distinct()
    near = held.withColumn("window", F.explode(F.array(*[F.col("window") + d for d in (-1, 0, 1)])))
    partners = held.join(near.withColumnRenamed("tile", "other"), ["story_key", "window"]).select("story_key", "tile", "other").distinct()
    blocks = rows.join(partners, ["story_key", "tile"]).select(
        F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "story_key", "tid", "norm", "windows")
    parts = int(titled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "left", "right").groupBy("left", "right").applyInPandas(work, "story_key string, a long, b long")


def _roots(links: pd.DataFrame) -> pd.DataFrame:
    """The smallest title of each component of one key, by union-find."""
    root: dict[int, int] = {}

    def find(i):
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up] if up in root else up
        return i

    for a, b in zip(links["a"].tolist(), links["b"].tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    tids = list(root)
    return pd.DataFrame({"story_key": links["story_key"].iloc[0], "tid": tids, "root": [find(i) for i in tids]})


def smallest_members(links: DataFrame) -> DataFrame:
    """``story_key, tid, root``: of each linked title the smallest one of its component.

    Keys of at most ``LINKS`` links are a task each; larger ones are contracted by all tasks together.
    """
    links = checkpointed(links)
    large = links.groupBy("story_key").agg(F.count("*").alias("n")).filter(F.col("n") > LINKS).select("story_key")
    kind = "story_key string, tid long, root long"
    if large.isEmpty():
        return links.groupBy("story_key").applyInPandas(_roots, kind)
    return links.join(large, "story_key", "left_anti").groupBy("story_key").applyInPandas(_roots, kind).unionByName(
        _contracted(links.join(large, "story_key", "left_semi")))


def _contracted(links: DataFrame) -> DataFrame:
    """The same for keys of any size.

    Each round points every title to the smallest title next to it, and links what lay around it to that one; rounds follow the
    logarithm of a component's size. Only the links of a round are kept.
    """
    links = checkpointed(links.select("story_key", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # Larger neighbours go to the smallest one around a title, itself included.
        around = links.unionByName(links.select("story_key", F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("story_key", "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        wide = around.filter("b > a").join(least, ["story_key", "a"]).select("story_key", F.col("b").alias("a"), F.col("low").alias("b"))
        # Then each title and its smaller neighbours go to the smallest of them.
        low = wide.groupBy("story_key", "a").agg(F.min("b").alias("low"))
        pairs = wide.join(low, ["story_key", "a"])
        near = pairs.select("story_key", "b", "low").union(low.select("story_key", "a", "low")).toDF("story_key", "a", "b").filter("a <> b").distinct()
        now = checkpointed(near)
        if now.count() == links.count() and now.exceptAll(links).isEmpty():
            return now.select("story_key", F.col("a").alias("tid"), F.col("b").alias("root")).unionByName(
                now.select("story_key", F.col("b").alias("tid"), F.col("b").alias("root")).distinct())
        links = now


def split_keys(titled: DataFrame) -> DataFrame:
    """``titled`` (story_key, event_id, at, norm) with ``part`` and ``tid``: the component of an event's title within its key, and the title."""
    named = titled.groupBy("story_key", "norm").agg(F.min("event_id").alias("tid"))
    rows = checkpointed(titled.join(named, ["story_key", "norm"]))
    roots = smallest_members(title_links(rows))
    return rows.join(roots, ["story_key", "tid"], "left").select("story_key", "event_id", "at", "norm", "tid", F.coalesce("root", "tid").alias("part"))
