"""Near duplicates: by SimHash with deletion-variant signatures, and exactly by Jaccard similarity with prefix filtering.

A fingerprint is cut into segments, fewer than the bits in which two fingerprints may differ would need for an unchanged
segment: it is enough that one segment differs by at most one bit. Each segment is indexed once for each of its bits with
that bit wiped out, so that such segments meet in an equality join, after which the whole fingerprints are compared.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from straitline.llm.common import arrow_map, ascii_lower, discard, fresh, hold_alone, release, row_key, stored
from straitline.llm.components import components

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
SEED = 42


# --- fingerprints ----------------------------------------------------------------

def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words joined by single spaces, repeats included; all words if there are fewer."""
    words = ascii_lower(text).split()
    if not words:
        return
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - size)
    a, b = starts[:last + 1].tolist(), (ends[size - 1:] if len(words) >= size else ends[-1:]).tolist()
    for k in range(0, len(a), CHUNK):
        yield np.fromiter((xxhash.xxh64_intdigest(line[x:y], seed) for x, y in zip(a[k:k + CHUNK], b[k:k + CHUNK])), np.uint64, len(a[k:k + CHUNK]))


def fingerprint(text: str | None, size: int) -> np.ndarray:
    """64 bits, each 1 if set in over half the shingles' hashes; zeros without words."""
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        n += h.size
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64)


# --- the index ------------------------------------------------------------------

def segments(columns: list[str], count: int, width: int) -> list[Column]:
    """``count`` segments of ``width`` bits of the fingerprint whose words are in ``columns``, from the lowest bit on."""
    out = []
    for s in range(count):
        word, at = divmod(s * width, 64)
        low = F.shiftrightunsigned(F.col(columns[word]), at)
        if at + width > 64:
            low = low.bitwiseOR(F.shiftleft(F.col(columns[word + 1]), 64 - at))
        out.append(low.bitwiseAND(F.lit((1 << width) - 1)))
    return out


def variants(prints: DataFrame, columns: list[str], count: int, width: int) -> DataFrame:
    """``prints`` once for each segment and wiped-out bit: ``part`` numbers segment and bit, ``value`` is what is left."""
    cut = prints.select("*", F.posexplode(F.array(*segments(columns, count, width))).alias("segment", "bits"))
    wiped = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit"))
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
    return wiped.select(*prints.columns, (F.col("segment") * width + F.col("bit")).alias("part"), F.col("bits").bitwiseAND(mask).alias("value"))


# --- exact links by Hamming distance ----------------------------------------------

def near_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """All pairs ``a, b`` of distinct 64-bit fingerprints (column ``print``) that differ in 1 to ``radius`` bits.

    radius // 2 + 1 segments suffice, since one then differs by at most one bit. A pair is kept where it first meets: at
    the first segment that differs by at most one bit, and there at that bit (at the lowest one, if the segments agree).
    A fingerprint has a bounded number of neighbours within the radius, so that links grow with the fingerprints only. Spark
    sizes the variants by the table they are exploded from, which is 64 times too low, so that the join is told not to broadcast.
    """
    count = radius // 2 + 1
    width = 64 // count
    rows = variants(prints.select("print"), ["print"], count, width)
    a, b = rows.withColumnRenamed("print", "a"), rows.withColumnRenamed("print", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    cond = (a["part"] == b["part"]) & (a["value"] == b["value"]) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius)
    for s in range(count):  # the rest of the bits, should 64 not divide evenly, only count in the distance
        own = F.shiftrightunsigned(differ, s * width).bitwiseAND(F.lit((1 << width) - 1))
        meets = (own != 0) | (a["part"] == s * width)  # what meets here agrees, or differs in the wiped-out bit alone
        before = [F.bit_count(F.shiftrightunsigned(differ, t * width).bitwiseAND(F.lit((1 << width) - 1))) > 1 for t in range(s)]
        here = functools.reduce(lambda x, y: x & y, [meets, *before])
        cond = cond & (~a["part"].between(s * width, s * width + width - 1) | here)
    return a.join(b.hint("merge"), cond).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``id, fingerprint, component_id``.

    Documents link if their 64-bit fingerprints over word shingles differ in ``radius`` bits at most; ``component_id`` is
    the smallest id reachable. Equal fingerprints are one node, so copies cost one row each and no pairs. A null or empty
    text has fingerprint zero, linked like any other; repeated rows are answered each; null ids are never smallest (a
    component of null ids only has a null ``component_id``). Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(ids, texts):
        return [ids, np.concatenate([fingerprint(t, shingle) for t in texts]).view(np.int64)]

    prints = stored(arrow_map(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`")), run, f"id {kind}, print bigint"), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("id").alias("least"))
    linked = components(near_fingerprints(nodes, radius), "a", "b")
    classes = nodes.join(linked, nodes["print"] == linked["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    named = classes.join(classes.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("print", "component_id")
    return prints.join(named, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar texts -----------------------------------------------------------------

#: Words a shingle, and the share of shared shingles (Jaccard) from which texts are near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Counters of the frequency sketch, one text in how many it reads, and the rounds that contract groups before all other pairs are met.
SLOTS, SAMPLED, ROUNDS = 1 << 20, 8, 2


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, ascending."""
    every = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)


def _needed(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` has in common with any similar set, at least."""
    return math.ceil(similarity * n - 1e-9)


def frequent_slots(texts: DataFrame, shingle: int) -> np.ndarray:
    """A count for each slot of hashes that stands out in a sample of the texts, 0 for all others.

    It only shapes the order of shingles. Any order common to all texts gives the same links.
    """
    def run(keys, ts):
        n = np.bincount(np.concatenate([shingle_set(t, shingle) for t in ts]).astype(np.int64) & SLOTS - 1, minlength=SLOTS)
        slots = np.flatnonzero(n)
        return [slots, n[slots]]

    sample = texts.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0).select("key", "text")
    counts = stored(arrow_map(sample, run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "frequent")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / SLOTS
    out = np.zeros(SLOTS, np.int32)
    for r in counts.filter(F.col("n") >= 8 + 4 * mean).toLocalIterator():
        out[r.slot] = r.n
    return out


def prefixes(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``token, key, size``: of each text the shingles that come first in a common order, rare ones before frequent ones.

    Two sets with the asked Jaccard similarity share one of these at least (prefix filter): none is missed.
    """
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_slots(texts, shingle))

    def run(keys, ts):
        hold_alone("simhash")
        tokens, counts, sizes = [np.empty(0, np.uint64)], [], []
        for t in ts:
            every = shingle_set(t, shingle)
            order = np.argsort(frequent.value[every.astype(np.int64) & SLOTS - 1], kind="stable")
            tokens.append(every[order[:every.size - _needed(every.size, similarity) + 1]])
            counts.append(tokens[-1].size)
            sizes.append(every.size)
        return [np.concatenate(tokens).view(np.int64), np.repeat(np.array(keys, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts)]

    return arrow_map(texts.select("key", "text"), run, "token long, key long, size int")


def _without_lone(batches):
    """Rows in order of their token, but for those whose token no row next to them has; a partition's first and last rows stay."""
    held, last = None, None  # the row before this batch, not yet given, and the token before it
    for batch in batches:
        rows = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks()
        token = rows.column("token").to_numpy()
        if token.size < 2:
            held = rows.to_batches()[0] if token.size else held
            continue
        same = token[1:] == token[:-1]
        keep = np.concatenate(([last is None or last == token[0]], same)) | np.concatenate((same, [False]))
        yield from rows.slice(0, token.size - 1).filter(pa.array(keep[:-1])).to_batches()
        held, last = rows.slice(token.size - 1).to_batches()[0], token[-2]
    if held is not None:
        yield held


def shared_prefixes(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The prefix rows without the shingles that only one text has, and these are most: one exchange finds them.

    Rows go by ranges of token and key, so that a token that very many texts share takes several tasks.
    """
    every = stored(prefixes(texts, shingle, similarity), "prefixes")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = every.repartitionByRange(parts, "token", "key").sortWithinPartitions("token", "key")
    shared = stored(rows.mapInArrow(_without_lone, every.schema), "shared-shingles")
    discard(every)
    return shared


#: Shingles of which a task holds sets at a time, to use them for several pairs.
HELD = 1 << 20


def _likenesses(a: list[int], b: list[int], x: list[str], y: list[str], shingle: int) -> list[float]:
    """Jaccard similarity of the texts ``x`` and ``y`` with keys ``a`` and ``b``; sets are made once for pairs that lie together."""
    sets, held, out = {}, 0, []
    for pair in zip(zip(a, x), zip(b, y)):
        for key, text in pair:
            if key not in sets:
                if held > HELD:  # the other one of this pair may go as well
                    sets, held = {}, 0
                sets[key] = shingle_set(text, shingle)
                held += sets[key].size
        one, other = (sets[key] if key in sets else shingle_set(text, shingle) for key, text in pair)
        both = np.intersect1d(one, other, assume_unique=True).size
        out.append(both / max(1, one.size + other.size - both))
    return out


def similar_links(texts: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the candidate ``pairs`` whose texts really share ``similarity`` of their shingles; ``texts``: ``key, text``.

    The texts go to their pairs, not their shingles' hashes, which are larger and do not compress.
    """
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    asked = stored(texts.join(ends, "key", "left_semi").select("key", "text"), "asked-texts")
    release(texts.sparkSession)  # all texts' way is done before that of the asked ones begins
    both = pairs.join(asked.select(F.col("key").alias("a"), F.col("text").alias("x")), "a") \
        .join(asked.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
    checked = arrow_map(both.select("a", "b", "x", "y"), lambda a, b, x, y: [a, b, _likenesses(a, b, x, y, shingle)], "a long, b long, likeness double")
    links = stored(checked.filter(F.col("likeness") >= similarity).select("a", "b"), "links")
    discard(asked)
    return links


def similar_groups(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``node, component`` of the texts (``key, text``, distinct keys) linked by Jaccard ``similarity``: exactly its components.

    Texts that share a prefix shingle meet. First, in rounds of linear size, each is held against one text of its bucket,
    and what links is contracted. Then all pairs of a bucket that are still in different groups are met, without a cap: those
    with too few prefix shingles in common cannot be similar, all others are verified.
    """
    shared = shared_prefixes(texts, shingle, similarity)
    release(texts.sparkSession)
    session = texts.sparkSession
    tested = session.createDataFrame([], "a long, b long")
    links, groups = tested, session.createDataFrame([], "node long, component long")
    alike = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9  # noqa: E731  sizes of similar sets

    def state() -> DataFrame:
        """The prefix rows with their groups so far, in buckets of several groups only."""
        rows = shared.join(groups, F.col("key") == F.col("node"), "left").select("token", "key", "size", F.coalesce("component", "key").alias("label"))
        mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
        return stored(rows.join(mixed, "token"), "open-buckets")

    def verified(pairs: DataFrame) -> None:
        nonlocal tested, links, groups
        fresh_pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        tested = tested.unionByName(fresh_pairs)
        links = links.unionByName(similar_links(texts, fresh_pairs, shingle, similarity))
        groups = stored(components(links, "a", "b"), "groups")

    for k in range(ROUNDS):
        rows = state() if k else shared.withColumn("label", F.col("key"))  # at first every text is a group of its own
        one = rows.groupBy("token").agg(F.min_by(F.struct("key", "size", "label"), F.xxhash64("key", F.lit(k))).alias("one"))
        met = rows.join(one, "token").filter((F.col("label") != F.col("one.label")) & alike(F.col("size"), F.col("one.size")))
        verified(met.select(F.least("key", "one.key").alias("a"), F.greatest("key", "one.key").alias("b")).distinct())
        if k:
            discard(rows)

    open_buckets = rows = state()
    discard(shared)
    # Rows of a bucket's largest group are not held against each other.
    largest = rows.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    rows = stored(rows.join(largest, "token").select("token", "key", "size", "label", (F.col("label") == F.col("largest")).alias("inside")), "open-rows")
    discard(open_buckets)
    x = rows.filter("not inside").select("token", *(F.col(c).alias(f"x_{c}") for c in ("key", "size", "label")))
    y = rows.select("token", *(F.col(c).alias(f"y_{c}") for c in ("key", "size", "label", "inside")))
    met = x.join(y, (x["token"] == y["token"]) & (F.col("x_label") != F.col("y_label")) & (F.col("y_inside") | (F.col("x_key") < F.col("y_key")))
                 & alike(F.col("x_size"), F.col("y_size")))
    common = met.groupBy(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).agg(
        F.count("*").alias("n"), F.first(F.col("x_size") + F.col("y_size")).alias("sizes"), F.first(F.greatest("x_size", "y_size")).alias("most"))
    # Beyond the prefixes two sets share less than ``similarity`` of the larger one.
    enough = F.col("n") + F.ceil(similarity * F.col("most") - 1e-9) - 1 >= similarity / (1 + similarity) * F.col("sizes") - 1e-9
    verified(common.filter(enough).select("a", "b"))
    discard(rows)
    return groups


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document left of each group of copies and near copies: the one with the smallest id.

    Texts are compared as lower-cased words. Equal ones are one node; others link if their shingle sets have the asked
    Jaccard similarity, of which no pair is missed, and groups are connected components. Texts without words (null, empty,
    blank) are copies of each other. Null ids come last; of repeated rows one stays. All columns pass through, whatever
    their names.
    """
    row = fresh("row", docs)

    def run(rows, ids, texts):
        return [rows, ids, [xxhash.xxh3_64_intdigest(b" ".join(ascii_lower(t).split())) - (1 << 63) for t in texts]]

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = stored(arrow_map(docs.select(row_key(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`")), run,
                             f"row long, id {kind}, key long"), "text-keys")
    nodes = stored(keyed.groupBy("key").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("row")), "distinct-texts")
    texts = docs.select(row_key(docs).alias("row"), F.col(f"`{text}`").alias("text")).join(nodes, "row").dropDuplicates(["key"]).select("key", "text")
    texts = stored(texts, "texts")
    release(docs.sparkSession)
    linked = similar_groups(texts, shingle, similarity)
    discard(texts)
    classes = keyed.join(linked, F.col("key") == F.col("node"), "left")
    stay = classes.groupBy(F.coalesce("component", "key").alias("component")).agg(
        F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias(row)).select(row)
    return docs.withColumn(row, row_key(docs)).join(stay, row, "left_semi").dropDuplicates([row]).select(*(f"`{c}`" for c in docs.columns))
