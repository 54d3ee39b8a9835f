"""Ranked search by words: sums of short lists first, then document by document over the long ones.

Documents are indexed in shards of consecutive rows: terms, and for each term the documents that hold it with their counts.
A query's short lists in a shard are added up to accumulators (term at a time); these count as one more list with a known
largest value, next to the long lists, over which documents are met in order (document at a time): lists that cannot lift a
document over the k-th best score so far are only looked up, by skipping, for documents that other lists bring up.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from straitline.llm.common import ascii_lower, stored

TOP = 10
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Lists of at most so many documents of a shard are added up at once.
SHORT = 256
#: Pairs of query and term that one pass over the index answers. More queries take more passes.
TERMS_A_PASS = 1 << 17
#: Bytes of text that are words at a time.
STRETCH = 1 << 20

#: Bytes of words as they are (after A-Z are lower-cased), all others as blanks.
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in stretches that end between words."""
    raw, at = ascii_lower(text).translate(_BLANKED), 0
    while at < len(raw):
        end = raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


# --- index ----------------------------------------------------------------------------

_INDEX = "ids array<long>, lengths binary, terms binary, starts binary, docs binary, counts binary, n_docs long, n_terms long"


class _Shard:
    """Documents being gathered: their ids and, as term numbers, their words."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.words, self.bytes = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        parts = [np.fromiter(map(self.number.__getitem__, w), np.int32, len(w)) for w in words(text)]
        own = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if own.size:
            self.ids.append(doc_id)
            self.words.append(own)
            self.bytes += len(text)

    def rows(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))  # null ids last, as ties go
        lengths = np.array([self.words[i].size for i in order], np.int64)
        pairs, counts = np.unique(np.concatenate([self.words[i] for i in order]).astype(np.int64) * len(order)
                                  + np.repeat(np.arange(len(order)), lengths), return_counts=True)
        terms, docs = np.divmod(pairs, len(order))
        starts = np.searchsorted(terms, np.arange(len(self.number) + 1))
        values = [[self.ids[i] for i in order], lengths.tobytes(), b" ".join(self.number), starts.astype(np.int64).tobytes(),
                  docs.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), len(order), int(lengths.sum())]
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A stored index of all terms of all documents; one row a shard. Documents without a term are in no shard."""
    def run(batches):
        shard = _Shard()
        for batch in batches:
            for at in range(batch.num_rows):
                shard.add(batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
                if shard.bytes >= shard_bytes:
                    yield shard.rows()
                    shard = _Shard()
        if shard.ids:
            yield shard.rows()

    return stored(docs.select(F.col(f"`{id_col}`").cast("long"), f"`{text}`").mapInArrow(run, _INDEX), "lexical-index")


def _places(terms: bytes, wanted) -> dict[bytes, int]:
    """Numbers of the wanted terms that a shard knows."""
    return {t: i for i, t in enumerate(terms.split(b" ")) if t in wanted}


def _document_counts(index: DataFrame, wanted: frozenset) -> dict[bytes, int]:
    """In how many documents each wanted term occurs; summed by shard, then over shards."""
    def run(batches):
        for b in batches:
            for terms, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = _places(terms, wanted)
                n = np.diff(np.frombuffer(starts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.binary()), pa.array([int(n[i]) for i in at.values()], pa.int64())],
                                                 names=["term", "n"])

    found = index.select("terms", "starts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in found.collect()}  # of the terms of one pass


# --- search of one shard ----------------------------------------------------------------

def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of several lists in order, with the sums of their values."""
    docs, values = np.concatenate([d for d, _ in lists]), np.concatenate([v for _, v in lists])
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[first], np.add.reduceat(values, first)


def best(lists: list[tuple[np.ndarray, np.ndarray]], k: int = TOP, short: int = SHORT) -> list[tuple[int, int]]:
    """(score, document) of the ``k`` best sums over lists of (documents in order, values), higher first, then earlier documents."""
    summed = [x for x in lists if len(x[0]) <= short]
    long = [(d, v, int(v.max())) for d, v in lists if len(d) > short]
    floor = 0
    if summed:
        docs, values = accumulate(summed)
        if len(values) > k:
            # Sums only grow: the k-th best of them is reached in the end. A document must beat the floor, so it stays one below.
            floor = max(0, int(np.partition(values, -k)[-k]) - 1)
            open_ = values + sum(bound for _, _, bound in long) > floor
            docs, values = docs[open_], values[open_]
        if len(docs):
            long.append((docs, values, int(values.max())))
    long.sort(key=lambda x: x[2])
    ids, points = [d.tolist() for d, _, _ in long], [v.tolist() for _, v, _ in long]
    reach = np.cumsum([bound for _, _, bound in long]).tolist()  # most that a list and those before it can add
    at, first, heap = [0] * len(long), 0, []
    while True:
        while first < len(long) and reach[first] <= floor:
            first += 1
        current = [ids[i][at[i]] for i in range(first, len(long)) if at[i] < len(ids[i])]
        if not current:
            return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))
        doc, score = min(current), 0
        for i in range(first, len(long)):
            if at[i] < len(ids[i]) and ids[i][at[i]] == doc:
                score += points[i][at[i]]
                at[i] += 1
        for i in range(first - 1, -1, -1):
            if score + reach[i] <= floor:
                break
            at[i] = bisect_left(ids[i], doc, at[i])
            if at[i] < len(ids[i]) and ids[i][at[i]] == doc:
                score += points[i][at[i]]
        if score > floor:
            if len(heap) < k:
                heapq.heappush(heap, (score, -doc))
            else:
                heapq.heapreplace(heap, (score, -doc))
            if len(heap) == k:
                floor = max(floor, heap[0][0])


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L of each document."""
    if 90 * int(lengths.max()) * n_docs < 1 << 63:
        return 10 + 90 * lengths * n_docs // n_terms
    return np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


def _search(index: DataFrame, items: list[tuple], weights: dict[bytes, int], n_docs: int, n_terms: int, kind: str, k: int) -> DataFrame:
    """The ``k`` best documents of each shard for each item."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                at, starts = _places(row["terms"], weights), np.frombuffer(row["starts"], np.int64)
                docs, counts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
                damping = _damping(np.frombuffer(row["lengths"], np.int64), n_docs, n_terms)
                lists = {}
                for term, i in at.items():
                    a, z = starts[i], starts[i + 1]
                    tf = counts[a:z]
                    lists[term] = docs[a:z], weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * damping[docs[a:z]]))
                hits = [(item, row["ids"][doc], score) for item, terms in items
                        if (own := [lists[t] for t in terms if t in lists]) for score, doc in best(own, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[j] for h in hits], t) for j, t in enumerate((id_type, pa.int64(), pa.int64()))], names=["item_id", "doc_id", "score"])

    id_type = to_arrow_schema(StructType.fromDDL(f"item_id {kind}")).field(0).type
    return index.select("ids", "lengths", "terms", "starts", "docs", "counts").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0, equal scores by ascending id.

    Null and empty texts have no terms; such documents do not count and such items have no rows. Rows of one item id (null too)
    are one item, with the terms of all its texts. Repeated documents are ranked each; null ids come last among equal scores.
    Other columns are not read. Items go in passes of a bounded number of terms over one index; with a few thousand items
    there is one pass.
    """
    index = build_index(docs, id_col, text)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    kind = items.schema[item_col].dataType.simpleString()

    def terms_of(batches):
        for b in batches:
            for at in range(b.num_rows):
                own = sorted({w for part in words(b.column(1)[at].as_py()) for w in part})
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[at].as_py()] * len(own), b.schema.field(0).type), pa.array(own, pa.binary())],
                                                 names=["item_id", "term"])

    wanted = items.select(F.col(f"`{item_col}`"), f"`{item_text}`").mapInArrow(terms_of, f"item_id {kind}, term binary") \
        .groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    wanted = stored(wanted, "lexical-items")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = math.ceil(total / TERMS_A_PASS)
    found = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for turn in range(passes if n_docs else 0):
        own = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).collect()
        asked = [(r.item_id, [bytes(t) for t in r.terms]) for r in own]
        counts = _document_counts(index, frozenset(t for _, ts in asked for t in ts))
        weights = {t: w for t, df in counts.items() if (w := term_weight(n_docs, df)) > 0}
        found = found.unionByName(_search(index, asked, weights, n_docs, n_terms, kind, k))
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
