"""Bounded-space online packing of documents into sequences of a fixed number of tokens.

Each partition keeps a fixed number of open windows. What is left of a document after its full sequences goes, best fit,
into one of them; when none has room, the fullest is topped up with the head of the piece and emitted, and the tail opens
a new window. The windows still open at the end of all partitions are merged.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from straitline.llm.common import ROWS, stored, tokenizer_path
from straitline.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END = 0
LENGTH = 1024
OPEN_WINDOWS = 64
#: Partitions whose open windows are merged together, and pieces that go out at a time.
MERGED, BATCH = 64, 2000

#: Ids of sequences: the partition in the high bits; merged ones lie above all others.
PARTITION_BITS, MERGED_FROM = 36, 1 << 61


class Packer:
    """Open windows of one partition; a window is a list of (document's columns, start, token bytes)."""

    def __init__(self, length: int, windows: int):
        self.length, self.most = length, windows
        self.free: list[tuple[int, int]] = []  # free tokens and number of each open window, least free first
        self.held: dict[int, list] = {}
        self.opened = 0

    def _add(self, free: int, window: int, piece: tuple) -> list | None:
        """Put a piece into a window that has room; the window's pieces once it is full."""
        self.held[window].append(piece)
        free -= len(piece[2]) // 4
        if free:
            insort(self.free, (free, window))
            return None
        return self.held.pop(window)

    def _open(self, piece: tuple) -> list | None:
        self.opened += 1
        self.held[self.opened] = []
        return self._add(self.length, self.opened, piece)

    def put(self, doc: tuple, ids: bytes) -> Iterator[list]:
        """Place a document; full sequences come out."""
        step, at = 4 * self.length, 0
        while len(ids) - at >= step:
            yield [(doc, at // 4, ids[at:at + step])]
            at += step
        if at == len(ids):
            return
        piece = (doc, at // 4, ids[at:])
        k = bisect_left(self.free, (len(piece[2]) // 4, 0))
        if k < len(self.free):
            full = self._add(*self.free.pop(k), piece)
        elif len(self.free) < self.most:
            full = self._open(piece)
        else:
            free, window = self.free.pop(0)
            yield self._add(free, window, (doc, piece[1], piece[2][:4 * free]))
            full = self._open((doc, piece[1] + free, piece[2][4 * free:]))
        if full:
            yield full

    def left(self) -> Iterator[tuple[int, list]]:
        return iter(sorted(self.held.items()))


def powers(n: int) -> list[int]:
    """``n`` as powers of two, largest first: such sequences need no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _schema(kind: str) -> str:
    return (f"id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, `offset` long, "
            "part int, `window` long, ids binary")


def _rows(pieces: list, sequence: int | None, part: int | None, window: int | None, keep: bool) -> Iterator[tuple]:
    offset = 0
    for (doc, total), start, ids in pieces:
        yield doc, total, start, len(ids) // 4, zlib.crc32(ids), sequence, offset, part, window, ids if keep else None
        offset += len(ids) // 4


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH,
         windows: int = OPEN_WINDOWS, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids`` (32-bit, binary).

    Each document is its tokens and an end id; a null or empty text is the end id alone. Documents are cut freely, each id
    lies in one piece, and the pieces of a sequence lie without gaps. All sequences are full, but for those at the very end
    of a merge, whose lengths are powers of two: nothing is padded. Repeated rows are packed each; a null id stays null;
    other columns are not read. Sequence ids follow from partitions, so that a task that runs again gives the same.
    """
    path = tokenizer_path(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(_schema(kind))

    def first(batches):
        part, packer, count = TaskContext.get().partitionId(), Packer(length, windows), 0
        encode = encoder(path, True, False).encode

        def rows():
            nonlocal count
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                for doc, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    ids = own + END.to_bytes(4, "little")
                    for full in packer.put((doc, len(ids) // 4), ids):
                        yield from _rows(full, part << PARTITION_BITS | count, None, None, keep_ids)
                        count += 1
            for window, pieces in packer.left():
                yield from _rows(pieces, None, part, window, True)

        yield from _batches(rows(), to_arrow_schema(schema))

    placed = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`")).mapInArrow(first, schema), "placed")
    open_ = placed.filter("part is not null")
    most = open_.agg(F.max("part")).first()[0]
    groups = 1 if most is None else most // MERGED + 1

    def merge(batches):
        base, count, waiting, size = MERGED_FROM | TaskContext.get().partitionId() << PARTITION_BITS, 0, [], 0

        def taken(n):
            """The first n tokens waiting, as pieces."""
            nonlocal size
            out, size = [], size - n
            while n:
                doc, start, ids = waiting.pop(0)
                if len(ids) // 4 > n:
                    waiting.insert(0, (doc, start + n, ids[4 * n:]))
                    ids = ids[:4 * n]
                out.append((doc, start, ids))
                n -= len(ids) // 4
            return out

        def rows():
            nonlocal count, size
            for batch in batches:
                for r in batch.to_pylist():
                    waiting.append(((r["id"], r["doc_tokens"]), r["start"], r["ids"]))
                    size += len(r["ids"]) // 4
                    while size >= length:
                        yield from _rows(taken(length), base | count, None, None, keep_ids)
                        count += 1
            for n in powers(size):
                yield from _rows(taken(n), base | count, None, None, keep_ids)
                count += 1

        yield from _batches(rows(), to_arrow_schema(schema))

    merged = open_.repartition(groups, F.floor(F.col("part") / MERGED)).sortWithinPartitions("part", "window", "offset").mapInArrow(merge, schema)
    out = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    return placed.filter("part is null").unionByName(merged).select(F.col("id").alias(id_col), *out)
