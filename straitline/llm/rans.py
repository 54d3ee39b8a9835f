"""Token ids in compressed files: a static range asymmetric numeral system with one frequency table for all blocks.

A block holds whole documents and decodes on its own. Its tokens are dealt over interleaved lanes, each a coder with a
state of its own, which numpy advances together. At checkpoints a block keeps the states of its lanes and the place in the
stream, so that its stretches decode side by side; checksums guard the stream and the decoded tokens.

A folder holds ``model`` (frequencies) and ``blocks`` (documents and payloads), both Parquet, written by Spark's committed
writers on any file system Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from straitline.llm.common import arrow_map, load_tokenizer, stored, tokenizer_path
from straitline.llm.tokens import encoder, forget

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Bits of the frequencies' sum, of the words of the stream, and the least state.
SCALE, WORD, LOW = 20, 32, 1 << 31
#: Lanes of a block, steps between checkpoints, tokens from which a block is closed.
LANES, CHECKPOINT, BLOCK_TOKENS = 1024, 128, 1 << 18
#: Magic, version, tokens, lanes, steps a checkpoint, checkpoints, words, checksum of the tokens and of the stream.
HEADER = struct.Struct("<4sHIHHIIII")
MAGIC, VERSION = b"SRAN", 1


# --- the coder -------------------------------------------------------------------

def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each id that occurs."""
    counts = np.asarray(counts, np.float64)
    freq = np.zeros(counts.size, np.uint64)
    seen = counts > 0
    if not seen.any():
        return freq
    room = (1 << SCALE) - int(seen.sum())
    if room < 0:
        raise ValueError("more distinct ids than the frequency table can tell apart")
    share = counts[seen] / counts.sum() * room
    freq[seen] = 1 + np.floor(share).astype(np.uint64)
    freq[int(counts.argmax())] += np.uint64((1 << SCALE) - int(freq.sum()))
    return freq


def _lanes(n: int) -> int:
    """As many lanes as leave each of them 64 tokens, a power of two."""
    return min(LANES, 1 << max(0, (n // 64).bit_length() - 1))


def encode_block(tokens: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    n = tokens.size
    lanes = _lanes(n)
    steps = -(-n // lanes)
    f, c = freq[tokens], start[tokens]
    limit = f << np.uint64(WORD + 31 - SCALE)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    emitted, marks = 0, []
    shift, low = np.uint64(WORD), np.uint64((1 << WORD) - 1)
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        x = state[:b - a]
        over = x >= limit[a:b]
        if over.any():
            out = (x[over] & low).astype(np.uint32)
            words.append(out)
            emitted += out.size
            x[over] >>= shift
        q, r = np.divmod(x, f[a:b])
        state[:b - a] = (q << np.uint64(SCALE)) + r + c[a:b]
        if s % CHECKPOINT == 0:
            marks.append((emitted, state.copy()))
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    body = b"".join((np.array([emitted - e for e, _ in marks], np.uint32).tobytes(), *(x.tobytes() for _, x in marks), stream.tobytes()))
    return HEADER.pack(MAGIC, VERSION, n, lanes, CHECKPOINT, len(marks), stream.size, zlib.crc32(tokens.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(payload: bytes, freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Tokens of a block, all its checkpoints' stretches at once. Raises ValueError if a checksum differs."""
    magic, version, n, lanes, every, marks, size, crc_tokens, crc_body = HEADER.unpack_from(payload)
    body = payload[HEADER.size:]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != crc_body:
        raise ValueError("damaged block")
    at = np.frombuffer(body, np.uint32, marks).astype(np.int64)
    state = np.frombuffer(body, np.uint64, marks * lanes, 4 * marks).reshape(marks, lanes).copy()
    stream = np.append(np.frombuffer(body, np.uint32, size, 4 * marks + 8 * marks * lanes), np.uint32(0)).astype(np.uint64)
    out = np.zeros((marks, every, lanes), np.uint32)
    mask, low = np.uint64((1 << SCALE) - 1), np.uint64(LOW)
    steps = -(-n // lanes)
    rows, column = np.arange(marks)[:, None] * every, np.arange(lanes)[None, :]
    for s in range(min(every, steps)):
        full = ((marks - 1) * every + s + 1) * lanes <= n  # else some lanes have come to their end
        active = full or (rows + s) * lanes + column < n
        slot = state & mask
        token = slots[slot]
        out[:, s] = token
        x = freq[token] * (state >> np.uint64(SCALE)) + slot - start[token]
        short = x < low if full else (x < low) & active
        place = at[:, None] + np.cumsum(short, axis=1) - 1
        x = np.where(short, x << np.uint64(WORD) | stream[np.where(short, place, size)], x)
        state = x if full else np.where(active, x, state)
        at += short.sum(axis=1)
    tokens = out.reshape(-1)[:n]
    if zlib.crc32(tokens.astype("<u4").tobytes()) != crc_tokens:
        raise ValueError("decoded tokens differ from those written")
    return tokens


def slot_table(freq: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(freq.size, dtype=np.uint32), freq.astype(np.int64))


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(freq)[:-1].astype(np.uint64))) if freq.size else freq


# --- files -----------------------------------------------------------------------

def stored_type(vocabulary: str = VOCABULARY) -> str:
    """The type, little-endian, in which ids of a vocabulary wait between jobs: 16 bits if they fit, else 32."""
    return "<u2" if load_tokenizer(tokenizer_path(vocabulary)).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """``id, ids``: the token ids of each document with the end id, of ``stored_type``; a null text is the end id alone."""
    path, narrow = tokenizer_path(vocabulary), stored_type(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(ids, texts):
        encode = encoder(path, False, True).encode
        return [ids, [np.append(np.frombuffer(own, "<u4"), np.uint32(end)).astype(narrow).tobytes() for own in encode(texts)]]

    return arrow_map(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`")), run, f"id {kind}, ids binary")


def all_ids(column: pa.Array, kind: str) -> np.ndarray:
    """The ids of all rows of a binary column, one row after the other, without a copy."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "<i4")[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[1]].view(kind) if data is not None else np.empty(0, kind)


def frequencies(tokens: DataFrame, kind: str = "<u4") -> np.ndarray:
    """Counts of all ids, quantised. The driver gets a row for each id of the vocabulary."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            own = np.bincount(all_ids(b.column(0), kind))
            if own.size > total.size:
                total = np.concatenate((total, np.zeros(own.size - total.size, np.int64)))
            total[:own.size] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    found = tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["token"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["n"]
    return quantised(counts)


def write_tokens(tokens: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS, narrow: str = "<u4") -> None:
    """Write ``id, ids`` (integers of type ``narrow``) as files in ascending order of ids: nulls first, equal ids in a fixed order of their tokens.

    Documents are dealt by ranges of (id, hash of tokens), so that an id that very many rows repeat is split too.
    """
    spark = tokens.sparkSession
    freq = frequencies(tokens, narrow)
    spark.createDataFrame([(VERSION, freq.astype("<u4").tobytes())], "version int, frequencies binary").coalesce(1).write.parquet(f"{path}/model")
    shared = spark.sparkContext.broadcast(freq)
    kind = tokens.schema["id"].dataType
    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")

    def blocks(batches):
        forget()
        freq = shared.value
        start, part, number = _starts(freq), TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal number, size
            payload = encode_block(np.concatenate(held), freq, start)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([[d for d, _ in docs]], names[2].type),
                pa.array([[n for _, n in docs]], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], schema=names)
            docs.clear()
            held.clear()
            number, size = number + 1, 0
            return row

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(ids.as_py(), narrow)
                docs.append((doc, own.size))
                held.append(own)
                size += own.size
                if size >= block_tokens:
                    yield close()
        if docs:
            yield close()

    schema = StructType.fromDDL(f"part int, block long, ids array<{kind.simpleString()}>, sizes array<long>, tokens long, payload binary")
    names = to_arrow_schema(schema)
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, ids`` of the documents in a folder; ``start``: tokens of all documents before, in the files' order."""
    model = spark.read.parquet(f"{path}/model").first()
    freq = np.frombuffer(model["frequencies"], "<u4").astype(np.uint64)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    # A row per file is few; blocks are only added up within their file.
    files = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = files.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("before"))
    inside = blocks.select("part", "block", (F.sum("tokens").over(W.partitionBy("part").orderBy("block")) - F.col("tokens")).alias("inside"))
    placed = inside.join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("first"))

    out = StructType.fromDDL(f"id {kind}, start long, ids binary")

    def decode(batches):
        forget()
        freq, names = shared.value, to_arrow_schema(out)
        start, slots = _starts(freq), slot_table(freq)
        for batch in batches:
            for k in range(batch.num_rows):  # a block is many documents: one at a time, and handed on
                a, docs, ns, payload = (c[k].as_py() for c in batch.columns)
                own, ends = decode_block(payload, freq, start, slots).astype("<u4"), np.cumsum(ns)
                begins = (ends - ns).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, names[0].type), pa.array([a + x for x in begins], pa.int64()),
                    pa.array([own[x:y].tobytes() for x, y in zip(begins, ends.tolist())], pa.binary())], schema=names)

    return blocks.join(placed, ["part", "block"]).select("first", "ids", "sizes", "payload").mapInArrow(decode, out)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` into files at ``path`` and read them back: ``id, start, ids``."""
    write_tokens(stored(tokenize(docs, id_col, text), "tokens"), path, narrow=stored_type())
    return read_tokens(docs.sparkSession, path)
