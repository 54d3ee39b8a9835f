"""Seeded merge-dropout: varied merge-type segmentations under a public vocabulary, and their lossless decoding.

Merges are taken from an agenda, best score first. A candidate is skipped when a keyed hash says so: the key is the seed and the
document, the candidate's place in the whole text and its rank. So each occurrence is segmented by its own key, and it does not
matter how a text is cut into stretches, as long as no merge crosses a cut. The agendas of all stretches of like length run side by
side in matrices: a round takes the best candidate of each stretch, so that there are as many rounds as a stretch has merges.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from straitline.llm.common import arrow_map, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 42
#: Characters whose agendas run side by side.
CHUNK = 1 << 19
#: Characters up to which a stretch is a row of a matrix; longer ones have a heap. Both give the same pieces.
SHORT = 48
#: Columns of those matrices, up to SHORT: a row is padded to the next of them.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48)
#: No longer used: stretches and their branches are not remembered.
REMEMBERED, STRAYS = 0, 0
PLACE, RANK = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
MASK = (1 << 64) - 1
#: Rank of what is no candidate, and the symbol of a character that a merge has taken up.
NEVER, DEAD = 0xFFFFFFFF, 0xFFFFFFFF

SPACE_MARK = "▁"
#: A space that starts a stretch: merges never cross from another character to it.
START = re.compile("(?<! ) ")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    """Ids and ranks (best score first) of the text pieces, ids of the byte pieces, and the bytes that each id stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids: dict[str, int] = {}
    raw, single = [], [0] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            single[int(piece[1:-1], 16)] = i
            raw.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            raw.append(b"")
        else:
            ids[piece] = i
            raw.append(piece.replace(SPACE_MARK, " ").encode())
    levels = {x: k for k, x in enumerate(sorted({-model.get_score(i) for i in ids.values()}))}
    return ids, {p: levels[-model.get_score(i)] for p, i in ids.items()}, single, raw


def _dropped(key: int, place: int, rank: int, limit: int) -> bool:
    """Whether the keyed hash skips a candidate; ``limit`` of 2**24 skips all."""
    x = (key + place * PLACE ^ rank * RANK) * 0xBF58476D1CE4E5B9 & MASK
    return ((x ^ x >> 31) * 0x94D049BB133111EB & MASK) >> 40 < limit


def merged_by_key(stretch: str, ranks: dict[str, int], key: int, limit: int) -> list[str]:
    """Pieces of a stretch of any length: the agenda's merges, best rank first, then from the left, without those that the keyed hash
    skips. A place is that of the left side's first character."""
    symbols, n = list(stretch), len(stretch)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list[tuple[int, int, int, str]] = []

    def propose(a: int, b: int) -> None:
        pair = symbols[a] + symbols[b]
        if (rank := ranks.get(pair)) is not None:
            heapq.heappush(agenda, (rank, a, b, pair))

    for a in range(n - 1):
        propose(a, a + 1)
    while agenda:
        rank, a, b, pair = heapq.heappop(agenda)
        if not symbols[a] or after[a] != b or symbols[a] + symbols[b] != pair:
            continue  # one of its sides has been merged since
        if limit and _dropped(key, a, rank, limit):
            continue
        symbols[a], symbols[b], after[a] = pair, "", after[b]
        if after[a] >= 0:
            before[after[a]] = a
            propose(a, after[a])
        if before[a] >= 0:
            propose(before[a], a)
    return [s for s in symbols if s]


class Merges:
    """Which symbols two symbols merge to, as an open-addressed table in one array: the pair's key above, the piece's symbol below."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.bits = max(8, (4 * len(rows)).bit_length())
        self.slots = np.zeros(1 << self.bits, np.uint64)
        left, right, piece = np.array(rows, np.uint64).reshape(-1, 3).T
        key = left << np.uint64(21) | right
        entry, at = key << np.uint64(21) | piece, self._slot(key)
        while entry.size:
            free = np.flatnonzero(self.slots[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            self.slots[at[free[first]]] = entry[free[first]]
            rest = np.delete(np.arange(entry.size), free[first])
            entry, at = entry[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(PLACE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that pairs merge to, 0 where they do not."""
        key = left.astype(np.uint64) << np.uint64(21) | right
        at = self._slot(key)
        entry = self.slots[at]
        out = np.where(entry >> np.uint64(21) == key, entry & np.uint64((1 << 21) - 1), np.uint64(0)).astype(np.uint32)
        open_ = np.flatnonzero((out == 0) & (entry != 0))
        while open_.size:  # the slot holds another pair: look on
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            entry = self.slots[at[open_]]
            hit = entry >> np.uint64(21) == key[open_]
            out[open_[hit]] = (entry[hit] & np.uint64((1 << 21) - 1)).astype(np.uint32)
            open_ = open_[~hit & (entry != 0)]
        return out


class Segmenter:
    """Segmentations of whole texts under a seed. A symbol is an id plus one, or beyond those a character that is only part of pieces;
    0 is any other character."""

    def __init__(self, path: str, dropout: float, seed: int):
        self.ids, self.ranks, self.single, self.raw = vocabulary(path)
        self.limit, self.seed = int(dropout * (1 << 24)), seed & MASK
        symbols = {p: i + 1 for p, i in self.ids.items()}
        chars = sorted({c for p in self.ids for c in p})
        for c in chars:
            symbols.setdefault(c, len(self.raw) + 1 + len(symbols))
        self.merges = Merges([(symbols[p[:k]], symbols[p[k:]], symbols[p]) for p in self.ids for k in range(1, len(p))
                              if p[:k] in symbols and p[k:] in symbols])
        self.rank = np.full(len(self.raw) + 1, NEVER, np.uint32)
        for p, r in self.ranks.items():
            self.rank[symbols[p]] = r
        points = [ord(c) for c in chars]
        self.symbol, self.number = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.int32)
        self.symbol[points] = [symbols[c] for c in chars]
        self.number[points] = np.arange(1, len(chars) + 1)
        #: Which characters stand side by side in some piece: between others no merge ever crosses.
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.ids:
            own = self.number[[ord(c) for c in p]]
            self.beside[own[:-1], own[1:]] = True
        self.bytes = np.array(self.single, np.uint32)

    def _spelled(self, piece: str) -> list[int]:
        """Ids of a piece: its own, or those of its bytes where the vocabulary lacks it."""
        i = self.ids.get(piece)
        return [i] if i is not None else [self.single[b] for b in piece.encode("utf-8", "surrogatepass")]

    def encode(self, text: str | None, doc: object) -> np.ndarray:
        """Piece ids of a text; ``doc`` is part of the key of each occurrence."""
        return self.encode_all([text], [doc])[0]

    def encode_all(self, texts: list[str | None], docs: list) -> list[np.ndarray]:
        """Piece ids of each text, CHUNK characters or the rest of a stretch more at a time."""
        out, held, size = [[] for _ in texts], [], 0
        for i, (text, doc) in enumerate(zip(texts, docs)):
            if not text:
                continue
            key, at, text = xxhash.xxh64_intdigest(str(doc).encode(), self.seed), 0, " " + text
            while at < len(text):
                cut = START.search(text, at + CHUNK) if len(text) - at > CHUNK else None
                end = cut.start() if cut else len(text)
                held.append((i, text[at:end], key + at * PLACE & MASK, not at))
                size, at = size + end - at, end
                if size >= CHUNK:
                    self._encode(held, out)
                    held, size = [], 0
        if held:
            self._encode(held, out)
        return [x[0] if len(x) == 1 else np.concatenate([np.empty(0, np.uint32), *x]) for x in out]

    def _encode(self, held: list[tuple[int, str, int, bool]], out: list[list[np.ndarray]]) -> None:
        """Put the ids of parts of texts (number, part, key of its first place, whether it starts with the space put before) to ``out``."""
        points = np.frombuffer("".join(part for _, part, _, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        literal = points == ord(SPACE_MARK)  # a literal mark would read as a space: its bytes
        points[points == 32] = ord(SPACE_MARK)
        symbols, number = self.symbol[points], self.number[points]
        symbols[literal], number[literal] = 0, 0
        sizes = np.array([len(part) for _, part, _, _ in held])
        begins = np.cumsum(sizes) - sizes
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.beside[number[:-1], number[1:]]
        cut[begins] = True
        edges = np.flatnonzero(cut)
        starts, lengths = edges[:-1], np.diff(edges)
        of = np.searchsorted(begins, starts, side="right") - 1
        keys = np.array([key for _, _, key, _ in held], np.uint64)[of] + (starts - begins[of]).astype(np.uint64) * np.uint64(PLACE)
        least = 2
        for width in sorted({*(w for w in WIDTHS if w < SHORT), SHORT}):
            rows = np.flatnonzero((lengths >= least) & (lengths <= width))
            least = max(least, width + 1)
            if rows.size:
                self._agendas(symbols, starts[rows], lengths[rows], width, keys[rows])
        for i in np.flatnonzero((lengths > SHORT) & (lengths > 1)).tolist():
            at, stretch = int(starts[i]), points[starts[i]:starts[i] + lengths[i]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            for piece in merged_by_key(stretch, self.ranks, int(keys[i]), self.limit):
                if len(piece) > 1:
                    symbols[at:at + len(piece)] = DEAD
                    symbols[at] = self.ids[piece] + 1
                at += len(piece)
        kept = np.flatnonzero(symbols != DEAD)
        symbols, points = symbols[kept], points[kept]
        known = (symbols > 0) & (symbols <= len(self.raw))
        size = np.where(known, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        ends = np.cumsum(size)
        ids = np.empty(ends[-1], np.uint32)
        ids[ends[known] - 1] = symbols[known] - 1
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):  # the bytes of what the vocabulary lacks
            rows = np.flatnonzero(~known & (size == n))
            for k in range(n):
                left = points[rows] >> 6 * (n - 1 - k)
                ids[ends[rows] - n + k] = self.bytes[lead | left if not k else 0x80 | left & 63]
        after = ends[np.searchsorted(kept, begins + sizes) - 1]
        for (i, *_), a, b in zip(held, [0, *after[:-1].tolist()], after.tolist()):
            out[i].append(ids[a:b])

    def _agendas(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, keys: np.ndarray) -> None:
        """Merge the stretches at ``starts`` of ``symbols`` in place, each a row of as many columns as the longest may have.

        Behind them is a column of symbol 0, which merges with nothing: the neighbour of both ends.
        """
        n, step = len(starts), width + 1
        places = np.minimum(starts[:, None] + np.arange(width), len(symbols) - 1)
        inside = np.arange(width) < lengths[:, None]
        sym = np.zeros((n, step), np.uint32)
        sym[:, :width] = np.where(inside, symbols[places], 0)
        grid = np.arange(n * step).reshape(n, step)
        after, before = grid + 1, grid - 1
        after[:, width], before[:, 0] = grid[:, width], grid[:, width]
        piece = np.zeros((n, step), np.uint32)
        piece[:, :-1] = self.merges.of(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
        sym, after, before, piece = sym.ravel(), after.ravel(), before.ravel(), piece.ravel()
        rank = np.full(n * step, NEVER, np.uint32)
        found = np.flatnonzero(piece)
        rank[found] = self._ranked(piece[found], keys[found // step], found % step)
        table, active = rank.reshape(n, step), np.arange(n)
        while active.size:
            own = table[active]
            best = own.argmin(axis=1)
            open_ = own[np.arange(active.size), best] != NEVER
            active = active[open_]
            at = active * step + best[open_]
            right = after[at]
            merged, new = piece[at], after[right]
            sym[at], sym[right], rank[right] = merged, DEAD, NEVER
            after[at], before[new] = new, at
            left = before[at]
            where = np.concatenate((at, left))
            made = self.merges.of(np.concatenate((merged, sym[left])), np.concatenate((sym[new], merged)))
            piece[where], rank[where] = made, NEVER
            found = np.flatnonzero(made)
            row = np.concatenate((active, active))[found]
            rank[where[found]] = self._ranked(made[found], keys[row], where[found] - row * step)
        symbols[places[inside]] = sym.reshape(n, step)[:, :width][inside]

    def _ranked(self, piece: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ranks of candidates, NEVER for those that _dropped tells to skip."""
        rank = self.rank[piece]
        if self.limit:
            x = ((keys + places.astype(np.uint64) * np.uint64(PLACE)) ^ (rank.astype(np.uint64) * np.uint64(RANK))) * np.uint64(0xBF58476D1CE4E5B9)
            x = ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)
            rank[x < np.uint64(self.limit)] = NEVER
        return rank

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for, without the space put before it."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_segmenters: dict[tuple, Segmenter] = {}


def segmenter(path: str, dropout: float = DROPOUT, seed: int = SEED) -> Segmenter:
    key = (path, dropout, seed)
    if key not in _segmenters:
        _segmenters[key] = Segmenter(path, dropout, seed)
    return _segmenters[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = VOCABULARY, dropout: float = DROPOUT,
           seed: int = SEED, digest: bool = False) -> DataFrame:
    """One row per document: ``id, n_pieces, ids_crc32, lossless`` and, unless ``digest``, ``ids``.

    The same seed and id give the same segmentation on every run; ``dropout`` 0 gives the vocabulary's own. ``lossless`` tells
    whether the ids decode to the text. A null or empty text has no ids and is lossless. Characters that the vocabulary lacks
    become bytes. Repeated rows are answered each, alike; a null id is a key like any other. Other columns are not read.
    """
    path = tokenizer_path(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(names, texts):
        own = segmenter(path, dropout, seed)
        columns: list[list] = [[], [], [], [], []]
        for name, t, ids in zip(names, texts, own.encode_all(texts, names)):
            row = (name, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), own.decode(ids) == (t or ""), None if digest else ids.tolist())
            for c, x in zip(columns, row):
                c.append(x)
        return columns[:4 if digest else 5]

    extra = "" if digest else ", ids array<int>"
    return arrow_map(docs.select(f"`{id_col}`", f"`{text}`"), run, f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, lossless boolean{extra}")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", model: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the texts of its ids as column ``out``; null ids give a null text."""
    path = tokenizer_path(model)

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        own = segmenter(path, 0.0)
        return column.map(lambda x: own.decode(np.asarray(x, np.int64)), na_action="ignore")

    return encoded.withColumn(out, texts(F.col(f"`{ids}`")))
