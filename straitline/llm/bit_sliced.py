"""Exact top-k by inner product over a bit-sliced index.

Each attribute of the quantised vectors is kept as bitmaps over the rows of a shard, one for each binary digit. A query adds
the slices its weights call for with full adders on whole bitmaps, which gives the digits of all rows' scores as bitmaps;
the best rows are then picked from the most significant slice downward. A bitmap is a Python integer.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, functions as F

from straitline.llm.vectors import indexed, searched, usable

TOP, SCALE = 5, 256
SHARD_ROWS = 4096


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * vectors).astype(np.int64)


def build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """Ids in ascending order, quantised rows, and the slices of each attribute, least digit first."""
    rows = quantised(vectors)
    least = rows.min(axis=0)
    raised = (rows - least).astype(np.uint64)
    digits = int(raised.max()).bit_length()
    slices = [[np.packbits((raised[:, a] >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little").tobytes() for b in range(digits)]
              for a in range(rows.shape[1])]
    return pickle.dumps((ids, rows, slices), protocol=5)


def summed(columns: dict[int, list[int]]) -> list[int]:
    """The digits of a sum as bitmaps, given for each digit the bitmaps to add there."""
    out, place = [], 0
    while place <= max(columns, default=-1):
        here, carry = columns.get(place, []), columns.setdefault(place + 1, [])
        while len(here) > 2:
            a, b, c = here.pop(), here.pop(), here.pop()
            either = a ^ b
            here.append(either ^ c)
            carry.append(a & b | either & c)
        if len(here) == 2:
            a, b = here
            here = [a ^ b]
            carry.append(a & b)
        if not carry:
            del columns[place + 1]
        out.append(here[0] if here else 0)
        place += 1
    return out


def scores(slices: list[list[int]], every: int, weights: list[int]) -> list[int]:
    """Digits of all rows' scores, but for a constant of the query: under a negative weight the complement is added."""
    columns: dict[int, list[int]] = {}
    for own, weight in zip(slices, weights):
        size = abs(weight)
        for shift in range(size.bit_length()):
            if size >> shift & 1:
                for b, bitmap in enumerate(own):
                    columns.setdefault(shift + b, []).append(bitmap if weight > 0 else every ^ bitmap)
    return summed(columns)


def top_rows(digits: list[int], eligible: int, k: int) -> list[int]:
    """Places of the ``k`` highest scores; of equal ones at the boundary those that stand first."""
    sure, open_ = 0, eligible
    for bitmap in reversed(digits):
        high = open_ & bitmap
        n = (sure | high).bit_count()
        if n > k:
            open_ = high
        else:
            sure, open_ = sure | high, open_ & ~bitmap
            if n == k:
                open_ = 0
                break
    out = []
    for bitmap, most in ((sure, k), (open_, k - sure.bit_count())):
        for _ in range(most):
            if not bitmap:
                break
            low = bitmap & -bitmap
            out.append(low.bit_length() - 1)
            bitmap ^= low
    return out


def answer(index: bytes, ids: np.ndarray, vectors: np.ndarray, k: int = TOP) -> list[tuple[int, int, int]]:
    """The ``k`` best rows of a shard for each query, with their exact scores."""
    names, rows, packed = pickle.loads(index)
    slices = [[int.from_bytes(b, "little") for b in own] for own in packed]
    every = (1 << names.size) - 1
    out = []
    for query, weights in zip(ids.tolist(), quantised(vectors).tolist()):
        own = int(np.searchsorted(names, query))
        eligible = every ^ (1 << own) if own < names.size and names[own] == query else every
        for at in top_rows(scores(slices, every, weights), eligible, k):
            out.append((query, int(names[at]), sum(a * b for a, b in zip(weights, rows[at].tolist()))))
    return out


def best_products(table: DataFrame, every: int = 50, id_col: str = "vec_id", vector: str = "embedding", k: int = TOP,
                  shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each row whose id is divisible by ``every``.

    Components count as floor(256 x). Rows with a null id, or a vector that is null, empty or holds a null or non-finite
    component, take no part; vectors of zeros do. Vectors only meet those of their dimension. Rows that repeat an id count
    once, with the smallest of their vectors; repeated vectors under other ids all stand. Ties go to the smaller id. With
    fewer than ``k`` candidates all are returned; an empty table gives no rows. Other columns are not read. Scores are
    exact as long as they and the quantised components fit 64 bits.
    """
    rows = usable(table, id_col, vector, zero=True)
    index = indexed(rows, shard_rows, build)
    return searched(index, rows.filter(F.col("id") % every == 0), lambda data, ids, vecs: answer(data, ids, vecs, k), k, "long", ascending=False)
