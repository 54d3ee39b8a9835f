"""Whitening of vectors by their leading covariance components, found by contour integration (FEAST).

The covariance is summed by partitions. Its spectrum is cut into intervals by inertia counts; each interval is a task of
its own, which projects a random block onto the interval's components by quadrature of (z I - V)^-1 along a circle through
the interval's ends, extracts components by Rayleigh-Ritz, and repeats until the residuals are at rounding. The inertia
counts at the two ends say how many components there are, so that none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from straitline.llm.common import fresh, stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Components of an interval, as far as shifts can tell them apart.
SLICE = 8
#: Quadrature nodes on the upper half of a circle.
NODES = 8
#: Components below this share of the largest row sum of the covariance are rounding, and cannot be scaled to variance 1.
RANK_TOLERANCE = 1e-11
#: Repetitions of projection and extraction before an interval is given up.
ROUNDS = 50
ROWS = 1000
EXACT = 1 << 62


@dataclass
class Model:
    """Of the vectors of one length: their number, sums, and components as columns with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


# --- rows ---------------------------------------------------------------------------

def usable(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, vec``: rows whose vector has finite components only, each of which becomes a long."""
    fine = F.forall("vec", lambda c: c.isNotNull() & (c * 0 == 0) & (F.abs(c * SCALE) < float(EXACT)))
    return table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec")).filter(
        F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)


def _blocks(batches) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the rows of one length at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vec = part.column(1)
            lengths = vec.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                yield part.column(0).take(pa.array(rows)), np.floor(SCALE * values).astype(np.int64) + OFFSET


def _total(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    if int(np.abs(x).max(initial=0)) * len(x) < EXACT:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs, or Python integers where longs would overflow."""
    if n * int(np.abs(x).max()) + max(map(abs, sums)) < EXACT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(z: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if z.dtype != object and float(np.abs(z).max()) ** 2 * z.shape[1] >= EXACT:
        z = z.astype(object)
    return (z * z).sum(axis=1).tolist()


# --- sums over all rows ---------------------------------------------------------------

def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length of vectors their number and the exact sums of their components."""
    def run(batches):
        seen: dict[int, tuple[int, list[int]]] = {}
        for _, x in _blocks(batches):
            n, sums = seen.get(x.shape[1], (0, [0] * x.shape[1]))
            seen[x.shape[1]] = n + len(x), [a + b for a, b in zip(sums, _total(x))]
        for dim, (n, sums) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                 pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0))], names=["dim", "i", "n", "s"])

    parts = rows.mapInArrow(run, "dim int, i int, n long, s decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "i").collect():
        found.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return found


def _gram(rows: DataFrame, centred, size: dict[int, int]) -> DataFrame:
    """``dim, i, g``: the rows of the sum of y y' over all vectors, y = centred(x). A partition gives one matrix a length."""
    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for _, x in _blocks(batches):
            if k := size.get(dim := x.shape[1]):
                y = centred(x)
                seen[dim] = seen.get(dim, np.zeros((k, k))) + y.T @ y
        for dim, g in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()), pa.array(g.tolist(), pa.list_(pa.float64()))],
                names=["dim", "i", "g"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = np.sort(np.stack(pdf["g"].to_list()), axis=0)  # the sum does not depend on the order of arrival
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "i": pdf["i"].iloc[:1], "g": [parts.sum(axis=0)]})

    kind = "dim int, i int, g array<double>"
    return rows.mapInArrow(run, kind).groupBy("dim", "i").applyInPandas(add, kind)


# --- components of one covariance -----------------------------------------------------

def count_above(v: np.ndarray, shift: float, block: int = 32) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: its inertia, block by block (Haynsworth's additivity)."""
    for nudge in (0.0, 1e-12, -1e-12, 1e-11, -1e-11, 1e-10, -1e-10):
        rest, above = v - (shift + nudge * np.abs(v).max()) * np.eye(len(v)), 0
        while len(rest):
            values, q = np.linalg.eigh(rest[:block, :block])
            above += int((values > 0).sum())
            if len(rest) <= block:
                return above
            side = rest[:block, block:].T @ q
            size = np.maximum(np.abs(values), 1e-300)
            if (side * side / size).max() > 1e8 * np.abs(rest).max():
                break  # eliminating this leading block would cost too many digits: another shift next to this one
            rest = rest[block:, block:] - (side * np.sign(values) / size) @ side.T
    raise RuntimeError("no shift near an interval's end could be counted")


def _clear(v: np.ndarray, shift: float, gap: float) -> int | None:
    """The count above a shift, if it is the same on both sides of a gap."""
    n = count_above(v, shift - gap)
    return n if count_above(v, shift + gap) == n else None


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, components inside), from the top, that hold the ``wanted`` largest eigenvalues and maybe more.

    Ends are placed where both sides of a small gap give the same count; equal eigenvalues stay in one interval. No interval
    spans more than a factor of eight, since beside a large eigenvalue a circle hardly tells small ones apart.
    """
    top = float(np.abs(v).sum(axis=1).max())
    if not top > 0:
        return []
    least, high = RANK_TOLERANCE * top, 1.001 * top
    wanted, above, found = min(wanted, count_above(v, least)), 0, []
    while above < wanted:
        aim, up, end, n = min(above + SLICE, wanted), high, None, 0
        low = max(least, high / 8)
        if low > least:
            n = _clear(v, low, 1e-3 * low)
            while n is None:
                low *= 0.99
                n = _clear(v, low, 1e-3 * low) if low < 0.9 * high / 8 else _clear(v, low, 1e-6 * low)
            if n <= aim + SLICE // 2:
                end = low
        while end is None and up - low > 1e-10 * top:
            mid = (low + up) / 2
            gap = 1e-3 * (up - low)
            n = count_above(v, mid - gap)
            if n < aim:
                up = mid
                continue
            low = mid - gap
            if n <= aim + SLICE // 2 and count_above(v, mid + gap) == n:
                end = mid
        if end is None:  # many equal eigenvalues: all of them, with an end in the gap below
            n, gap = count_above(v, low), 1e-10 * top
            while low - 2 * gap > least and count_above(v, low - 2 * gap) == n:
                gap *= 2
            end = low - gap
        if n > above:
            found.append((*_drawn_in(v, end, high, n, above), n - above))
        above, high = n, end
    return found


def _drawn_in(v: np.ndarray, low: float, high: float, below: int, above: int) -> tuple[float, float]:
    """The interval without its empty halves, as far as that leaves room beside its eigenvalues."""
    last = low, high
    while high - low > 1e-6 * high:
        mid = (low + high) / 2
        n = count_above(v, mid)
        if n not in (below, above):
            break
        last, (low, high) = (low, high), (mid, high) if n == below else (low, mid)
    return last


def feast(v: np.ndarray, low: float, high: float, expected: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``expected`` eigenvalues in (low, high), falling, and unit eigenvectors as columns."""
    d = len(v)
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = radius * np.exp(0.5j * np.pi * (1 - nodes))
    width = min(d, max(expected + 6, 2 * expected))
    norm = float(np.abs(v).sum(axis=1).max())
    rng = np.random.default_rng((seed, d))
    y, best = rng.standard_normal((d, width)), None
    for _ in range(ROUNDS):
        if width < d:
            q = sum(w / 2 * (t * np.linalg.solve((middle + t) * np.eye(d) - v, y)).real for t, w in zip(turn, weights))
            left, sizes, _ = np.linalg.svd(q, full_matrices=False)
            left = left[:, sizes > 1e-13 * sizes[0]]
        else:
            left = np.eye(d)
        values, mix = np.linalg.eigh(left.T @ v @ left)
        x = left @ mix
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) >= expected:
            # What rounding leaves of other directions may show values in the interval too; the true ones have no residual.
            off = np.linalg.norm(v @ x[:, inside] - x[:, inside] * values[inside], axis=0)
            inside = np.sort(inside[np.argsort(off, kind="stable")[:expected]])
            found, chosen, residual = values[inside][::-1], x[:, inside][:, ::-1], float(np.sort(off)[:expected].max())
            if best is not None and residual >= 0.5 * best[0] and best[0] <= 1e-12 * norm:
                break  # no better than the round before: rounding is reached
            if best is None or residual < best[0]:
                best = residual, found, chosen / np.linalg.norm(chosen, axis=0)
            if width == d:
                break
        y = np.concatenate([x, rng.standard_normal((d, width - x.shape[1]))], axis=1)
    if best is None or best[0] > 1e-10 * norm:
        raise RuntimeError(f"components of ({low}, {high}) missed: {expected} by inertia")
    return best[1], best[2]


def _components(gram: DataFrame, sums: dict[int, tuple[int, list[int]]], wanted: int) -> dict[int, Model]:
    """The model of each length: one task a length cuts intervals, then one task an interval finds its components."""
    counts = {dim: n for dim, (n, _) in sums.items()}

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        v = np.stack(pdf.sort_values("i")["g"].to_list()) / counts[dim]
        v = (v + v.T) / 2
        found = intervals(v, wanted)
        return pd.DataFrame({"dim": dim, "place": range(len(found)), "low": [a for a, _, _ in found], "high": [b for _, b, _ in found],
                             "expected": [k for _, _, k in found], "v": [v.tobytes()] * len(found)})

    def extract(batches):
        for b in batches:
            for r in b.itertuples():
                v = np.frombuffer(r.v).reshape(r.dim, r.dim)
                values, vectors = feast(v, r.low, r.high, r.expected, r.place)
                yield pd.DataFrame({"dim": r.dim, "value": values, "vector": list(vectors.T), "trace": float(np.trace(v))})

    # The cut spectrum is stored, so that intervals are dealt out and none is cut again.
    slices = stored(gram.groupBy("dim").applyInPandas(cut, "dim int, place int, low double, high double, expected int, v binary"), "spectrum")
    rows = slices.repartition(max(1, slices.count()), "dim", "place").mapInPandas(
        extract, "dim int, value double, vector array<double>, trace double").collect()  # `wanted` vectors a length and a few more
    models = {}
    for dim in {r.dim for r in rows}:
        own = sorted((r for r in rows if r.dim == dim), key=lambda r: -r.value)[:wanted]
        models[dim] = Model(*sums[dim], np.array([r.vector for r in own]).T, np.array([r.value for r in own]), own[0].trace)
    return models


def _whitened(model: Model, z: np.ndarray) -> np.ndarray:
    return (z.astype(np.float64) / model.n) @ model.vectors / np.sqrt(model.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length of vectors that has variance. What reaches the driver is ``components`` vectors a length."""
    sums = _sums(rows)
    centred = lambda x: _numerators(x, *sums[x.shape[1]]).astype(np.float64) / sums[x.shape[1]][0]
    models = _components(_gram(rows, centred, {dim: dim for dim in sums}), sums, components)
    white = lambda x: _whitened(models[x.shape[1]], _numerators(x, models[x.shape[1]].n, models[x.shape[1]].sums))
    # Whitened vectors are centred as they come: their sums are zero but for rounding.
    for r in _gram(rows, white, {dim: len(m.values) for dim, m in models.items()}).collect():
        m = models[r.dim]
        m.identity_error = max(m.identity_error, float(np.abs(np.array(r.g) / m.n - np.eye(len(m.values))[r.i]).max()))
    return models


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per row and component, components from 1 down.

    Rows with a null vector, an empty one, or one with a null or non-finite component take no part (nor do components so large
    that no long holds them); all others are fitted on and answered, null ids and repeated rows included. Vectors of different
    lengths are fitted apart. Components without variance cannot be whitened and are not returned: one vector alone, or equal
    vectors, give no rows. ``deviation`` is exact, as decimal(38,0). Other columns are not read.
    """
    rows = usable(table, id_col, vector)
    models = fit(rows, components)
    kind = rows.schema["id"].dataType
    out, length = fresh(id_col, rows), "length"

    def run(batches):
        for ids, x in _blocks(batches):
            if model := models.get(x.shape[1]):
                z = _numerators(x, model.n, model.sums)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(list(map(Decimal, _squares(z))), pa.decimal128(38, 0)),
                     pa.array(_whitened(model, z).tolist(), pa.list_(pa.float64()))], names=["id", length, "deviation", "white"])

    each = rows.mapInArrow(run, f"id {kind.simpleString()}, {length} int, deviation decimal(38,0), white array<double>").select(
        "id", length, "deviation", F.posexplode("white").alias("place", "whitened"))
    told = [(dim, i, m.n, float(m.values[i] / m.trace), m.identity_error) for dim, m in models.items() for i in range(len(m.values))]
    facts = table.sparkSession.createDataFrame(told, f"{length} int, place int, n long, explained double, identity_error double")
    return each.join(facts, [length, "place"]).select(
        F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error")
