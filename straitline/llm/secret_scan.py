"""Secrets: fixed patterns, and a character convolutional network over every other candidate with its surroundings.

Candidates are runs of key-like characters that hold letters and figures, are long, or follow a colon or an equals sign.
Those that a pattern finds are labelled with its kind, all others with none. A small network in numpy is trained on all
distinct ones but a fourth, calibrated on that held-out fourth, and takes as threshold of a kind the highest probability that still
finds a stated share of the held-out findings of that kind. Since unlabelled candidates may be secrets too, those that a first
training takes for findings by their characters alone do not count as none in the second.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from straitline.llm.common import ROWS, arrow_map, ascii_lower, discard, rows_per_part, stored

#: Kinds in the order in which spans of one start are listed; the network's own spans come last (fixed values).
KINDS = ("assign", "access", "hex")
LEARNED = "cnn"

#: Patterns and the least length of what they hold (fixed values); re.ASCII keeps "either case" to ASCII letters.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Words without which ASSIGN finds nothing, in lower case.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
#: Lengths are part of the other two: a longest run that is too short holds no shorter one that is long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{6,}={0,2}")
LED = re.compile(r"""[:=]["'\x20]{0,8}""")
LONG = 20
#: Characters before and after a candidate that the network sees, besides the whole candidate.
BEFORE, AFTER = 24, 16

#: Windows that one task learns from at a time. More of them are dealt into shards, whose weights are averaged after every round.
SHARD = 12_000
#: Share of the held-out findings of a kind that its threshold must find.
RECALL = 0.99
#: Findings of a kind below which it is not learned.
FEWEST = 20
HELD_OUT = 4  # one in so many is kept for calibration

EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
EPOCHS, BATCH, RATE, SEED = 12, 128, 3e-3, 11
#: Padded places of a batch of windows.
PLACES = 1 << 16


# --- patterns and candidates ------------------------------------------------------------

def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each pattern's finds, by start, then kind as listed."""
    found = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    raw = ascii_lower(text)
    if any(x in raw for x in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each candidate; full stops and dashes around it are punctuation."""
    led = {m.end() for m in LED.finditer(text)}
    for m in CANDIDATE.finditer(text):
        core = m.group().strip(".-")
        if len(core) < LONG and core.isalpha() and m.start() not in led:  # most words of prose end here
            continue
        start = m.end() - len(m.group().lstrip(".-"))
        if len(core) >= LONG or (len(core) >= 6 and m.start() in led) or (
                len(core) >= 8 and any(c.isalpha() for c in core) and any(c.isdigit() for c in core)):
            yield start, start + len(core)


def labelled(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int]]:
    """Candidates with the number of the pattern kind that finds them (earliest find first), from 1; 0 is none.

    Both lists are in order of their starts, and no two spans of a kind overlap: one sweep.
    """
    first = 0
    for start, end in candidates(text):
        while first < len(spans) and spans[first][1] <= start:
            first += 1
        label = 0
        for a, b, kind in spans[first:first + 2 * len(KINDS)]:
            if a >= end:
                break
            if b > start:
                label = KINDS.index(kind) + 1
                break
        yield start, end, label


def window(text: str, start: int, end: int) -> tuple[str, int, int]:
    """A candidate with its surroundings, and its place there."""
    a = max(0, start - BEFORE)
    return text[a:end + AFTER], start - a, end - a


# --- network ----------------------------------------------------------------------------

#: Printable ASCII by itself; letters and others beyond, and control characters, by class. 0 is outside.
_CLASSES = 99


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < 32, 96, np.where(points < 127, points - 31, np.where(points < 0x2000, 97, 98)))


@dataclass
class Network:
    """Weights, and per learned kind its calibration (slope, shift) and threshold."""

    weights: dict[str, np.ndarray]
    kinds: dict[int, tuple[float, float, float]]

    def probabilities(self, windows: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probability of each learned kind (columns, as in ``kinds``) of each window."""
        logits = logits_of(self.weights, windows)
        odds = logits[:, 1:] - logits[:, :1]
        return np.stack([1 / (1 + np.exp(-np.clip(a * odds[:, k - 1] + b, -40, 40))) for k, (a, b, _) in self.kinds.items()], axis=1)

    def findings(self, windows: list[tuple[str, int, int]]) -> np.ndarray:
        """Which windows reach a kind's threshold, and their highest probability (0 if none does)."""
        if not self.kinds or not windows:
            return np.zeros(len(windows))
        p = self.probabilities(windows)
        reached = p >= np.array([t for _, _, t in self.kinds.values()])
        return np.where(reached.any(axis=1), np.where(reached, p, 0).max(axis=1), 0.0)


def _batches(windows: list[tuple[str, int, int]]) -> Iterator[np.ndarray]:
    """Indexes of windows of like length, so that little is padded."""
    order = np.argsort([len(w[0]) for w in windows], kind="stable")
    at = 0
    while at < len(order):
        end, longest = at, 0
        while end < len(order):
            longest = max(longest, len(windows[order[end]][0]))
            if end > at and longest * (end - at + 1) > PLACES:
                break
            end += 1
        yield order[at:end]
        at = end


def _padded(windows: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (windows, places), and of each place its part: before 0, candidate 1, after 2, outside -1."""
    edge, size = WIDTH // 2, max(len(w[0]) for w in windows)
    codes = np.zeros((len(windows), size + 2 * edge), np.int64)
    part = np.full((len(windows), size), -1, np.int8)
    for i, (text, start, end) in enumerate(windows):
        codes[i, edge:edge + len(text)] = _codes(text)
        part[i, :len(text)] = 0
        part[i, start:end], part[i, end:len(text)] = 1, 2
    return codes, part


def _forward(w: dict[str, np.ndarray], codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits, and what the way back needs. A part without characters gives zeros."""
    n, size = part.shape
    seen = np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=1)
    column = w["embed"][seen].reshape(n, size, -1)
    act = np.maximum(column @ w["conv"] + w["conv_b"], 0)
    best = [np.where((part == p)[:, :, None], act, -1).argmax(axis=1) for p in range(3)]
    own = (part == 1)[:, :, None]
    long = own.sum(axis=1).astype(act.dtype)
    pooled = [np.take_along_axis(act, b[:, None, :], 1)[:, 0] * (part == p).any(axis=1)[:, None] for p, b in enumerate(best)]
    x = np.concatenate([*pooled, (act * own).sum(axis=1) / long, np.log1p(long, dtype=act.dtype) / 4], axis=1)
    hidden = np.maximum(x @ w["dense"] + w["dense_b"], 0)
    return hidden @ w["out"] + w["out_b"], {"seen": seen, "column": column, "act": act, "best": best, "own": own, "long": long, "x": x, "hidden": hidden}


def logits_of(w: dict[str, np.ndarray], windows: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros((len(windows), 1 + len(KINDS)))
    for rows in _batches(windows):
        out[rows] = _forward(w, *_padded([windows[i] for i in rows]))[0]
    return out


def _gradients(w: dict[str, np.ndarray], codes: np.ndarray, part: np.ndarray, labels: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    logits, s = _forward(w, codes, part)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    d = p
    d[np.arange(len(labels)), labels] -= 1
    d *= cost[labels][:, None] / len(labels)
    g = {"out": s["hidden"].T @ d, "out_b": d.sum(axis=0)}
    d = (d @ w["out"].T) * (s["hidden"] > 0)
    g["dense"], g["dense_b"] = s["x"].T @ d, d.sum(axis=0)
    d = d @ w["dense"].T
    act = s["act"]
    back = d[:, None, 3 * FILTERS:4 * FILTERS] * s["own"] / s["long"][:, None]
    rows, columns = np.arange(len(act))[:, None], np.arange(FILTERS)[None]
    for p_, b in enumerate(s["best"]):
        there = (part == p_).any(axis=1)[:, None]
        back[rows, b, columns] += d[:, p_ * FILTERS:(p_ + 1) * FILTERS] * there
    back = (back * (act > 0)).reshape(-1, FILTERS)
    g["conv"], g["conv_b"] = s["column"].reshape(len(back), -1).T @ back, back.sum(axis=0)
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], s["seen"].reshape(-1), (back @ w["conv"].T).reshape(-1, EMBED))
    return g


@dataclass
class Training:
    """Weights on their way: Adam's two moments of each, and its steps so far."""

    w: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: float = 0


def _untrained(rng: np.random.Generator) -> Training:
    size = {"embed": (_CLASSES, EMBED), "conv": (WIDTH * EMBED, FILTERS), "dense": (4 * FILTERS + 1, HIDDEN), "out": (HIDDEN, 1 + len(KINDS))}
    w = {k: (rng.standard_normal(s) * np.sqrt(2 / s[0] if k != "embed" else 0.25)).astype(np.float32) for k, s in size.items()}
    w |= {f"{k}_b": np.zeros(size[k][1], np.float32) for k in ("conv", "dense", "out")}
    w["embed"][0] = 0
    return Training(w, {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()})


def _costs(many: np.ndarray) -> np.ndarray:
    """What a mistake costs by label, the rarer the more; ``many`` counts the windows of each."""
    return np.sqrt(many.sum() / np.maximum(1, many) / np.count_nonzero(many)).astype(np.float32)


def _round(at: Training, windows: list[tuple[str, int, int]], labels: np.ndarray, cost: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over all windows. A window counts once with its surroundings and once without, so that neither suffices alone."""
    windows, labels = windows + [(text[a:b], 0, b - a) for text, a, b in windows], np.concatenate([labels, labels])
    # Batches of like length in shuffled order; of very long windows fewer make a batch.
    order, starts = np.argsort([len(x[0]) + 8 * rng.random() for x in windows]), []
    while not starts or starts[-1][1] < len(order):
        low = starts[-1][1] if starts else 0
        longest = np.maximum.accumulate([len(windows[i][0]) for i in order[low:low + BATCH]])
        starts.append((low, low + max(1, int((longest * np.arange(1, len(longest) + 1) <= PLACES).sum()))))
    for i in rng.permutation(len(starts)):
        rows = order[slice(*starts[i])]
        at.step += 1
        for k, g in _gradients(at.w, *_padded([windows[i] for i in rows]), labels[rows], cost).items():
            at.first[k] = 0.9 * at.first[k] + 0.1 * g
            at.second[k] = 0.999 * at.second[k] + 0.001 * g * g
            at.w[k] = at.w[k] - RATE * (at.first[k] / (1 - 0.9 ** at.step)) / (np.sqrt(at.second[k] / (1 - 0.999 ** at.step)) + 1e-8)


def _averaged(parts: Iterator[tuple[int, Training]]) -> Training:
    """The mean of what shards have learned, each by the number of its windows; one at a time is held."""
    total, mean = 0, None
    for n, part in parts:
        total += n
        mean = mean or Training(*({k: np.zeros(x.shape) for k, x in t.items()} for t in (part.w, part.first, part.second)))
        mean.step += (part.step - mean.step) * n / total
        for old, new in ((mean.w, part.w), (mean.first, part.first), (mean.second, part.second)):
            for k in old:
                old[k] += (new[k] - old[k]) * (n / total)
    return Training(*({k: x.astype(np.float32) for k, x in t.items()} for t in (mean.w, mean.first, mean.second)), mean.step)


def train_weights(windows: list[tuple[str, int, int]], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Adam over shuffled batches."""
    rng = np.random.default_rng(SEED)
    at, cost = _untrained(rng), _costs(np.bincount(labels, minlength=1 + len(KINDS)))
    for _ in range(EPOCHS):
        _round(at, windows, labels, cost, rng)
    return at.w


def calibrate(scores: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that gives held-out scores their probabilities, by Newton's method.

    Truths are softened by the counts, and the slope is drawn to 1 and the shift to 0 a little, so that separable scores stay finite.
    """
    yes, no = truth.sum(), (~truth).sum()
    aim = np.where(truth, (yes + 1) / (yes + 2), 1 / (no + 2))
    x, at, prior = np.stack([scores, np.ones(len(scores))], axis=1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        slope = x.T @ (p - aim) + 0.1 * (at - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        at = at - move * min(1.0, 2 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def _looks_none(weights: dict[str, np.ndarray], windows: list[tuple[str, int, int]]) -> np.ndarray:
    """Which windows look like no finding by their characters alone."""
    return logits_of(weights, [(text[a:b], 0, b - a) for text, a, b in windows]).argmax(axis=1) == 0


def _kinds_told(kinds: list[int], logits: np.ndarray, truth: np.ndarray) -> dict[int, tuple[float, float, float]]:
    """Calibration and threshold of each kind, from all held-out windows."""
    told = {}
    for k in kinds:
        odds = logits[:, k] - logits[:, 0]
        asked = (truth == k) | (truth == 0)
        a, b = calibrate(odds[asked], truth[asked] == k)
        found = np.sort(1 / (1 + np.exp(-np.clip(a * odds[truth == k] + b, -40, 40))))
        # No less than one half, whatever the recall asks: below it "no secret" is the likelier reading.
        told[k] = a, b, max(0.5, float(found[int(np.floor((1 - RECALL) * len(found)))]))
    return told


def train(windows: list[tuple[str, int, int]], labels: np.ndarray, held_out: np.ndarray) -> Network:
    """The network with calibrated, recall-constrained thresholds. Kinds with too few findings are not learned."""
    counts = np.bincount(labels, minlength=1 + len(KINDS))
    kinds = [k for k in range(1, 1 + len(KINDS)) if counts[k] >= FEWEST and (held_out & (labels == k)).any()]
    if not kinds or not counts[0]:
        return Network({}, {})
    # What no pattern finds is not always none: those that look like findings by themselves are left out of the second training.
    fit = np.flatnonzero(~held_out)
    weights = train_weights([windows[i] for i in fit], labels[fit])
    sure = (labels > 0) | _looks_none(weights, windows)
    fit = np.flatnonzero(~held_out & sure)
    weights = train_weights([windows[i] for i in fit], labels[fit])
    return Network(weights, _kinds_told(kinds, logits_of(weights, windows)[held_out & sure], labels[held_out & sure]))


# --- over documents -----------------------------------------------------------------------

_SAMPLE = "label int, key long, window string, start int, end int"


def sample(docs: DataFrame, text: str = "text") -> DataFrame:
    """What the network learns from: every distinct labelled window, wherever it stands."""
    def run(batches):
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                held = {}
                for t in b.column(0).slice(at, ROWS).to_pylist():
                    for start, end, label in labelled(t or "", base_spans(t or "")):
                        seen, a, z = window(t, start, end)
                        key = xxhash.xxh3_64_intdigest(f"{a}:{z}:{seen}".encode("utf-8", "surrogatepass")) - (1 << 63)
                        held[label, key] = (label, key, seen, a, z)
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held.values()), kinds)], names=["label", "key", "window", "start", "end"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, _SAMPLE).dropDuplicates(["label", "key"])


def _windows(pdf: pd.DataFrame) -> tuple[list[tuple[str, int, int]], np.ndarray, np.ndarray]:
    """Windows in a fixed order, their labels, and which are held out."""
    pdf = pdf.sort_values(["label", "key"])
    return list(zip(pdf["window"], pdf["start"], pdf["end"])), pdf["label"].to_numpy(), (pdf["key"] % HELD_OUT == 0).to_numpy()


def _held_out() -> Column:
    return F.pmod("key", F.lit(HELD_OUT)) == 0


def _by_label(rows: DataFrame) -> np.ndarray:
    """How many rows there are of each label."""
    out = np.zeros(1 + len(KINDS), np.int64)
    for r in rows.groupBy("label").count().collect():  # a row per label
        out[r.label] = r["count"]
    return out


def _trained_in_shards(rows: DataFrame) -> dict[str, np.ndarray]:
    """Weights learned from all ``rows``: every round passes over all shards side by side and averages what they have learned."""
    cost, at = _costs(_by_label(rows)), _untrained(np.random.default_rng(SEED))

    def passed(start: bytes, k: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            state, (windows, labels, _), shard = pickle.loads(start), _windows(pdf), int(pdf["shard"].iloc[0])
            _round(state, windows, labels, cost, np.random.default_rng([SEED, k, shard]))
            return pd.DataFrame({"shard": [shard], "n": [len(windows)], "state": [pickle.dumps(state)]})
        return one

    for k in range(EPOCHS):
        done = stored(_in_shards(rows).groupBy("shard").applyInPandas(passed(pickle.dumps(at), k), "shard long, n long, state binary"), "learned")
        at = _averaged((r.n, pickle.loads(r.state)) for r in done.orderBy("shard").toLocalIterator())  # some 40 KB a shard, one at a time
        discard(done)
    return at.w


def _in_shards(rows: DataFrame) -> DataFrame:
    """A fixed number of partitions: shards are small in bytes but heavy in work, so never coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")


def _fit_in_shards(rows: DataFrame, shards: int) -> Network:
    """What ``train`` does, with no task that holds more than a shard, but for four numbers of each held-out window."""
    rows = stored(rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), "shards")
    counts, held = _by_label(rows), _by_label(rows.filter(_held_out()))
    kinds = [k for k in range(1, 1 + len(KINDS)) if counts[k] >= FEWEST and held[k]]
    if not kinds or not counts[0]:
        return Network({}, {})
    weights = _trained_in_shards(rows.filter(~_held_out()))

    def sure(pdf: pd.DataFrame) -> pd.DataFrame:
        windows, labels, _ = _windows(pdf)
        return pdf.sort_values(["label", "key"])[(labels > 0) | _looks_none(weights, windows)]

    kept = stored(_in_shards(rows).groupBy("shard").applyInPandas(sure, rows.schema), "sure")
    discard(rows)
    final = _trained_in_shards(kept.filter(~_held_out()))
    columns = [f"l{k}" for k in range(1 + len(KINDS))]

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        windows, labels, _ = _windows(pdf)
        return pd.DataFrame(logits_of(final, windows), columns=columns).assign(label=labels)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", *columns])
        return pd.DataFrame({"model": [pickle.dumps(Network(final, _kinds_told(kinds, pdf[columns].to_numpy(), pdf["label"].to_numpy())))]})

    logits = _in_shards(kept.filter(_held_out())).groupBy("shard").applyInPandas(judged, ", ".join(f"{c} double" for c in columns) + ", label int")
    model = logits.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(told, "model binary").collect()
    discard(kept)
    return pickle.loads(model[0].model) if model else Network({}, {})


def fit(docs: DataFrame, text: str = "text") -> Network:
    """Trained on every distinct labelled window, in one task or, where they are many, in shards side by side; its weights (some 50 KB)
    come to the driver."""
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(train(*_windows(pdf)))]})

    every = stored(sample(docs, text), "labelled-windows")
    shards = rows_per_part(docs.sparkSession, every.count(), SHARD)
    if shards > 1:
        model = _fit_in_shards(every, shards)
    else:
        rows = every.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(make, "model binary").collect()
        model = pickle.loads(rows[0].model) if rows else Network({}, {})
    discard(every)
    return model


def scan(texts: list[str | None], model: Network) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]]:
    """Per text its base spans, and all spans in order with their probability (1 for base spans)."""
    base, asked, owner = [], [], []
    for i, t in enumerate(texts):
        base.append(base_spans(t or ""))
        for start, end, label in labelled(t or "", base[i]) if model.kinds else ():
            if not label:
                asked.append((start, end))
                owner.append(i)
    found = model.findings([window(texts[i], *place) for i, place in zip(owner, asked)])
    every = [[(*s, 1.0) for s in spans] for spans in base]
    for i, (start, end), p in zip(owner, asked, found):
        if p:
            every[i].append((start, end, LEARNED, float(p)))
    order = {k: n for n, k in enumerate((*KINDS, LEARNED))}
    for spans, full in zip(base, every):
        yield spans, sorted(full, key=lambda x: (x[0], order[x[2]]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Network | None = None) -> DataFrame:
    """One row per document: ``id, n_assign, n_access, n_hex, spans``; spans hold kind, start, end (code points), probability.

    Without a ``model`` one is fitted on ``docs``. A null text counts as empty: no spans. Where too few findings are labelled no
    network is learned, and the patterns' spans stand alone. Repeated rows are answered each; a null id stays null; other
    columns are not read.
    """
    model = fit(docs, text) if model is None else model
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, "
              "spans array<struct<kind: string, start: long, end: long, probability: double>>")

    def run(ids, texts):
        counts, spans = {k: [] for k in KINDS}, []
        for base, every in scan(texts, model):
            for k in KINDS:
                counts[k].append(sum(x[2] == k for x in base))
            spans.append([{"kind": k, "start": a, "end": b, "probability": p} for a, b, k, p in every])
        return [ids, *counts.values(), spans]

    return arrow_map(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), run, schema)
