"""Licence notices: exact phrases by words, and short notices within a bounded number of edits.

A notice with at most k edits holds at least one of its k + 1 pieces unchanged. An automaton finds the pieces of all
notices in one pass over a text; around each hit the ``regex`` library's bounded-error matching decides.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from straitline.llm.common import arrow_map, ascii_lower

#: Phrases that count at each place where their words stand consecutively, with their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Short notices as words, with their labels and the edits allowed. Public licence wording.
NOTICES = (
    ("released under the mit license", "mit", 2),
    ("licensed under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 8),
    ("licensed under the apache license version 2 0", "apache-2", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc", 4),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa", 4),
    ("licensed under the gnu general public license", "gpl", 3),
    ("under the terms of the gnu general public license", "gpl", 4),
    ("under the terms of the gnu lesser general public license", "lgpl", 4),
    ("subject to the terms of the mozilla public license", "mpl-2", 4),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def normal_form(text: str | None) -> tuple[str, np.ndarray]:
    """The words between single spaces, with a space at either end, a character for each UTF-8 byte; and each one's source byte.

    A word is a run of digits, letters and anything beyond ASCII, after A-Z are lower-cased.
    """
    raw = np.frombuffer(ascii_lower(text), np.uint8)
    word = WORD_BYTE[raw]
    before = np.concatenate(([True], word[:-1])) if raw.size else word
    at = np.flatnonzero(word | before)  # of each gap its first byte
    chars = np.where(word[at], raw[at], 32).astype(np.uint8)
    if at.size and word[0]:
        at, chars = np.concatenate(([0], at)), np.concatenate((np.array([32], np.uint8), chars))
    if chars.size and chars[-1] != 32:
        at, chars = np.append(at, raw.size), np.append(chars, np.uint8(32))
    return chars.tobytes().decode("latin-1"), at


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``notice`` cut into edits + 1 pieces of about equal length, with their places."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=4)
def _compiled(notices: tuple):
    import ahocorasick
    import regex

    automaton, seeds = ahocorasick.Automaton(), {}
    for n, (notice, _, edits) in enumerate(notices):
        for at, piece in pieces(notice, edits):
            seeds.setdefault(piece, []).append((n, at))
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}") for notice, _, edits in notices]


def _matches(pattern, text: str, a: int, b: int) -> Iterator:
    """The best match of a stretch, then those of what lies before and behind it."""
    open_ = [(a, b)]
    while open_:
        a, b = open_.pop()
        if m := pattern.search(text, a, b):
            yield m
            open_ += [(a, m.start()), (m.end(), b)]


def fuzzy_spans(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, str, float]]:
    """Start, end, label and likeness of each notice found in a normal form, within its edits, best ones first on overlap."""
    automaton, patterns = _compiled(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, places) in automaton.iter(text):
        for n, at in places:
            notice, _, edits = notices[n]
            start = end + 1 - size - at
            a, b = max(0, start - edits), min(len(text), start + len(notice) + edits)
            spans = windows.setdefault(n, [])
            # Hits of one place share a window; windows stay short, since matching costs more than their length.
            if spans and spans[-1][0] <= a <= spans[-1][1] and b - spans[-1][0] <= 4 * len(notice):
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
    found = []
    for n, spans in windows.items():
        notice, label, _ = notices[n]
        for a, b in spans:
            for m in _matches(patterns[n], text, a, b):
                start, stop = m.span()
                start += len(m.group()) - len(m.group().lstrip(" "))
                stop -= len(m.group()) - len(m.group().rstrip(" "))
                found.append((start, stop, label, 1 - sum(m.fuzzy_counts) / len(notice)))
    kept: dict[str, list[tuple[int, int, str, float]]] = {}
    for x in sorted(set(found), key=lambda x: (-x[3], x[0], -x[1])):
        own = kept.setdefault(x[2], [])
        at = bisect_left(own, x)  # spans kept of a label do not overlap: only the neighbours can
        if (at == 0 or own[at - 1][1] <= x[0]) and (at == len(own) or x[1] <= own[at][0]):
            own.insert(at, x)
    return sorted(x for own in kept.values() for x in own)


def scan(text: str | None, notices: tuple = NOTICES) -> tuple:
    """Of one text: words, places of the base phrases, first and last place, base labels, all labels, score, spans."""
    form, at = normal_form(text)
    gaps = np.flatnonzero(np.frombuffer(form.encode("latin-1"), np.uint8) == 32)  # one before each word
    places, base = [], set()
    for phrase, label in BASE:
        i = form.find(f" {phrase} ")
        while i >= 0:
            places.append(int(np.searchsorted(gaps, i)))
            base.add(label)
            i = form.find(f" {phrase} ", i + 1)
    fuzzy = fuzzy_spans(form, notices)
    labels = base | {label for _, _, label, _ in fuzzy}
    spans = []
    if fuzzy:
        raw = np.frombuffer(ascii_lower(text), np.uint8)
        starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
        for a, b, label, likeness in fuzzy:
            spans.append({"label": label, "start": int(starts[at[a]]), "end": int(starts[min(raw.size, at[b - 1] + 1)]), "likeness": likeness})
    score = 1.0 if base else max((s["likeness"] for s in spans), default=0.0)
    return (max(0, len(gaps) - 1), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), float(score), spans)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """One row per document: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    Whole texts are read. ``first_word`` and ``last_word`` are null without a base phrase. ``spans`` hold label, start, end
    (code points, end exclusive) and likeness of each notice found. A null text counts as empty: no words, no labels, score 0.
    Repeated rows are answered each; a null id stays null; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, spans array<struct<label: string, start: long, end: long, likeness: double>>")

    def run(ids, texts):
        return [ids, *zip(*(scan(t, notices) for t in texts))]

    return arrow_map(docs.select(f"`{id_col}`", f"`{text}`"), run, schema)
