"""Personal data in whole texts, also where it is disguised, with spans in the source text.

A chain of transducers rewrites a text into a normal form: look-alike characters become ASCII, spelled digits become
digits, and written-out "at" and "dot" become their signs. Each keeps for every character of its output the source
characters it came from, so that what the detectors find in the normal form maps back to the source.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from straitline.llm.common import arrow_map, fresh, hold_alone

#: The base detectors' patterns (fixed values). Look-behinds only spare them what cannot start a match.
EMAIL_LOCAL, EMAIL_HOST = re.compile(r"[A-Za-z0-9._%+-]*\Z"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]


# --- detectors --------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, looked for from each "@": in time that follows the length, whatever stands before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL_HOST.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)
    return out


def detect(text: str) -> list[Span]:
    """Base spans of a text, leftmost and non-overlapping within their kind; matches that fail their test are dropped."""
    found = emails(text)
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# --- transducers ------------------------------------------------------------------

#: Cyrillic and Greek letters that look like Latin ones (fixed values).
LOOK_ALIKES = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕԁոΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
    "ABEKMHOPCTXaeopcyxijsdnABEZHIKMNOPTYXo")
#: Characters without width, often put between letters (fixed values).
UNSEEN = "­​‌‍⁠﻿"
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Words that stand for "@" and ".": in brackets anywhere between word characters, bare ones only between plain words.
IN_BRACKETS = r"[\[({<]\s*(at|dot)\s*[\])}>]"
SIGN_IN_BRACKETS = re.compile(IN_BRACKETS, re.I)
#: Bare words are looked for from each "at": a host with spelled dots after it, a name with or without them before it.
BARE_AT, BARE_HOST = re.compile(r"\sat(?=\s)", re.I), re.compile(r"[A-Za-z0-9-]+(?:\sdot\s[A-Za-z0-9-]+)+(?![A-Za-z0-9-])", re.I)
BARE_DOT_BEFORE = re.compile(r"\sdot\s\Z", re.I)
BARE = re.compile(r"\s(at|dot)\s", re.I)
_DIGIT = "|".join(DIGITS)
SPELLED = re.compile(rf"\b(?:plus|{_DIGIT})(?:[\s.-]+(?:{_DIGIT}|[0-9]+))*\b", re.I)
#: Figures before a spelled run, from their end backwards.
FIGURES_BEFORE = re.compile(r"(?:[\s.-]+[0-9]+(?![^\W_]))+")
SPELLED_WORD = re.compile(r"[A-Za-z]+|[0-9]+")


class Mapped:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text, self.spans = text, spans

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace stretches of the text; each new character stands for the whole stretch."""
        text, spans, last = [], [], 0
        for a, b, new in sorted(edits):
            if a < last:
                continue
            text += [self.text[last:a], new]
            spans += self.spans[last:a]
            spans += [(self.spans[a][0], self.spans[b - 1][1])] * len(new)
            last = b
        text.append(self.text[last:])
        spans += self.spans[last:]
        return Mapped("".join(text), spans)


def plain_character(c: str) -> str:
    """What a character reads as: ASCII for look-alikes and compatibility forms, nothing for those without width, else itself."""
    if c in UNSEEN:
        return ""
    if ord(c) < 128:
        return c
    new = c.translate(LOOK_ALIKES)
    if new == c and unicodedata.decomposition(c).startswith("<"):
        new = unicodedata.normalize("NFKC", c)
    if new == c and (digit := unicodedata.digit(c, None)) is not None:
        new = str(digit)
    return new if new.isascii() else c


def plain_characters(text: str) -> Mapped:
    """A text with each character as it reads."""
    out, spans = [], []
    for i, c in enumerate(text):
        new = plain_character(c) if ord(c) > 127 else c
        out.append(new)
        spans += [(i, i + 1)] * len(new)
    return Mapped("".join(out), spans)


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    """Signs in brackets with the blanks around them: start, end, word."""
    out, free = [], 0
    for x in SIGN_IN_BRACKETS.finditer(text):
        a, b = x.span()
        while a > free and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        out.append((a, b, x[1]))
        free = b
    return out


def _bare_addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses in bare words ("a dot b at c dot d"), looked for outwards from each "at"."""
    out, free = [], 0
    for x in BARE_AT.finditer(text):
        if x.start() < free or not (host := BARE_HOST.match(text, x.end() + 1)):
            continue
        start, end = None, x.start()
        while True:
            a = end
            while a > 0 and text[a - 1] in LOCAL:
                a -= 1
            if a == end or a < free:
                break
            start = a
            if "." in text[a:end] or not BARE_DOT_BEFORE.search(text, max(0, a - 5), a):
                break
            end = a - 5
        if start is not None:
            out.append((start, host.end()))
            free = host.end()
    return out


def signs(m: Mapped) -> Mapped:
    """Written-out "at" and "dot" as signs."""
    sign = lambda w: "@" if w.lower() == "at" else "."
    m = m.rewrite([(a, b, sign(w)) for a, b, w in _bracketed(m.text)])
    edits = []
    for a, b in _bare_addresses(m.text):
        edits += [(y.start(), y.end(), sign(y[1])) for y in BARE.finditer(m.text, a, b)]
    # "a at b dot c" overlaps in its spaces; a second pass takes what the first could not.
    m = m.rewrite(edits)
    # An address written with a real "@" may still spell its dots.
    return m.rewrite([(y.start(), y.end(), ".") for x in re.finditer(r"@[A-Za-z0-9-]+(?:\sdot\s[A-Za-z0-9-]+)+", m.text, re.I)
                      for y in re.finditer(r"\sdot\s", m.text[x.start():x.end()], re.I) for y in [_moved(y, x.start())]])


class _moved:
    """A match's span, further right."""

    def __init__(self, match: re.Match, by: int):
        self.a, self.b = match.start() + by, match.end() + by

    def start(self) -> int:
        return self.a

    def end(self) -> int:
        return self.b


def spelled_runs(text: str) -> list[tuple[int, int, int, int]]:
    """Spelled digits with the figures around them: start of the figures, first and end of the spelled words, end of the figures."""
    out, free = [], 0
    for x in SPELLED.finditer(text):
        words = [w for w in SPELLED_WORD.finditer(text, x.start(), x.end()) if w[0].isalpha()]
        a = x.start()
        if text[a:a + 4].lower() != "plus":  # walk back over figures, each after a gap
            low = a
            while low > free and (text[low - 1] in ".-" or text[low - 1].isspace() or "0" <= text[low - 1] <= "9"):
                low -= 1
            if m := FIGURES_BEFORE.match(text[low:a][::-1]) if low == 0 or not _wordlike(text[low - 1]) else FIGURES_BEFORE.match(_after_gap(text[low:a])[::-1]):
                a -= m.end()
        out.append((a, words[0].start(), words[-1].end(), x.end()))
        free = x.end()
    return out


def _wordlike(c: str) -> bool:
    return c.isalnum() or c == "_"


def _after_gap(part: str) -> str:
    """``part`` without the figures at its start, which belong to a word before it."""
    return part.lstrip("0123456789")


def digits(m: Mapped, left: bool, right: bool, dots: bool = False, apart: bool = False) -> Mapped:
    """Spelled digits as figures, a leading "plus" as its sign, and what stands in a run joined.

    ``left`` and ``right`` say whether figures before and after the spelled words join them; those that do not stay where
    they are, or ``apart`` on a line of their own. With ``dots``, single dots stay.
    """
    edits = []
    for a, first, last, b in spelled_runs(m.text):
        if apart and not left and a < first:
            edits.append((len(m.text[:first].rstrip(" \t\n\r.-")), first, "\n"))
        if apart and not right and last < b:
            edits.append((last, b - len(m.text[last:b].lstrip(" \t\n\r.-")), "\n"))
        end = None
        for w in SPELLED_WORD.finditer(m.text, a if left else first, b if right else last):
            if end is not None and not (dots and m.text[end:w.start()] == "."):
                edits.append((end, w.start(), ""))
            word = w[0].lower()
            edits.append((w.start(), w.end(), "+" if word == "plus" else DIGITS.get(word, w[0])))
            end = w.end()
    return m.rewrite([e for e in edits if e[0] < e[1]])


@functools.lru_cache(maxsize=1)
def odd() -> re.Pattern:
    """A character that reads as something else, or any beyond 16 bits: few texts have these, and a class without them is quick."""
    changed = [c for c in map(chr, range(128, 1 << 16)) if plain_character(c) != c]
    return re.compile(f"[{''.join(map(re.escape, changed))}]|[\U00010000-\U0010ffff]")


def disguised(text: str) -> bool:
    """Whether a text may differ from its normal form: whether any transducer finds something to rewrite."""
    low = text.lower()
    return "dot" in low or not text.isascii() and bool(odd().search(text)) or bool(SIGN_IN_BRACKETS.search(text)) \
        or ("plus" in low or any(w in low for w in DIGITS)) and bool(SPELLED.search(text))


def normal_forms(text: str) -> list[Mapped]:
    """The forms in which a text can be read: figures beside spelled digits belong to them or not, and so do dots."""
    plain = signs(plain_characters(text))
    forms = {}
    if any(w in plain.text.lower() for w in ("plus", *DIGITS)):
        for how in ((False, True), (True, True), (False, False), (True, False), (True, True, True),
                    (False, True, False, True), (False, False, False, True), (True, False, False, True)):
            m = digits(plain, *how)
            forms.setdefault(m.text, m)
    forms.setdefault(plain.text, plain)
    return [m for t, m in forms.items() if t != text]


def disguised_spans(text: str, base: list[Span], gate: bool = True) -> list[Span]:
    """Spans that only a normal form shows, none of which overlaps a base span or one of a form before."""
    if gate and not disguised(text):
        return []
    taken, out = bytearray(len(text)), []

    def take(spans):
        for _, a, b in spans:
            taken[a:b] = b"\1" * (b - a)

    take(base)
    for m in normal_forms(text):
        own = []
        for kind, a, b in detect(m.text):
            start, end = m.spans[a][0], m.spans[b - 1][1]
            if text[start:end] != m.text[a:b] and taken.find(1, start, end) < 0:
                own.append((kind, start, end))
        take(own)
        out += own
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind and start."""
    order = lambda s: (KINDS.index(s[0]), s[1])
    base = sorted(detect(text or ""), key=order)
    return base, sorted(base + disguised_spans(text or "", base), key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- operators --------------------------------------------------------------------

def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and hash are of the base spans; ``spans`` lists these and the disguised ones as kind:start:end (code points, end
    exclusive). Whole texts are read. A null text counts as empty: no spans. Repeated rows are answered each; a null id
    stays null; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(ids, texts):
        rows = []
        for doc, t in zip(ids, texts):
            base, every = find(t)
            kinds = [k for k, _, _ in base]
            rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
        return zip(*rows)

    return arrow_map(docs.select(f"`{id_col}`", f"`{text}`"), run,
                     f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with each span, overlapping ones together, replaced by its kind in angle brackets."""
    if not text:
        return text
    out, last = [], 0
    for kind, a, b in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; null and empty texts and all other columns stay as they are."""
    new = fresh("masked", docs)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        hold_alone("pii")
        return texts.map(masked, na_action="ignore")

    return docs.withColumn(new, mask(F.col(f"`{text}`"))).select(
        *(F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
