"""Token ids of whole texts by public tokenizers of the ``tokenizers`` library, as little-endian 32-bit integers.

Both vocabularies split texts before white space, so that a text's ids are those of its stretches between such places, one
after the other. A worker remembers the ids of the stretches it has met; the library only sees new ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

from straitline.llm.common import hold_alone, load_tokenizer

#: Characters with Unicode's White_Space property (fixed values); Python's str.split takes four more, U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
#: What a text of ASCII alone holds if something else than one space or line break parts its words.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\v", "\f", "\r")
#: Letters of which no two compose or change each other, and which no rule but that for letters takes.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks that form a token of their own behind letters; the apostrophe, which also starts contractions, isn't among them.
PUNCTUATION = r"!-&(-/:-@\[-`{-~"
#: Stretches that a worker remembers at a time, besides as many that it remembered before.
REMEMBERED = 400_000


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it can be seen, else the next beyond 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(unseen)}


class Remembered(dict):
    """Ids by text. Those of a new text come from the generation before or are made; the one before that is forgotten."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes]):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = self.make(text)
        self[text] = ids
        return ids

    def renewed(self) -> Remembered:
        """Itself, or the next generation once it is full."""
        if len(self) <= REMEMBERED:
            return self
        self.before = {}
        return Remembered(self.make, self)


class Encoder:
    """Ids of whole texts. ``spaces``: white space is part of tokens; ``fold``: the vocabulary lower-cases."""

    def __init__(self, path: str, spaces: bool, fold: bool):
        self.tokenizer, self.spaces, self.fold = load_tokenizer(path), spaces, fold
        self.model = self.tokenizer.model
        self.pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+" if spaces else f"[^{SPACE}]+").findall
        self.plain = re.compile(f"(\\n?)({' ?' if spaces else ''}[{LETTER}]+)([{PUNCTUATION}]*)").fullmatch
        table = byte_characters()
        self.written = str.maketrans({c: "".join(table[b] for b in c.encode()) for c in map(chr, [10, 32, *range(0xC0, 0x100)])})
        self.space, self.line = table[32] if spaces else "", table[10]
        self.known, self.marks = Remembered(self._stretch, {}), Remembered(self._word, {})

    def _split(self, text: str) -> list[str]:
        """Stretches that tokens never cross.

        Where white space counts, a stretch is named without the one space before it, unless it has a line break; any other
        is named with a space that isn't its own.
        """
        if not self.spaces:
            return self.pieces(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if text.isascii():
            even = text[0] not in " \n" and text[-1] not in " \n" and not any(c in text for c in UNEVEN)
        else:
            even = text.split() == text.replace("\n", " ").split(" ") and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        if not even:
            return [p[1:] if p[0] == " " and p[1:] and not p[1].isspace() else " " + p for p in self.pieces(text)]
        # One space or line break between words and nothing else.
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = " " + parts[0]
        return parts

    def _word(self, written: str) -> bytes:
        """Ids of a single pre-token as the vocabulary writes it, straight from the library's model."""
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _stretch(self, name: str) -> bytes:
        """Ids of a stretch as named by ``_split``: those of its word without marks are looked up in turn."""
        if name.isascii() and name.isalpha() and (not self.fold or name.islower()):
            return self._word(self.space + name)
        if m := self.plain(name):
            line, body, mark = m.groups()
            if not self.spaces:
                line, low = "", body.lower() if self.fold else body
            else:
                low = " " + body if line and body[0] != " " else body
            if low != name:
                ids = self.known[low]
                if mark:
                    ids += self.marks[mark]
                return self.marks[self.line] + ids if line else ids
            return self._word((body[1:] if body[0] == " " else self.space + body).translate(self.written))
        if self.spaces:
            name = name[1:] if name[0] == " " else name if name[0] == "\n" else " " + name
        return array("I", self.tokenizer.encode_batch_fast([name], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, four bytes an id; none for a null text."""
        out = []
        for a in range(0, len(texts), 500):
            self.known, self.marks = self.known.renewed(), self.marks.renewed()
            get = self.known.__getitem__
            out += [b"".join(map(get, self._split(t))) if t else b"" for t in texts[a:a + 500]]
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaces: bool, fold: bool) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    hold_alone("tokens", forget)
    key = (path, spaces, fold)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaces, fold)
    return _encoders[key]


def forget() -> None:
    """Let go of what the worker's encoders remember, for work of another kind."""
    _encoders.clear()
    load_tokenizer.cache_clear()
