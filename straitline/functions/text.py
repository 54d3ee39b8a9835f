"""Column expressions over titles, URLs and landed text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from straitline import constants as K

STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"


def stripped(col: Column) -> Column:
    """Remove every kind of surrounding white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def present(col: Column) -> Column:
    """Null when the text is empty."""
    return F.when(F.length(col) > 0, col)


def contains_term(col: Column, terms: Iterable[str]) -> Column:
    """Any term as a whole word; a trailing ``s`` is allowed and hyphens separate words."""
    choices = "|".join(re.escape(term) for term in terms)
    return col.rlike(rf"(?U)(?<!\w)(?:{choices})s?(?!\w)")


def _given(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def match_corridors(title: Column, url: Column, themes: Column | None = None) -> Column:
    """Ordered array of corridors: clear names on topic first, then hints on shipping.

    Few rows name a corridor at all, so names are looked for first and the long word lists are
    only tried on rows that hold one.
    """
    haystack = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))
    clear, hinted = list(K.CORRIDOR_TERMS), list(K.CORRIDOR_HINT_TERMS)
    on_theme = F.lit(False)
    for theme in K.TOPIC_THEMES if themes is not None else ():
        on_theme = on_theme | F.coalesce(F.contains(themes, F.lit(theme)), F.lit(False))

    def names(text):
        return F.struct(
            text.alias("text"),
            *[contains_term(text, K.CORRIDOR_TERMS[c]).alias(f"n{i}") for i, c in enumerate(clear)],
            *[contains_term(text, K.CORRIDOR_HINT_TERMS[c]).alias(f"h{i}") for i, c in enumerate(hinted)])

    def gates(hit):
        named, hints = F.lit(False), F.lit(False)
        for i in range(len(clear)):
            named = named | hit[f"n{i}"]
        for i in range(len(hinted)):
            hints = hints | hit[f"h{i}"]
        maritime = F.when(named | hints, contains_term(hit["text"], K.MARITIME_TERMS)).otherwise(False)
        topical = F.when(named, on_theme | contains_term(hit["text"], K.TOPIC_TERMS)).otherwise(False)
        return F.struct(hit.alias("hit"), maritime.alias("maritime"), topical.alias("topical"))

    def corridors(gate):
        hit, topical = gate["hit"], gate["maritime"] | gate["topical"]
        found = [F.when(topical & hit[f"n{i}"], F.lit(c)) for i, c in enumerate(clear)]
        for i, c in enumerate(hinted):
            taken = topical & hit[f"n{clear.index(c)}"]
            found.append(F.when(~taken & gate["maritime"] & hit[f"h{i}"], F.lit(c)))
        return F.array_compact(F.array(*found))

    return _given(_given(_given(haystack, names), gates), corridors)


def first_corridor(matches: Column) -> Column:
    return F.try_element_at(matches, F.lit(1))


def _stamp_line(stamp: Column) -> Column:
    return F.concat(F.lit("seendate: "), F.date_format(stamp, STAMP_FORMAT))


def _labelled(label: str, col: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), present(col))


def bulk_raw_text(title: Column, corridor: Column, domain: Column, published_at: Column, seen_at: Column) -> Column:
    return F.concat_ws(
        "\n", title, _labelled("matched_corridor_query", corridor), _labelled("domain", domain),
        _stamp_line(F.coalesce(published_at, seen_at)),
    )


def search_raw_text(title: Column, corridor: Column, domain: Column, country: Column, seendate: Column) -> Column:
    return F.concat_ws(
        "\n", title, _labelled("matched_corridor_query", corridor), _labelled("domain", domain),
        _labelled("sourcecountry", country), _labelled("seendate", seendate),
    )


def feed_raw_text(body: Column, published_at: Column) -> Column:
    return F.concat_ws("\n", body, _stamp_line(published_at))


def parse_seendate(raw_text: Column) -> Column:
    """Timestamp of the first line starting with ``seendate:``, else null."""
    stamp = F.regexp_extract(raw_text, r"(?m)^seendate:\s*(\S+)", 1)
    return F.when(stamp.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(stamp, F.lit(STAMP_FORMAT)))


def parse_compact_ts(col: Column) -> Column:
    """``YYYYMMDDHHMMSS`` in UTC, else null."""
    digits = stripped(col)
    return F.when(digits.rlike(r"^\d{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def extract_tag(col: Column, tag: str) -> Column:
    """Text of the first ``<TAG>…</TAG>``; empty when missing."""
    return stripped(F.regexp_extract(F.coalesce(col, F.lit("")), rf"(?s)<{tag}>(.*?)</{tag}>", 1))


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def normalize_title(col: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))
