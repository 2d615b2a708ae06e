"""Text normalization and catalogue matching, entirely inside generated code.

Whitespace here means Unicode whitespace plus the four information separators, so a value is
trimmed the same way whatever produced it. Spark's own ``trim`` strips spaces only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+", " ")


def normalize_field(c: Column) -> Column:
    """Trimmed, lowercase, single-spaced; punctuation stays (``n/a`` is a catalogue value)."""
    return collapse(F.lower(strip(c)))


def normalize_message(c: Column) -> Column:
    """:func:`normalize_field` without the outer punctuation, trimmed once more."""
    return strip(F.regexp_replace(normalize_field(c), r"\A\p{P}+|\p{P}+\z", ""))


def is_blank(c: Column) -> Column:
    """NULL, or nothing but whitespace. One forward scan to the first visible character."""
    return c.isNull() | ~F.coalesce(c.rlike(rf"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def _alternatives(phrases: Iterable[str]) -> str:
    return "|".join(f"{WS}+".join(re.escape(w) for w in p.split(" ")) for p in phrases)


def field_in(c: Column, phrases: Iterable[str]) -> Column:
    """``normalize_field(c)`` is one of ``phrases``: one anchored match, no intermediate
    strings, failing on the first character for ordinary values."""
    return F.coalesce(
        F.lower(c).rlike(rf"(?U)\A{WS}*(?:{_alternatives(phrases)}){WS}*\z"), F.lit(False)
    )


def message_in(c: Column, phrases: Iterable[str]) -> Column:
    """``normalize_message(c)`` is one of ``phrases``."""
    outer = rf"{WS}*\p{{P}}*{WS}*"
    return F.coalesce(
        F.lower(c).rlike(rf"(?U)\A{outer}(?:{_alternatives(phrases)}){outer}\z"), F.lit(False)
    )


def clip(c: Column, limit: int) -> Column:
    """Single-spaced text of at most ``limit`` characters, ending in an ellipsis when cut."""
    text = strip(collapse(c))
    head = F.regexp_replace(F.substring(text, 1, limit - 1), rf"(?U){WS}+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))


def id_list(c: Column) -> Column:
    """A comma-joined id list as an array, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(parts, lambda p: p != "")


def rule_number(c: Column) -> Column:
    return F.substring(c, 2, 8).cast("int")


def sort_rules(c: Column) -> Column:
    """Rule ids in numeric order (R2 before R10)."""
    keyed = F.transform(c, lambda r: F.struct(rule_number(r).alias("n"), r.alias("id")))
    return F.transform(F.array_sort(keyed), lambda s: s["id"])


def ids_contain(ids: Column, rule: Column | str) -> Column:
    """Membership in a comma-joined list; ``R1`` never matches ``R10``."""
    return F.array_contains(id_list(ids), rule)
