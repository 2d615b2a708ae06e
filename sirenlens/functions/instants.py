"""Instants: accepting ISO-8601 text and writing the one output format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMON = r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?\z"
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
_TIME = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
_ZONE = r"([+-]\d{2}(?::?\d{2})?)"
_GENERAL = rf"(?s)\A{_DATE}(?:.{_TIME}{_ZONE}?)?\z"


def _week_date(date: Column) -> Column:
    digits = F.regexp_replace(date, "[-W]", "")
    year, week = F.substring(digits, 1, 4).cast("int"), F.substring(digits, 5, 2).cast("int")
    day = F.coalesce(F.substring(digits, 7, 1).try_cast("int"), F.lit(1))
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    value = F.date_add(first, (week - 1) * 7 + day - 1)
    ok = day.between(1, 7) & (F.weekofyear(value) == week)
    return F.when(ok, F.date_format(value, "yyyy-MM-dd"))


def _assembled(p: Column) -> Column:
    """The instant of a matched text's ``date``, ``time`` and ``zone``."""
    date, time, zone = p["date"], p["time"], p["zone"]
    plain = F.regexp_replace(date, "-", "")
    day = F.when(date.contains("W"), _week_date(date)).otherwise(
        F.concat_ws(
            "-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2)
        )
    )
    digits = F.rpad(F.regexp_extract(time, r"\A(\d*)", 1), 6, "0")
    fraction = F.rpad(F.substring(F.regexp_extract(time, r"[.,](\d+)", 1), 1, 6), 6, "0")
    offset = F.when(
        zone != "",
        F.concat(F.substring(zone, 1, 3), F.lit(":"), F.rpad(F.substring(zone, 4, 2), 2, "0")),
    ).otherwise(F.lit("+00:00"))
    clock = F.concat_ws(
        ":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2)
    )
    return F.concat(day, F.lit(" "), clock, F.lit("."), fraction, offset).try_cast("timestamp")


def _general_form(c: Column) -> Column:
    """Step by step through lambdas, whose variables hold a step's values: each part is taken out of the
    text once. Text that does not match has no date and goes no further."""
    texts = F.transform(F.array(c), lambda v: F.regexp_replace(v, "Z", "+00:00"))
    dated = F.transform(
        texts, lambda t: F.struct(t.alias("text"), F.regexp_extract(t, _GENERAL, 1).alias("date"))
    )
    matched = F.filter(dated, lambda d: (d["date"] != "") & ~d["date"].startswith("0000"))
    bare = lambda d, k: F.regexp_replace(F.regexp_extract(d["text"], _GENERAL, k), ":", "")
    parts = F.transform(
        matched,
        lambda d: F.struct(d["date"].alias("date"), bare(d, 2).alias("time"), bare(d, 3).alias("zone")),
    )
    return F.get(F.transform(parts, _assembled), F.lit(0))


def parse_instant(c: Column) -> Column:
    """ISO-8601 text as a UTC instant, NULL when it is not one.

    Accepts the extended, basic and week-date forms, any one separator character, ``Z`` and
    offsets; text without an offset is UTC. Partial forms such as ``12:00`` or ``2026-8-2``,
    which a plain cast would accept, are rejected. The usual form is one match and one cast;
    the rare ones go through lambdas so that they stay out of the generated row loop.
    """
    return F.when(c.rlike(_COMMON) & ~c.startswith("0000"), c.try_cast("timestamp")).otherwise(
        _general_form(c)
    )


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)
