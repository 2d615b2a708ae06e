"""Small scalar expressions: URLs, severity, ratios, display numbers, stable hashes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.text import strip


def is_http_url(c: Column) -> Column:
    """An absolute HTTP(S) URL naming a host; any number of slashes after the scheme."""
    authority = F.regexp_extract(c, r"(?is)\Ahttps?:/*([^/?#]*)", 1)
    host = F.regexp_replace(authority, r"(?s)\A.*@", "")
    return F.coalesce(F.regexp_replace(host, r"(?s):[^:]*\z", "") != "", F.lit(False))


def severity_label(schema: Column, value: Column) -> Column:
    """The schema's name for a severity code; unknown codes keep their digits, other text
    passes through trimmed, blank is NULL."""
    text = strip(value)
    code = F.when(text.rlike(r"\A-?\d+\z"), text.try_cast("decimal(38,0)").cast("string"))
    pairs = [
        (f"{s}:{n}", names[i])
        for n, names in K.SEVERITY_NAMES.items()
        for i, s in enumerate(K.SCHEMAS)
    ]
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    named = F.coalesce(F.try_element_at(names, F.concat_ws(":", schema, code)), code)
    return F.when(code.isNotNull(), named).otherwise(F.nullif(text, F.lit("")))


def severity_code(name: Column) -> Column:
    """Code of a severity name in either vocabulary; NULL for a name that does not exist."""
    pairs = {n: code for code, names in K.SEVERITY_NAMES.items() for n in names}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(lookup, F.lower(strip(name))).cast("int")


def ratio(n: Column, d: Column) -> Column:
    """NULL for a zero denominator, never zero."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def half_up(c: Column, digits: int = 2) -> Column:
    """Display rounding, ties away from zero; a dash for NULL, NaN and infinities."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rounded = F.round(c.cast("decimal(38,18)"), digits)
    shown = rounded.cast(f"decimal(38,{digits})").cast("string")
    return F.when(ok, shown).otherwise(F.lit("—"))


def percent(part: Column, whole: Column) -> Column:
    """A share, half up: never ``0%`` for something and never ``100%`` for less than all."""
    scale = "decimal(27,6)"
    p, w = part.cast(scale), whole.cast(scale)
    rounded = F.round(p * 100 / w, 0).cast("int")
    return (
        F.when((w <= 0) | (p <= 0), F.lit("0%"))
        .when(p >= w, F.lit("100%"))
        .when(rounded < 1, F.lit("<1%"))
        .otherwise(F.concat(F.least(rounded, F.lit(99)).cast("string"), F.lit("%")))
    )


# ---------------------------------------------------------------- stable encoding
# Fixed format: n = null, s<bytes>:<text>, d<chars>:<number>, a<count>:<items>,
# o<count>:<sorted key/value pairs>.


def enc_text(c: Column) -> Column:
    tagged = F.concat(F.lit("s"), F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.coalesce(tagged, F.lit("n"))


def enc_int(c: Column) -> Column:
    text = c.cast("string")
    tagged = F.concat(F.lit("d"), F.length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(tagged, F.lit("n"))


def enc_list(items: Column) -> Column:
    """A list of texts (never NULL elements)."""
    body = F.array_join(F.transform(items, enc_text), "")
    return F.concat(F.lit("a"), F.size(items).cast("string"), F.lit(":"), body)


def enc_object(fields: dict[str, Column]) -> Column:
    """An object from already-encoded values; keys are sorted here."""
    parts: list[Column] = [F.lit(f"o{len(fields)}:")]
    for key in sorted(fields):
        parts += [F.lit(f"s{len(key.encode())}:{key}"), fields[key]]
    return F.concat(*parts)


def stable_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(enc_object(fields), 256)


def json_hash(document: Column) -> Column:
    """SHA-256 of a JSON document whatever its key order or number spelling: a VARIANT keeps
    its keys sorted and ``42.0`` and ``42`` are written the same."""
    return F.sha2(F.to_json(F.try_parse_json(document)), 256)
