"""Lenient coercions of dissector values, as column expressions over VARIANT or text.

Dissectors write numbers as strings, wrap values in lists and leave fields out. A value is unwrapped one list level; what
can't be read takes a default. Texts are read by the grammar of Python's ``int`` and ``float``: signs, underscores between
digits, exponents, ``nan`` and ``inf``; white space around is ignored. No hexadecimal, no suffixes. Integers outside 64
bits and infinities can't be held by a long: ``as_int`` gives the default and ``overflows`` tells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "[0-9]+(_[0-9]+)*"
INTEGER = f"^[+-]?{_DIGITS}$"
DECIMAL = rf"^[+-]?(({_DIGITS})(\.({_DIGITS})?)?|\.({_DIGITS}))([eE][+-]?{_DIGITS})?$"
NAMED = r"(?i)^[+-]?(nan|inf|infinity)$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85 ]+|[\s\x1c-\x1f\x85 ]+$", "")


def text_to_double(text: Column) -> Column:
    """Null where the text isn't a number."""
    t = stripped(text)
    named = F.lower(F.regexp_replace(t, "^[+-]", ""))
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(named == "nan", F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    number = F.regexp_replace(t, "_", "").try_cast("double")
    return F.when(t.rlike(DECIMAL), number).when(t.rlike(NAMED), special)


def text_to_long(text: Column) -> Column:
    """Whole numbers as they are, others truncated towards zero; null where the text isn't a number or too large."""
    t = stripped(text)
    whole = F.when(t.rlike(INTEGER), F.regexp_replace(t, "_", "").try_cast("bigint"))
    d = text_to_double(text)
    # most texts are plain digits, for which nothing more is evaluated
    return F.coalesce(text.try_cast("bigint"), whole, F.when(~F.isnan(d) & (F.abs(d) < 9.3e18), d.try_cast("bigint")))


def overflows(text: Column) -> Column:
    """Whether the text is an infinity or beyond the range of doubles, which no integer column can hold."""
    return F.coalesce(F.abs(text.try_cast("double")) == float("inf"), F.lit(False))


def epoch(text: Column, default: float = 0.0) -> Column:
    """Seconds since 1970 from a number or an ISO-8601 time; times without an offset are UTC."""
    t = stripped(text)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    time = F.when(iso, F.try_to_timestamp(F.regexp_replace(t, r"(\.\d{6})\d+", "$1")))
    compact = F.when(t.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")))
    return F.coalesce(text_to_double(text), F.unix_micros(F.coalesce(time, compact)) / F.lit(1e6), F.lit(default))


def path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def unwrap(value: Column) -> Column:
    """The first element of a list, null for an empty one, else the value."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$[0]", "variant")).otherwise(value)


def child(value: Column, key: str) -> Column:
    """The value under ``key`` before unwrapping; null where ``value`` is no object."""
    return F.try_variant_get(value, path(key), "variant")


def as_text(value: Column) -> Column:
    """Scalars as Python writes them; null for null and missing."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.is_variant_null(value), F.lit(None).cast("string")).when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def number_text(value: Column) -> Column:
    """Text to read a number from: booleans are 1 and 0."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_int(value: Column, default: int = -1, wrapped: bool = True) -> Column:
    text = let(let(value, unwrap) if wrapped else value, number_text)
    return F.coalesce(let(text, text_to_long), F.lit(default).cast("bigint"))


def as_float(value: Column, default: float = 0.0, wrapped: bool = True) -> Column:
    text = let(let(value, unwrap) if wrapped else value, number_text)
    return F.coalesce(let(text, text_to_double), F.lit(default))


def as_str(value: Column, default: str = "") -> Column:
    return F.coalesce(let(let(value, unwrap), as_text), F.lit(default))


def as_epoch(value: Column, default: float = 0.0) -> Column:
    return let(let(let(value, unwrap), number_text), lambda text: epoch(text, default))


def truthy_text(value: Column) -> Column:
    """As ``as_text`` of an unwrapped value, but null for what Python takes for false: empty text, zero, false."""
    text = as_text(value)
    zero = (F.schema_of_variant(value) != "STRING") & F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.when((text != "") & (text != "False") & ~F.coalesce(zero, F.lit(False)), text)


# The same on JSON text, where the order of keys in the source matters.


def json_unwrap(text: Column) -> Column:
    return F.when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text)


