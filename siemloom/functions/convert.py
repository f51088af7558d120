"""Value conversions of the field transformation, VARIANT in and VARIANT out.

A value that does not convert passes through unchanged.  ``r`` is the value's type and text, where they are read already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siemloom.fixed_values import FALSE_WORDS, TRANSFORM_MS_FROM, TRUE_WORDS
from siemloom.functions import times
from siemloom.functions.values import Value, as_variant, bind, literal_map, strip


def to_whole(v: Column, r: Value | None = None) -> Column:
    return F.coalesce(as_variant((r or Value.of(v)).whole), v)


def to_boolean(v: Column, floats: bool = True, r: Value | None = None) -> Column:
    r = r or Value.of(v)
    word = F.lower(strip(r.text))
    numeric = r.is_number if floats else (r.type_name == "int")
    return (
        F.when(r.is_boolean, v)
        .when(r.is_string & word.isin(TRUE_WORDS), as_variant(F.lit(True)))
        .when(r.is_string & word.isin(FALSE_WORDS), as_variant(F.lit(False)))
        .when(numeric, as_variant(r.number != 0))
        .otherwise(v)
    )


def to_stripped(v: Column, r: Value | None = None) -> Column:
    return F.coalesce(as_variant(strip((r or Value.of(v)).text)), v)


def to_duration(v: Column, r: Value | None = None) -> Column:
    """Whole milliseconds of a number or number text."""
    r = r or Value.of(v)
    d = F.when(r.is_string, times.float_text(r.text)).when(r.is_number, r.number)
    return F.coalesce(as_variant(d.try_cast("bigint")), v)


def to_duration_legacy(v: Column, r: Value | None = None) -> Column:
    """Float milliseconds; texts need a unit of ms, s or m and otherwise stay (stripped, lower-case)."""
    r = r or Value.of(v)
    s = F.lower(strip(r.text))

    def scaled(suffix: int, factor: int) -> Column:
        return times.float_text(s.substr(F.lit(1), F.length(s) - suffix)) * factor

    ms = (
        F.when(s.endswith("ms"), scaled(2, 1))
        .when(s.endswith("s"), scaled(1, 1000))
        .when(s.endswith("m"), scaled(1, 60_000))
    )
    return (
        F.when(r.is_string, F.coalesce(as_variant(ms), as_variant(s)))
        .when(r.is_number, as_variant(r.number))
        .otherwise(v)
    )


def to_iso_text(v: Column, r: Value | None = None) -> Column:
    """Legacy timestamp: ISO text of an epoch number or an ISO text."""
    r = r or Value.of(v)
    d = r.number
    seconds = F.when(d > TRANSFORM_MS_FROM, d / 1000).otherwise(d)
    s = strip(r.text)
    return (
        F.when(r.is_string, as_variant(F.coalesce(bind(times.iso_ms(s), times.iso_text), s)))
        .when(r.is_number,
              F.coalesce(as_variant(bind((seconds * 1000).try_cast("bigint"), times.iso_text)), v))
        .otherwise(v)
    )


def to_enum(v: Column, words: dict, trim: bool = True, r: Value | None = None) -> Column:
    """Replace a known word, ignoring case; other values stay."""
    r = r or Value.of(v)
    word = F.lower(strip(r.text) if trim else r.text)
    hit = F.when(r.is_string, literal_map(words)[word])
    return F.coalesce(as_variant(hit), v)
