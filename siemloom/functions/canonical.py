"""Canonical forms of JSON texts: one for equality, from built-in functions, one to be hashed, from the standard library.

For equality, the text of a VARIANT, whose keys are sorted, is cut into its tokens (strings, numbers, words, punctuation), each is rewritten
on its own, and they are put together again. So values are reached at every depth without recursion.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive: a long string takes no stack.
_TOKENS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|true|false|null|[\[\]{},:])'
_HIGH = float(1 << 62)
_SPACE = re.compile(r"[ \t\n\r]*")
_LONG_NUMBER = re.compile(r"[0-9]{1001}")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(1))


def exact_whole(d: Column) -> Column:
    """All digits of a whole DOUBLE below 2^124, as text."""
    high = F.floor(d / F.lit(_HIGH)).cast("bigint")
    low = (d - high.cast("double") * F.lit(_HIGH)).cast("bigint")
    wide = high.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return wide.cast("decimal(38,0)").cast("string")


def _comparable(t: Column) -> Column:
    d = t.try_cast("double")
    is_number = t.rlike("^-?[0-9]")
    return (
        F.when(t == "true", F.lit("1")).when(t.isin("false", "-0"), F.lit("0"))
        .when(~is_number | t.rlike("^-?[0-9]+$"), t)
        .when((d % 1 == 0) & (F.abs(d) < float(1 << 124)), exact_whole(d))
        .otherwise(d.cast("string"))
    )


def comparable(text: Column) -> Column:
    """A text that is equal for equal values: numbers by value at every depth, whole or not, and true as 1; integers keep all their digits.

    Whole floating numbers of 2^124 and more equal only floating numbers.
    """
    return F.array_join(F.transform(tokens(text), _comparable), "")


# ------------------------------------------------------------------- to be hashed
def _members(pairs: list[tuple[str, object]]) -> dict[str, object]:
    members = dict(pairs)
    if len(members) < len(pairs):
        raise ValueError("a key repeats")
    return members


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_no_constant)
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


def hashable(text: str | None) -> str | None:
    """A JSON text in ASCII with sorted keys, without spaces, floating numbers in their shortest form; None when it is invalid.

    Keys that repeat within an object and numbers of more than 1,000 digits are invalid. What follows an object, an array or a string is not read.
    """
    if text is None or len(text) > 1000 and _LONG_NUMBER.search(text):
        return None
    try:
        value, end = _DECODER.raw_decode(text, _SPACE.match(text).end())
        if end < len(text) and not isinstance(value, (dict, list, str)) and _SPACE.match(text, end).end() < len(text):
            return None
        return _ENCODER.encode(value)
    except (ValueError, RecursionError):
        return None
