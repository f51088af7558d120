"""Severity and status scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions.values import Value, literal_map, strip


def _word(v: Value, trim: bool = False) -> Column:
    return F.lower(strip(v.text) if trim else v.text)


def severity_of_words(v: Value, words: dict, default: int = 1, trim: bool = False) -> Column:
    return F.coalesce(literal_map(words)[_word(v, trim)], F.lit(default))


def severity_of_hundred(v: Value) -> Column:
    """0-100 in steps of twenty to 1-5; unreadable values are 1."""
    level = F.lit(1) + F.floor(v.whole / 20)
    return F.coalesce(F.least(F.lit(5), F.greatest(F.lit(1), level)), F.lit(1)).cast("int")


def _magnitude(n: Column) -> Column:
    return F.when(n >= 9, 5).when(n >= 7, 4).when(n >= 5, 3).when(n >= 3, 2).otherwise(1)


def severity_of_magnitude(v: Value) -> Column:
    """1-10 to 1-5 in steps of two; unreadable values are 1."""
    return _magnitude(v.whole)


def severity_of_magnitude_legacy(v: Value) -> Column:
    n = F.coalesce(v.whole, F.lit(1))
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 6, 3).when(n <= 8, 4).otherwise(5)


def severity_of_mixed(v: Value, words: dict) -> Column:
    """Numbers up to 5 count as they are, larger ones as a magnitude; texts are words."""
    n = v.whole
    return (
        F.when(v.is_boolean, F.when(v.text == "true", 2).otherwise(1))
        .when(v.is_number, F.when(n <= 5, F.greatest(F.lit(1), n)).otherwise(_magnitude(n)))
        .otherwise(severity_of_words(v, words, trim=True))
    ).cast("int")


def status_of_words(v: Value, words: tuple[list, list], trim: bool = False, fold: bool = True) -> Column:
    """1 success, 2 failure, 99 anything else."""
    word = _word(v, trim) if fold else v.text
    good, bad = words
    return F.when(word.isin(good), 1).when(word.isin(bad), 2).otherwise(X.STATUS_UNKNOWN)
