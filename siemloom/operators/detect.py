"""Vendor detection from top-level key signatures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions.texts import Texts, read_texts

UNKNOWN = "unknown"
Rule = tuple[str, Callable[[Texts], Column]]


def _qradar(e: Texts) -> Column:
    return (e.has("magnitude") & e.has("sourceip")) | e.has("starttime")


def _logscale(e: Texts) -> Column:
    return e.has("@timestamp") & e.has_any(["aip", "loglevel"])


def _webhook(e: Texts) -> Column:
    return e.has_any(X.WEBHOOK_DESCRIPTOR_SIGNATURE) & e.has_any(X.WEBHOOK_TIME_SIGNATURE)


def _dotted(e: Texts) -> Column:
    def prefixed(k: Column) -> Column:
        return reduce(lambda a, b: a | b, [k.startswith(p) for p in X.ECS_PREFIXES])

    return F.exists(e.keys, prefixed)


def _ecs(objects: list[str], clocks: list[str]) -> Callable[[Texts], Column]:
    return lambda e: (e.has_any(objects) & e.has_any(clocks)) | _dotted(e)


def _any_of(keys: list[str]) -> Callable[[Texts], Column]:
    return lambda e: e.has_any(keys)


# First match wins.
RULES: list[Rule] = [
    ("qradar", _qradar),
    ("logscale", _logscale),
    ("webhook", _webhook),
    ("splunk", _any_of(X.SPLUNK_SIGNATURE)),
    ("sentinel", _any_of(X.SENTINEL_SIGNATURE)),
    ("ecs", _ecs(X.ECS_OBJECTS, ["@timestamp", "timestamp"])),
]
LEGACY_RULES: list[Rule] = [
    ("qradar", _qradar),
    ("logscale", _logscale),
    ("splunk", _any_of(X.SPLUNK_SIGNATURE_LEGACY)),
    ("sentinel", _any_of(X.SENTINEL_SIGNATURE)),
    ("ecs", _ecs(X.ECS_OBJECTS_LEGACY, ["@timestamp"])),
]


def _first_match(e: Texts, outcomes: list) -> Column:
    chain = F.when(e.m.isNull(), F.lit(None))
    for outcome, rule in outcomes:
        chain = chain.when(rule(e), F.lit(outcome))
    return chain


def vendor_of(e: Texts, rules: list[Rule] = RULES) -> Column:
    """Vendor name of an event, ``unknown`` without a match, NULL when it is no object."""
    return _first_match(e, rules).otherwise(F.lit(UNKNOWN))


def vendor_number(e: Texts, rules: list[Rule], numbers: dict[str, int]) -> Column:
    """Like :func:`vendor_of` as a number, -1 without a match.

    Wide projections branch on the number.  It has to come from the rules and
    not from a lookup of the name: the optimizer takes lookups for cheap and
    would repeat them in every branch.
    """
    return _first_match(e, [(numbers[name], rule) for name, rule in rules]).otherwise(F.lit(-1))


def detect_vendor(df: DataFrame, payload: str = "raw_payload", profile: str = "v2") -> DataFrame:
    """Add ``m`` (the payload's members as texts) and ``vendor``."""
    if "m" not in df.columns:
        df = read_texts(df, payload)
    return df.withColumn("vendor", vendor_of(Texts(), RULES if profile == "v2" else LEGACY_RULES))


def is_splunk_payload(e: Texts, profile: str = "v2") -> Column:
    return e.has_any(X.SPLUNK_PAYLOAD_KEYS if profile == "v2" else X.SPLUNK_PAYLOAD_KEYS_LEGACY)
