"""Field transformation: rename, convert and translate every member of an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import convert, times
from siemloom.functions import values as V


def renames(vendor: str, profile: str = "v2") -> dict[str, str]:
    table = dict(X.RENAMES.get(vendor, {}))
    if profile == "legacy":
        for absent in X.RENAMES_LEGACY_ABSENT.get(vendor, []):
            table.pop(absent)
    return table


def _table(vendor: str, profile: str) -> str:
    """The name under which a vendor's renames and words are listed."""
    return vendor if profile == "legacy" else vendor.lower().strip()


def _members(m: Column, vendor: str, profile: str) -> Column:
    """Members in payload order, each under its target and with the rule it is converted by; JSON nulls have none."""
    table, rules = renames(_table(vendor, profile), profile), _rules(vendor, profile)
    targets = {k: t for k, t in table.items() if k != t}
    # The rule goes with the target.
    by_key = V.literal_map({k: rules[table.get(k, k)] for k in table | rules if table.get(k, k) in rules})

    def member(e: Column) -> Column:
        key = F.coalesce(V.literal_map(targets)[e["key"]], e["key"]) if targets else e["key"]
        return F.struct(key.alias("key"), e["value"].alias("value"), F.when(~F.is_variant_null(e["value"]), by_key[e["key"]]).alias("rule"))

    return V.bind(F.transform(F.map_entries(m), member), _last_of_target)


def _last_of_target(members: Column) -> Column:
    """Of members sharing a target the last one; events without such are not searched."""
    targets = members["key"]
    last = F.filter(members, lambda e, i: ~F.array_contains(F.slice(targets, i + 2, F.size(targets)), e["key"]))
    return F.when(F.size(F.array_distinct(targets)) < F.size(targets), last).otherwise(members)


def _enums(vendors: Sequence[str], profile: str) -> list[tuple[str, str, dict]]:
    """Vendor, member and words of every enumeration."""
    tables = X.ENUMS_LEGACY if profile == "legacy" else X.ENUMS
    return [(v, name, words) for v in vendors for name, words in tables.get(_table(v, profile), {}).items()]


def _rules(vendor: str, profile: str) -> dict[str, str]:
    """Which rule a member is converted by: a vendor's words before those of its type."""
    legacy = profile == "legacy"
    rules = {f"{v}.{name}": [name] for v, name, _ in _enums([vendor], profile)} | {
        "whole": X.INTEGER_FIELDS, "time": X.TIMESTAMP_FIELDS_LEGACY if legacy else X.TIMESTAMP_FIELDS, "flag": X.BOOLEAN_FIELDS,
        "text": X.STRING_FIELDS, "duration": X.DURATION_FIELDS, "size": X.SIZE_FIELDS_LEGACY if legacy else X.SIZE_FIELDS,
    }
    return {field: rule for rule, fields in reversed(rules.items()) for field in fields}


def _translated(name: str, words: dict, v: Column, r: V.Value, profile: str) -> Column:
    before, read = v, r
    if name in X.STRING_FIELDS:
        before, read = convert.to_stripped(v, r), V.Value(F.lit("STRING"), V.strip(r.text))
    out = convert.to_enum(before, words, trim=profile != "legacy", r=read)
    return F.coalesce(V.as_variant(r.whole), out) if name in X.INTEGER_FIELDS else out


def _converted(members: Column, vendors: Sequence[str], profile: str) -> Column:
    """Type conversion, unit and enumeration of renamed members, by their rules; type and text are read once a member."""
    legacy = profile == "legacy"

    def read(e: Column) -> Column:
        return F.struct(*[e[c].alias(c) for c in ("key", "value", "rule")], F.when(e["rule"].isNotNull(), V.kind(e["value"])).alias("kind"),
                        F.when(e["rule"].isNotNull(), V.text(e["value"])).alias("text"))

    def convert_one(e: Column) -> Column:
        v, rule, r = e["value"], e["rule"], V.Value(e["kind"], e["text"])
        out = (
            F.when(rule.isNull(), v)
            .when(rule == "text", convert.to_stripped(v, r))
            .when(rule == "time", convert.to_iso_text(v, r) if legacy else times.converted_timestamp(v, r))
            .when((rule == "whole") | (rule == "size"), convert.to_whole(v, r))
            .when(rule == "flag", convert.to_boolean(v, floats=not legacy, r=r))
            .when(rule == "duration", convert.to_duration_legacy(v, r) if legacy else convert.to_duration(v, r))
        )
        for vendor, name, words in _enums(vendors, profile):
            out = out.when(rule == f"{vendor}.{name}", _translated(name, words, v, r, profile))
        return F.struct(e["key"].alias("key"), out.otherwise(v).alias("value"))

    return F.map_from_entries(F.transform(F.transform(members, read), convert_one))


def transform(m: Column, vendor: str, profile: str = "v2") -> Column:
    """Transformed members of a parsed event map; of members sharing a target the later one wins."""
    return _converted(_members(m, vendor, profile), [vendor], profile)


def parse_all(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Add ``m``: all members of the payload as exact values, in payload order."""
    return V.parse_event(df, payload, last=True)


def transform_events(df: DataFrame, vendors: list[str], payload: str = "raw_payload",
                     profile: str = "v2") -> DataFrame:
    """Add ``fields`` per the row's ``vendor`` and ``error`` for payloads that are no object."""
    df = parse_all(df, payload)
    chain = F.when(F.col("m").isNull(), None)
    for vendor in vendors:
        chain = chain.when(F.col("vendor") == vendor, _members(F.col("m"), vendor, profile))
    members = chain.otherwise(_members(F.col("m"), "", profile))
    return df.withColumn("fields", _converted(members, vendors, profile)).withColumn(
        "error", F.when(F.col("m").isNull(), F.lit(X.MSG_NOT_DICT))).drop("m")
