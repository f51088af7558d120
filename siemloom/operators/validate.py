"""Validation rules as arrays of error texts, in rule order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import times
from siemloom.functions import values as V
from siemloom.functions.texts import Texts


def _mandatory(m: Column) -> list[Column]:
    errors = [F.when(~V.is_set(m[f]), F.lit(X.MSG_MISSING_FIELD % f)) for f in X.MANDATORY_FIELDS]
    t = V.Value.of(m["time"])
    errors.append(F.when(t.is_set & ~t.is_number, F.format_string(X.MSG_TIME_TYPE, t.type_name)))
    return errors


def _objects(m: Column) -> list[Column]:
    errors = []
    for field in X.OBJECT_FIELDS:
        v = V.Value.of(m[field])
        errors.append(F.when(v.is_set & ~v.is_object, F.format_string(X.MSG_NOT_OBJECT, F.lit(field), v.type_name)))
        for name, expected in X.INNER_TYPES.get(field, []):
            inner = V.Value.of(V.member(m[field], name))
            good = inner.is_string if expected == "string" else inner.is_number
            errors.append(F.when(
                v.is_object & inner.is_set & ~good,
                F.format_string(X.MSG_INNER_TYPE, F.lit(field), F.lit(name), F.lit(expected), inner.type_name)))
    return errors


def _classes(m: Column) -> list[Column]:
    uid = V.Value.of(m["class_uid"])
    class_uid = F.when(uid.is_number, uid.number)
    network = [
        F.when((class_uid == X.CLASS_NETWORK) & ~V.has(m, f), F.lit(X.MSG_NETWORK % f))
        for f in ("src_endpoint", "dst_endpoint")
    ]
    no_one = (class_uid == X.CLASS_AUTHENTICATION) & ~V.has_any(m, ["user", "actor"])
    return [*network, F.when(no_one, F.lit(X.MSG_AUTHENTICATION))]


def event_errors(m: Column, profile: str = "v2") -> Column:
    """Errors of a whole event; ``profile`` is v2, legacy (no object checks), revalidation (fields only) or objects (their checks only)."""
    errors = [] if profile == "objects" else _mandatory(m)
    if profile in ("v2", "objects"):
        errors += _objects(m)
    if profile in ("v2", "legacy"):
        errors += _classes(m)
    return V.compact(*errors)


def validate_events(df: DataFrame, event: str = "event_json", profile: str = "v2") -> DataFrame:
    """Validate a column of event JSON; adds ``errors`` and ``is_valid``."""
    keys = list(dict.fromkeys(X.MANDATORY_FIELDS + X.OBJECT_FIELDS))
    df = V.parse_event(df, event, keys)
    df = df.withColumn("errors", event_errors(F.col("m"), profile)).drop("m")
    return df.withColumn("is_valid", F.size("errors") == 0)


def normalized_errors(event: Column) -> Column:
    """Errors of an event built by this package, whose other fields cannot be wrong."""
    errors = []
    for field in ("src_endpoint", "dst_endpoint"):
        ip = V.Value.of(event[field]["ip"])
        errors.append(F.when(
            ip.is_set & ~ip.is_string,
            F.format_string(X.MSG_INNER_TYPE, F.lit(field), F.lit("ip"), F.lit("string"), ip.type_name)))
    errors.insert(0, F.when(event["time"].isNull(), F.lit(X.MSG_MISSING_FIELD % "time")))
    errors.append(F.when(event["actor"].isNull(), F.lit(X.MSG_AUTHENTICATION)))
    return V.compact(*errors)


def payload_errors(e: Texts, whole: Column) -> Column:
    """Errors of a webhook payload; ``whole`` is the parsed document of any kind.

    ``e.m`` is NULL when the document is no object.
    """
    clock = F.coalesce(*[F.when(e[k].isNotNull(), F.lit(k)) for k in X.TIME_KEYS])
    clock_kind = F.coalesce(*[F.when(e[k].isNotNull(), e.kind(k)) for k in X.TIME_KEYS])
    clock_text = F.coalesce(*[e[k] for k in X.TIME_KEYS])
    value = V.Value(clock_kind, clock_text)
    filled = [e[k].isNotNull() & (e[k] != "") for k in X.DESCRIPTOR_KEYS + X.CONTEXT_KEYS]
    described = F.coalesce(*[F.when(f, F.lit(True)) for f in filled], F.lit(False))
    checks = V.compact(
        F.when(clock.isNull(), F.lit(X.MSG_NO_TIMESTAMP)),
        F.when(~described, F.lit(X.MSG_NO_CONTEXT)),
        F.when(clock.isNotNull() & ~times.readable_time(value),
               F.format_string(X.MSG_BAD_TIMESTAMP, clock, value.type_name)),
    )
    return (
        F.when(e.m.isNull(), F.array(F.format_string(X.MSG_PAYLOAD_TYPE, V.Value.of(whole).type_name)))
        .when(F.size(e.m) == 0, F.array(F.lit(X.MSG_PAYLOAD_EMPTY)))
        .otherwise(checks)
    )
