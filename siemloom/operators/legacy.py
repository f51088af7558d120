"""The older mapping profile: five vendors, other classes, scales and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import scales, times
from siemloom.functions import values as V
from siemloom.operators.normalize import received_ms

KEYS = {
    "splunk": ["action", "user", "src_user", "src_ip", "src"],
    "sentinel": ["EventResult", "EventStartTime", "TimeGenerated", "TargetUsername", "SrcIpAddr"],
    "ecs": ["user", "source", "event", "user.name", "source.ip", "event.outcome", "@timestamp"],
    "qradar": ["magnitude", "severity", "action", "status", "starttime", "devicetime", "sourceip", "sourceport",
               "destinationip", "destinationport", "username", "identityusername"],
    "logscale": ["@timestamp", "loglevel", "severity", "event_type", "action", "status", "outcome", "aip", "src_ip",
                 "endpoint_ip", "dst_ip", "user", "user_name"],
}


def _text_or(v: Column, default: str) -> Column:
    return F.when(V.truthy(v), V.text(v)).otherwise(F.lit(default))


def _truthy_text(v: Column) -> Column:
    return F.when(V.truthy(v), V.text(v))


def _iso_or_now(v: Column, now: Column) -> Column:
    return F.when(V.truthy(v), F.coalesce(times.iso_ms(V.text(v)), now)).otherwise(now)


def _recorded(m: Column, *pairs: tuple[str, ...]) -> Column:
    """Map of the source keys used to their values; per pair the first key that is set."""
    entries = []
    for keys in pairs:
        entry = F.when(V.is_set(m[keys[0]]), F.struct(F.lit(keys[0]).alias("key"), m[keys[0]].alias("value")))
        for k in keys[1:]:
            entry = entry.when(V.is_set(m[k]), F.struct(F.lit(k).alias("key"), m[k].alias("value")))
        entries.append(entry)
    return F.map_from_entries(V.compact(*entries))


def _row(class_uid: int, activity: Column, severity: Column, status: Column, time: Column, user: Column,
         src_ip: Column, dst_ip: Column | None = None, src_port: Column | None = None,
         dst_port: Column | None = None, recorded: Column | None = None, error: Column | None = None) -> Column:
    text, whole = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    return F.struct(
        F.lit(class_uid).alias("class_uid"), F.lit(X.CATEGORY_IAM).alias("category_uid"),
        activity.cast("int").alias("activity_id"), severity.cast("int").alias("severity_id"),
        status.cast("int").alias("status_id"), time.alias("time"), user.alias("user_name"),
        src_ip.alias("src_ip"), (whole if src_port is None else F.when(src_ip.isNotNull(), src_port)).alias("src_port"),
        (text if dst_ip is None else dst_ip).alias("dst_ip"),
        (whole if dst_port is None else F.when(dst_ip.isNotNull(), dst_port)).alias("dst_port"),
        (F.create_map().cast(V.EVENT_MAP) if recorded is None else recorded).alias("provenance"),
        (text if error is None else error).alias("error"))


def _splunk(m: Column, now: Column) -> Column:
    status = scales.status_of_words(V.Value.of(m["action"]), X.STATUS_WORDS_LEGACY["splunk"])
    return _row(X.CLASS_AUTHENTICATION, F.lit(1), F.lit(1), status, now,
                _text_or(V.first_truthy(m, ["user", "src_user"]), "Unknown"),
                _text_or(V.first_truthy(m, ["src_ip", "src"]), "0.0.0.0"))


def _sentinel(m: Column, now: Column) -> Column:
    status = scales.status_of_words(V.Value.of(m["EventResult"]), X.STATUS_WORDS_LEGACY["sentinel"], fold=False)
    return _row(X.CLASS_AUTHENTICATION, F.lit(1), F.lit(1), status,
                _iso_or_now(V.first_truthy(m, ["EventStartTime", "TimeGenerated"]), now),
                _text_or(m["TargetUsername"], "Unknown"), _truthy_text(m["SrcIpAddr"]))


def _ecs(m: Column, now: Column) -> Column:
    def inner(parent: str, name: str) -> Column:
        v = V.member(m[parent], name)
        return F.when(V.truthy(v), v).otherwise(m[f"{parent}.{name}"])

    status = scales.status_of_words(V.Value.of(inner("event", "outcome")), X.STATUS_WORDS_LEGACY["ecs"], fold=False)
    return _row(X.CLASS_AUTHENTICATION, F.lit(1), F.lit(1), status, _iso_or_now(m["@timestamp"], now),
                _text_or(inner("user", "name"), "Unknown"), _truthy_text(inner("source", "ip")))


def _lower(v: Column) -> Column:
    return F.coalesce(F.lower(V.text(v)), F.lit(""))


def _activity(v: Column) -> Column:
    return F.when(_lower(v).contains("logout"), X.ACTIVITY_LOGOFF).otherwise(X.ACTIVITY_LOGON)


def _qradar(m: Column, now: Column) -> Column:
    raw_time = V.first_set(m, ["starttime", "devicetime"])
    time = F.when(raw_time.isNull(), now).otherwise(V.Value.of(raw_time).whole)
    error = F.when(time.isNull(), F.format_string(X.MSG_BAD_INTEGER, V.text(raw_time)))
    status = scales.status_of_words(V.Value.of(m["status"]), X.STATUS_WORDS_LEGACY["qradar"])
    severity = scales.severity_of_magnitude_legacy(V.Value.of(V.first_set(m, ["magnitude", "severity"])))
    return _row(X.CLASS_AUTHENTICATION_LEGACY, _activity(m["action"]), severity, status, time,
                _truthy_text(V.first_set(m, ["username", "identityusername"])),
                _truthy_text(m["sourceip"]), _truthy_text(m["destinationip"]),
                V.Value.of(m["sourceport"]).whole, V.Value.of(m["destinationport"]).whole,
                _recorded(m, ("magnitude", "severity"), ("action",), ("status",), ("starttime", "devicetime"),
                          ("sourceip",), ("sourceport",), ("destinationip",), ("destinationport",),
                          ("username", "identityusername")), error)


def _logscale(m: Column, now: Column) -> Column:
    clock = V.Value.of(m["@timestamp"])
    time = F.when(clock.is_number, clock.number.try_cast("bigint")).when(
        clock.is_string, F.coalesce(times.iso_ms(clock.text), now)).otherwise(now)
    level = V.first_set(m, ["loglevel", "severity"])
    severity = F.when(level.isNull(), F.lit(1)).otherwise(scales.severity_of_words(
        V.Value.of(level), X.SEVERITY_WORDS_LOGSCALE_LEGACY, default=99))
    status = scales.status_of_words(
        V.Value.of(V.first_set(m, ["status", "outcome"])), X.STATUS_WORDS_LEGACY["logscale"])
    return _row(X.CLASS_AUTHENTICATION_LEGACY, _activity(V.first_set(m, ["event_type", "action"])), severity, status,
                time, _truthy_text(V.first_set(m, ["user", "user_name"])),
                _truthy_text(V.first_set(m, ["aip", "src_ip"])), _truthy_text(V.first_set(m, ["endpoint_ip", "dst_ip"])),
                recorded=_recorded(m, ("@timestamp",), ("loglevel", "severity"), ("event_type", "action"),
                                   ("status", "outcome"), ("aip", "src_ip"), ("endpoint_ip", "dst_ip"),
                                   ("user", "user_name")))


MAPPERS = {"splunk": _splunk, "sentinel": _sentinel, "ecs": _ecs, "qradar": _qradar, "logscale": _logscale}


def normalize_vendor(df: DataFrame, vendor: str, payload: str = "raw_payload",
                     received: str | None = "received_at_ms") -> DataFrame:
    """Add ``legacy``, the event of one vendor's rows in the older profile."""
    now = received_ms(df, received)
    df = V.parse_event(df.drop("m"), payload, KEYS[vendor])
    m = F.col("m")
    return df.withColumn("legacy", F.when(m.isNotNull(), MAPPERS[vendor](m, now))).drop("m")
