"""Registered queries: one flat result per operator, over whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import convert, crypto, times
from siemloom.functions import values as V
from siemloom.functions.texts import Texts, read_texts
from siemloom.operators import (
    detect, legacy, lookup, mapping, normalize, objects, registry, revalidate, transform, validate, webhook,
)
from siemloom.operators.vendors import VENDORS, Field, Vendor
from siemloom.sources import derived as D
from siemloom.sources import batches, files, snapshots, tables
from siemloom.streaming import webhook_stream

Query = Callable[[SparkSession, str], DataFrame]


def _path(name: str) -> Column:
    return F.col(f"event.{name}")


def _flat_columns() -> dict[str, Column]:
    provenance = F.transform(
        _path("metadata.provenance"), lambda p: F.concat(p["ocsf_field"], F.lit("<"), p["raw_field"]))
    return {
        "time": _path("time"), "severity_id": _path("severity_id"), "status_id": _path("status_id"),
        "src_ip": V.text(_path("src_endpoint.ip")), "dst_ip": V.text(_path("dst_endpoint.ip")),
        "user_name": V.text(_path("actor.user.name")), "message": V.text(_path("message")),
        "has_src": _path("src_endpoint").isNotNull(), "has_dst": _path("dst_endpoint").isNotNull(),
        "has_actor": _path("actor").isNotNull(), "product": _path("metadata.product.name"),
        "provenance": F.array_join(provenance, ";"),
    }


FLAT = ["time", "severity_id", "status_id", "src_ip", "dst_ip", "user_name", "message",
        "has_src", "has_dst", "has_actor", "product", "provenance"]


def _field(name: str) -> Column:
    return _flat_columns()[name].alias(name)


def _flat(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    return df.select("raw_log_id", *more, *[_field(n) for n in names])


def _vendor(vendor: str, *names: str) -> Query:
    return lambda s, d: _flat(normalize.normalize_vendor(D.raw_logs(s, d), vendor), list(names or FLAT))


def _normalized(s: SparkSession, d: str) -> DataFrame:
    return normalize.normalize(D.raw_logs(s, d))


def _checked(s: SparkSession, d: str) -> DataFrame:
    return _normalized(s, d).withColumn(
        "errors", F.coalesce(validate.normalized_errors(F.col("event")), F.array().cast("array<string>")))


# ---------------------------------------------------------------- A and B rows
def a2_batches(s, d):
    batches = D.raw_logs(s, d).withColumn("batch_id", F.floor(F.sqrt(F.col("raw_log_id"))).cast("bigint") % 7)
    out = tables.accept_batches(batches, "batch_id", "raw_log_id")
    return out.groupBy("batch_id", "accepted").agg(F.count(F.lit(1)).alias("n"))


def a3_raw_logs(s, d):
    t = tables.raw_log_table(detect.detect_vendor(D.raw_logs(s, d)))
    return t.groupBy("vendor_source", F.date_format("received_date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


def a4_events(s, d):
    t = tables.event_table(_normalized(s, d))
    return t.select("raw_log_id", "class_uid", "category_uid", "activity_id", "severity_id", "event_time_ms",
                    F.get_json_object("payload", "$.src_endpoint.ip").alias("src_ip"),
                    F.date_format("event_date", "yyyy-MM-dd").alias("day"))


def a5_audit(s, d):
    return tables.audit_table(_checked(s, d))


def a6_vendor_configs(s, d):
    seen = detect.detect_vendor(D.raw_logs(s, d)).filter(F.col("vendor").isNotNull()).select(
        F.col("vendor").alias("vendor_name")).distinct()
    existing = seen.select("vendor_name", F.lit("Custom").alias("adapter_class"), F.lit(True).alias("is_active"))
    return tables.insert_absent(existing, tables.vendor_seed(s), "vendor_name")


def a7_dead_letters(s, d):
    df = _checked(s, d)
    failed = df.filter(~F.col("success"))
    dead = tables.dead_letters(failed, F.lit("normalization_failed"), F.array("error"), F.col("raw_payload"),
                               F.col("received_at_ms"))
    return dead.select("raw_log_id", "failure_reason", F.array_join("validation_errors", ";").alias("errors"),
                       F.col("dead_payload").alias("payload"), "dlq_timestamp")


def a9_purge(s, d):
    dead = a7_dead_letters(s, d)
    return tables.purge(dead, F.col("dlq_timestamp") >= 1704672000000)


def a13_spec_usage(s, d):
    keys = read_texts(D.raw_logs(s, d)).select(F.explode(F.map_keys("m")).alias("source_field"))
    used = keys.groupBy("source_field").agg(F.count(F.lit(1)).alias("n"))
    spec = mapping.spec_rows(s)  # a few dozen rows
    return F.broadcast(spec).join(used, "source_field").select(
        "source_schema", "class_name", "source_field", "target_field", "n")


def a14_deliveries(s, d):
    return D.deliveries(s, d).select("delivery_id", "connector_id", F.length("raw_body").alias("n_chars"))


def _detect(profile: str) -> Query:
    def run(s, d):
        return detect.detect_vendor(D.raw_logs(s, d), profile=profile).select("raw_log_id", "vendor")
    return run


def _is_splunk(profile: str) -> Query:
    def run(s, d):
        df = read_texts(D.raw_logs(s, d))
        return df.select("raw_log_id", detect.is_splunk_payload(Texts(), profile).alias("is_splunk"))
    return run


def b5_unknown(s, d):
    return _normalized(s, d).select("raw_log_id", "success", "error")


# --------------------------------------------------------------- C rows, F rows
def _on_all(keys: list[str], columns: Callable[[Column], dict[str, Column]], source=D.raw_logs) -> Query:
    def run(s, d):
        df = V.parse_event(source(s, d), "raw_payload", keys)
        return df.select("raw_log_id", *[c.alias(n) for n, c in columns(F.col("m")).items()])
    return run


C1 = _on_all(["magnitude", "severity", "sourceport", "user", "src_user"], lambda m: {
    "first": V.text(V.first_truthy(m, ["magnitude", "severity", "sourceport"])),
    "user_name": V.text(V.first_truthy(m, ["user", "src_user"]))})
C2 = _on_all(["username", "user", "src_user", "status", "outcome"], lambda m: {
    "user_key": V.first_present(m, ["username", "user", "src_user"]),
    "status_key": V.first_present(m, ["status", "outcome"])})
C3 = _on_all(["username", "user", "source"], lambda m: {
    "value": V.text(V.first_set(m, ["username", "source.ip", "user"]))})
C4 = _on_all(["username", "user", "source"], lambda m: {
    "key": V.first_set_name(m, ["username", "source.ip", "user"])})
C5 = _on_all(["event", "event.severity", "event.outcome", "source", "source.ip"], lambda m: {
    "severity": V.text(V.nested_or_flat(m, "event.severity")),
    "outcome": V.text(V.nested_or_flat(m, "event.outcome")),
    "ip": V.text(V.nested_or_flat(m, "source.ip"))})
C6 = _on_all(["user_name", "user", "port", "pid"], lambda m: {
    "name": V.text(V.extract(m, ["user_name", "user"])), "pid": V.text(V.extract(m, "pid"))}, D.assets)


def c7_provenance(s, d):
    df = V.parse_event(D.assets(s, d), "raw_payload", ["user_name", "username", "user", "user_uid", "user_sid",
                       "user_id", "user_domain", "domain", "user_email", "email_addr", "user_type_id"])
    prov = objects.provenance(F.col("m"), "user", X.USER_FIELDS)
    return df.select("raw_log_id", *[
        F.concat(prov[f"mapped.user.{n}"]["original_field"], F.lit("="),
                 V.text(prov[f"mapped.user.{n}"]["original_value"])).alias(n) for n in ("name", "uid", "type_id")])


F7 = _on_all(["_time", "TimeGenerated", "starttime", "event_time"], lambda m: {
    "splunk": V.text(times.converted_timestamp(m["_time"])), "sentinel": V.text(times.converted_timestamp(m["TimeGenerated"])),
    "qradar": V.text(times.converted_timestamp(m["starttime"])), "webhook": V.text(times.converted_timestamp(m["event_time"]))})
F8 = _on_all(["TimeGenerated", "starttime"], lambda m: {
    "sentinel": V.text(convert.to_iso_text(m["TimeGenerated"])), "qradar": V.text(convert.to_iso_text(m["starttime"]))})
F9 = _on_all(["enabled", "pid"], lambda m: {
    "enabled": V.text(convert.to_boolean(m["enabled"])), "pid": V.text(convert.to_boolean(m["pid"]))}, D.assets)
F10 = _on_all(["enabled", "pid"], lambda m: {
    "enabled": V.text(convert.to_boolean(m["enabled"], floats=False)),
    "pid": V.text(convert.to_boolean(m["pid"], floats=False))}, D.assets)
F11 = _on_all(["port"], lambda m: {"port": V.text(convert.to_whole(m["port"]))}, D.assets)
F12 = _on_all(["port", "pid"], lambda m: {"port": objects.best_int(m["port"]), "pid": objects.best_int(m["pid"])}, D.assets)
F13 = _on_all(["port", "pid"], lambda m: {"port": objects.bool_int(m["port"]), "pid": objects.bool_int(m["pid"])}, D.assets)
F14 = _on_all(["src_ip", "result"], lambda m: {
    "src_ip": V.text(convert.to_stripped(m["src_ip"])), "result": V.text(convert.to_stripped(m["result"]))})
F15 = _on_all(["size_bytes", "duration"], lambda m: {
    "size_bytes": V.text(convert.to_whole(m["size_bytes"])), "duration": V.text(convert.to_duration(m["duration"]))}, D.assets)
F16 = _on_all(["duration"], lambda m: {"duration": V.text(convert.to_duration_legacy(m["duration"])).try_cast("double")}, D.assets)
F17 = _on_all(["SeverityLevel", "action"], lambda m: {
    "severity": V.text(convert.to_enum(m["SeverityLevel"], X.ENUMS["sentinel"]["severity"])),
    "action": V.text(convert.to_enum(m["action"], X.ENUMS["splunk"]["action"]))})
F18 = _on_all(["SeverityLevel", "loglevel"], lambda m: {
    "severity": V.text(convert.to_enum(m["SeverityLevel"], X.ENUMS_LEGACY["sentinel"]["severity"], trim=False)),
    "level": V.text(convert.to_enum(m["loglevel"], X.ENUMS_LEGACY["logscale"]["severity"], trim=False))})
F35 = _on_all(["starttime", "source", "src_ip", "username"], lambda m: {
    k: V.Value.of(m[k]).type_name for k in ("starttime", "source", "src_ip", "username")})


def f33_hash(s, d):
    r = D.revalidation_requests(s, d)
    return r.select("arrival_seq", crypto.request_hash(F.col("event_id"), F.col("original_event"), F.col("updated_event")).alias("h"))


def f34_sign(s, d):
    c = D.connectors(s).select(F.col("id").alias("connector_id"), "secret")
    r = lookup.dimension_join(D.deliveries(s, d), c, "connector_id", F.col("delivery_id"))
    return r.select("delivery_id", crypto.sign(F.col("secret"), F.col("raw_body")).alias("signature"))


# ---------------------------------------------------------------------- N rows
def n7_splunk_compat(s, d):
    df = normalize.splunk_compat(D.raw_logs(s, d))
    return df.select("raw_log_id", _field("time"), V.text(F.col("user.name")).alias("user_name"),
                     V.text(F.col("device.ip")).alias("device_ip"))


LEGACY_FLAT = ["class_uid", "activity_id", "severity_id", "status_id", "time", "user_name", "src_ip", "src_port", "dst_ip", "dst_port"]


def _legacy(vendor: str, *names: str) -> Query:
    def run(s, d):
        df = legacy.normalize_vendor(D.raw_logs(s, d), vendor)
        prov = F.array_join(F.array_sort(F.map_keys("legacy.provenance")), ";")
        return df.select("raw_log_id", *[F.col(f"legacy.{c}").alias(c) for c in names or LEGACY_FLAT], prov.alias("provenance"))
    return run


def n13_dispatch(s, d):
    return _flat(_normalized(s, d), list(FLAT), "vendor")


def n14_batch(s, d):
    return _normalized(s, d).select("raw_log_id", "success", "error", _field("time"))


def n15_summary(s, d):
    return normalize.summarize(_normalized(s, d))


# ---------------------------------------------------------------------- O rows
def _object(keys: list[str], build: Callable[[Column], Column], fields: dict[str, str]) -> Query:
    def run(s, d):
        df = V.parse_event(D.assets(s, d), "raw_payload", keys).withColumn("o", build(F.col("m")))
        return df.select("raw_log_id", F.col("o").isNotNull().alias("built"),
                         *[F.col(f"o.{p}").alias(n) for n, p in fields.items()])
    return run


_FILE_KEYS = ["file_name", "file_path", "file_size", "file_uid", "file_type_id", "file_parent_folder", "file_hashes", *X.HASH_FIELDS.values()]
_USER_KEYS = ["user_name", "username", "user", "user_uid", "user_sid", "user_id", "user_domain", "domain", "user_email", "email_addr", "user_type_id", "groups"]
_PROCESS_KEYS = list(X.PROCESS_FIELDS.values())
_DEVICE_KEYS = list(X.DEVICE_FIELDS.values())


def o1_user(s, d):
    df = V.parse_event(D.assets(s, d), "raw_payload", _USER_KEYS)
    o = objects.user(F.col("m"), {"groups": "groups"})
    df = df.withColumn("o", o)
    groups = F.array_join(F.transform("o.groups", lambda g: F.concat_ws("/", g["name"], g["uid"])), ";")
    return df.select("raw_log_id", "o.name", "o.uid", "o.type_id", groups.alias("group_names"))


O2 = _object(list(X.ENDPOINT_FIELDS), objects.endpoint, {"ip": "ip", "port": "port", "mac": "mac"})
O3 = _object(list(X.HASH_FIELDS.values()), objects.hashes, {"sha256": "sha256"})
O4 = _object(_FILE_KEYS, objects.file, {"name": "name", "size": "size", "md5": "hashes.md5"})
O5 = _object(_PROCESS_KEYS, objects.process, {"pid": "pid", "name": "name", "user_name": "user.name"})
O6 = _object(_DEVICE_KEYS, objects.device, {"name": "name", "os": "os.name", "os_version": "os.version"})
O7 = _object(["actor_user", "session_uid", "actor_type_id", "pid", *_PROCESS_KEYS[1:]],
             lambda m: objects.actor(m, {"process": {"name": "process_name"}}),
             {"user_name": "user.name", "session_uid": "session_uid", "process": "process.name"})
U1 = _object(list(X.ENDPOINT_FIELDS),
             lambda m: objects.endpoint(m, {"hostname": lambda e: V.as_variant(F.concat(F.lit("host-"), V.text(e["ip"])))}),
             {"ip": "ip", "hostname": "hostname"})


# ---------------------------------------------------------------------- T rows
TRANSFORMED = ["src_ip", "dst_ip", "src_port", "user_name", "severity", "timestamp", "outcome", "action", "status"]


def _transform(profile: str) -> Query:
    def run(s, d):
        df = detect.detect_vendor(D.raw_logs(s, d)).drop("m")
        df = transform.transform_events(df, list(X.RENAMES), profile=profile)
        return df.select("raw_log_id", *[V.text(F.col("fields")[c]).alias(c) for c in TRANSFORMED])
    return run


def t3_not_dict(s, d):
    df = detect.detect_vendor(D.raw_logs(s, d)).drop("m")
    return transform.transform_events(df, ["splunk"]).select("raw_log_id", "error")


def _spec(schema: str, name: str, columns: dict[str, str]) -> Query:
    def run(s, d):
        df = mapping.apply_spec(D.raw_logs(s, d), X.MAPPING_SPECS[schema][name])
        return df.select("raw_log_id", *[F.col(f"event.{p}").alias(n) for n, p in columns.items()])
    return run


T4_COLUMNS = {
    "splunk": {"class_uid": "class_uid", "time": "time", "user_name": "user.name", "status_id": "status_id"},
    "asim": {"class_uid": "class_uid", "time": "time", "src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "dst_ip": "dst_endpoint.ip",
             "status": "status", "status_id": "status_id"},
    "ecs": {"class_uid": "class_uid", "time": "time", "user_name": "user.name", "src_ip": "src_endpoint.ip", "status_id": "status_id"},
}
T4S = _spec("Splunk_CIM", "Authentication", T4_COLUMNS["splunk"])
T4A = _spec("ASIM", "NetworkSession", T4_COLUMNS["asim"])
T4E = _spec("ECS", "Authentication", T4_COLUMNS["ecs"])


def t5_template(s, d):
    df = mapping.apply_template(D.assets(s, d), X.WINDOWS_AUTH_TEMPLATE)
    return df.select("raw_log_id", F.col("event.class_uid").alias("class_uid"), F.col("event.user.name").alias("user_name"),
                     F.col("event.device.ip").alias("ip"), F.col("event.device.port").alias("port"),
                     F.col("event.actor.user.name").alias("actor"))


def t6_typed(s, d):
    keys = ["activity_id", "category_uid", "class_uid", "severity_id", "status_id", "user", "device", "actor"]
    df = V.parse_event(D.candidates(s, d), "event_json", keys)
    return df.select("raw_log_id", F.array_join(mapping.typed_errors(F.col("m")), ";").alias("errors"))


def t7_typed_event(s, d):
    df = V.parse_event(D.candidates(s, d), "event_json", mapping.TYPED_KEYS)
    e = mapping.typed_event(F.col("m"), "authentication")
    df = df.withColumn("e", e)
    return df.select("raw_log_id", "e.class_uid", "e.category_uid", "e.activity_id", "e.severity_id", "e.status_id", "e.time")


# ---------------------------------------------------------------------- V rows
def _validate(profile: str) -> Query:
    def run(s, d):
        df = validate.validate_events(D.candidates(s, d), profile=profile)
        return df.select("raw_log_id", "is_valid", F.array_join("errors", ";").alias("errors"))
    return run


def v5_payload(s, d):
    df = D.deliveries(s, d)
    df = df.withColumn("raw_log_id", F.col("delivery_id"))
    from siemloom.functions.texts import with_document
    df = with_document(read_texts(df, "raw_body"), "raw_body").withColumn("whole", V.any_json(F.col("raw_body")))
    errors = F.when(F.col("m").isNotNull() | F.col("whole").isNotNull(), validate.payload_errors(Texts(), F.col("whole")))
    return df.select("delivery_id", F.array_join(errors, ";").alias("errors"))


V6 = _on_all(["event_time", "TimeGenerated", "action"], lambda m: {
    k: times.readable_time(V.Value.of(m[k])) for k in ("event_time", "TimeGenerated", "action")})


def v7_split(s, d):
    side = F.when(F.col("success") & (F.size("errors") == 0), F.lit("valid")).otherwise(F.lit("dead"))
    return _checked(s, d).select("raw_log_id", side.alias("side"))


# ---------------------------------------------------------------------- W rows
def _ingested(s, d):
    return webhook.ingest(D.deliveries(s, d), D.connectors(s))


def w1_register(s, d):
    requests = D.from_table(s, d, D.CONNECTOR_REQUESTS, "orders")
    before = D.from_table(s, d, D.CONNECTORS_BEFORE, "customer")
    return webhook.register(requests, before).select("seq", "id", "outcome")


def w2_listed(s, d):
    return webhook.listed(D.from_table(s, d, D.CONNECTORS_BEFORE, "customer"))


def w3_delete(s, d):
    before = D.from_table(s, d, D.CONNECTORS_BEFORE, "customer")
    gone = D.from_table(s, d, D.CONNECTOR_REQUESTS, "orders")
    return webhook.without(before, gone, "id").select("id", "name")


def w4_lookup(s, d):
    df = webhook.authenticate(D.deliveries(s, d), D.connectors(s))
    return df.select("delivery_id", (F.col("auth") != "connector_not_found").alias("known"))


def w5_auth(s, d):
    return webhook.authenticate(D.deliveries(s, d), D.connectors(s)).select("delivery_id", "auth")


def w5_auth_hmac(s, d):
    c = D.connectors(s).select(F.col("id").alias("connector_id"), "secret")
    df = lookup.dimension_join(D.deliveries(s, d), c, "connector_id", F.col("delivery_id"))
    # Of three deliveries one is signed, one signed without the prefix, and one has the signature of another body.
    third = F.col("delivery_id") % 3
    body = F.concat(F.col("raw_body"), F.when(third == 2, " ").otherwise(""))
    prefix = F.when(third == 1, "").otherwise(" SHA256=")
    df = df.withColumn("signature_hdr", F.concat(prefix, crypto.sign(F.col("secret"), body))).drop("secret")
    return webhook.authenticate(df.withColumn("secret_hdr", F.lit("wrong")), D.connectors(s)).select("delivery_id", "auth")


def w6_json(s, d):
    df = read_texts(D.deliveries(s, d), "raw_body")
    return df.select("delivery_id", (F.col("m").isNotNull() | V.any_json(F.col("raw_body")).isNotNull()).alias("is_json"))


def w7_ingest(s, d):
    return _ingested(s, d).select("delivery_id", "outcome", F.array_join("errors", ";").alias("errors"),
                                  _field("time"), _field("status_id"))


def w8_health(s, d):
    return webhook.health_counters(webhook.delivery_status(_ingested(s, d))).select("connector_id", *webhook.COUNTERS)


def w9_report(s, d):
    return webhook.health_report(webhook.health_counters(webhook.delivery_status(_ingested(s, d)))).orderBy("connector_id")


# ---------------------------------------------------------------- R and X rows
def r1_register(s, d):
    requests = D.from_table(s, d, D.CLASS_REQUESTS, "orders")
    before = D.from_table(s, d, D.CLASSES_BEFORE, "customer")
    return registry.register(requests, before).select("seq", "outcome")


def r2_listed(s, d):
    classes = D.from_table(s, d, D.CLASS_REQUESTS, "orders").withColumn("created_at", F.col("seq"))
    return registry.listed(classes, "org-7").select("id", "organization", "class_uid")


def r3_find(s, d):
    classes = D.from_table(s, d, D.CLASS_REQUESTS, "orders")
    wanted = s.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("id-"), F.col("l_orderkey") + F.col("l_linenumber")).alias("id"))
    return registry.find(wanted, classes).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def x1_keys(s, d):
    return D.revalidation_requests(s, d).select("arrival_seq", revalidate.key_is_bad(F.col("idempotency_key")).alias("bad"))


def _resolved(s, d):
    return revalidate.resolve(D.revalidation_requests(s, d))


def x2_resolve(s, d):
    return _resolved(s, d).select("arrival_seq", "outcome", "run_event_id", "valid", "idempotent")


def x3_validate(s, d):
    return revalidate.validate_requests(D.revalidation_requests(s, d)).select(
        "arrival_seq", "valid", F.array_join("errors", ";").alias("errors"))


def x4_run_ids(s, d):
    return _resolved(s, d).select("arrival_seq", "re_run_id")


def x5_runs(s, d):
    return revalidate.new_runs(_resolved(s, d)).select("event_id", "idempotency_key", "valid")


def x6_find(s, d):
    runs = revalidate.new_runs(_resolved(s, d))
    wanted = D.revalidation_requests(s, d).select("arrival_seq", "idempotency_key")
    found = revalidate.find_runs(wanted, runs, "idempotency_key")
    return found.select("arrival_seq", "outcome", "event_id")


def _changes(s, d):
    return revalidate.changes(D.revalidation_requests(s, d))


def x7_delta(s, d):
    return _changes(s, d).select("arrival_seq", F.explode("changes").alias("c")).select(
        "arrival_seq", "c.field", "c.before", "c.after")


def x8_report(s, d):
    runs = revalidate.new_runs(_resolved(s, d))
    return revalidate.changes(runs).select(
        "event_id", F.size("changes").alias("n_changes"),
        F.array_join(F.transform("changes", lambda c: c["field"]), ";").alias("fields"))


ACME = Vendor(
    "acme", ("Acme Box", "Acme"),
    time=Field(("at",), noted="value"), severity=Field(("level",)), status=Field(("status",)),
    src=Field(("from",)), dst=Field(("to",)), actor=Field(("some_random_key",)),
    severity_words={"low": 1}, detect=lambda e: e.has("some_random_key"))


def u2_plugin(s, d):
    df = normalize.normalize(D.raw_logs(s, d), vendors=normalize.register_vendor(ACME, VENDORS))
    return _flat(df, ["time", "user_name", "product", "provenance"], "vendor")


# ------------------------------------------------- tables that outlive a batch
def _stored(s: SparkSession, name: str) -> tuple[str, str]:
    """Name and folder of a new bucketed table."""
    return f"{name}_{uuid.uuid4().hex}", files.new_folder(s, name)


def a2_batch_job(s, d):
    """Batches as files, one of them too large, run end to end and once more; summaries beside the rows that the sinks hold."""
    folder, batch = files.new_folder(s, "batches"), "CASE WHEN raw_log_id % 3 = 0 THEN -1 ELSE raw_log_id DIV 1500 END"
    D.raw_logs(s, d).withColumn("batch_id", F.expr(batch)).write.parquet(f"{folder}/in")
    for _ in range(2):
        summary = batches.run_batches(s, f"{folder}/in", f"{folder}/out", 0)
    for sink in batches.SINKS:
        rows = batches.read_sink(s, f"{folder}/out", sink).groupBy(F.expr(batch).alias("batch_id")).agg(F.count(F.lit(1)).alias(sink))
        summary = summary.join(rows, "batch_id", "left").withColumn(sink, F.coalesce(sink, F.lit(0).cast("bigint")))
    return summary


def a3_partition_read(s, d):
    """Raw logs written into partitions, some of them twice; one vendor's day is read back."""
    folder = files.new_folder(s, "raw-logs")
    logs = tables.raw_log_table(detect.detect_vendor(D.raw_logs(s, d)))
    tables.write(logs, folder, "vendor_source", "received_date", cluster="received_at_ms")
    tables.write(logs.where("vendor_source = 'ecs'"), folder, "vendor_source", "received_date", cluster="received_at_ms")
    t = s.read.parquet(folder).where("vendor_source = 'ecs' AND received_date = DATE'2024-01-05'")
    return t.select("raw_log_id", "raw_payload", "received_at_ms")


def _lineage(s, d):
    """Events and raw logs, both bucketed by the log's id; every fiftieth log is gone."""
    out = []
    logs = tables.raw_log_table(detect.detect_vendor(D.raw_logs(s, d))).where("raw_log_id % 50 <> 0")
    for name, df in (("events", tables.event_table(_normalized(s, d))), ("raw_logs", logs)):
        table, folder = _stored(s, name)
        tables.save_bucketed(df, table, folder, "raw_log_id", tables.buckets(s))
        out.append(s.table(table))
    return out


def a4_events_with_logs(s, d):
    return tables.events_with_logs(*_lineage(s, d)).select("raw_log_id", "vendor_source", "severity_id", "event_time_ms", "received_at_ms")


def a4_orphans(s, d):
    return tables.orphans(*_lineage(s, d)).select("raw_log_id", "event_time_ms")


def _dead_log(s, d):
    """Dead letters appended in two batches, the first one twice."""
    folder = files.new_folder(s, "dead-letters")
    dead = a7_dead_letters(s, d)
    for batch_id in (0, 1, 0):
        tables.append_dead_letters(dead.where(F.col("raw_log_id") % 2 == batch_id), folder, batch_id)
    return folder


def a8_dead_letter_read(s, d):
    log = tables.read_dead_letters(s, _dead_log(s, d), "raw_log_id")
    return log.select("position", "raw_log_id", "failure_reason", "errors", "dlq_timestamp")


def a9_purge_log(s, d):
    folder = _dead_log(s, d)
    tables.purge_dead_letters(s, folder, 1704672000000)
    return s.read.parquet(folder).select("raw_log_id", "failure_reason", "errors", "payload", "dlq_timestamp")


def t4_specs_in_one_pass(s, d):
    """Specs written as JSON, read as tables, compiled into one projection."""
    folder = files.new_folder(s, "specs")
    mapping.write_specs(s, X.MAPPING_SPECS, folder)
    blocks = mapping.blocks_of(*mapping.read_spec(s, folder))
    wanted = {"splunk": ("Splunk_CIM", "Authentication", T4_COLUMNS["splunk"]), "asim": ("ASIM", "NetworkSession", T4_COLUMNS["asim"]),
              "ecs": ("ECS", "Authentication", T4_COLUMNS["ecs"])}
    df = mapping.apply_specs(D.raw_logs(s, d), {n: blocks[k[:2]] for n, k in wanted.items()})
    return df.select("raw_log_id", *[F.col(f"{n}.{p}").alias(f"{n}_{c}") for n, (*_, columns) in wanted.items() for c, p in columns.items()])


def w1_register_over_time(s, d):
    """Requests in two batches, the first one twice, over the connectors there before."""
    requests = D.from_table(s, d, D.CONNECTOR_REQUESTS, "orders")
    before = D.from_table(s, d, D.CONNECTORS_BEFORE, "customer").withColumn("seq", F.lit(0).cast("bigint"))
    table = files.new_folder(s, "connectors")
    webhook.register_batch(before, table, 0)
    return _two_batches(requests, lambda part, k: webhook.register_batch(part, table, k))


def r1_register_over_time(s, d):
    requests = D.from_table(s, d, D.CLASS_REQUESTS, "orders")
    table = files.new_folder(s, "classes")
    return _two_batches(requests, lambda part, k: registry.register_batch(part, table, k))


def _two_batches(requests, register):
    outs = [register(requests.where(F.col("seq") % 2 == k % 2), k).select("seq", "outcome") for k in (1, 2, 1)]  # odd ones come first; the last is a replay
    return outs[2].unionByName(outs[1])


def w8_health_upsert(s, d):
    """Deliveries in two batches, each merged into the stored counters; the first comes again."""
    table, ingested = files.new_folder(s, "health"), _ingested(s, d)
    for k in (0, 1, 0):
        webhook.upsert_health(ingested.where(F.col("delivery_id") % 2 == k), table, k)
    return snapshots.read(s, table).select("connector_id", *webhook.COUNTERS)


def w11_streaming_health(s, d):
    """Statuses as a stream of three files in which deliveries repeat and come late, stopped and restarted from its checkpoint after the second."""
    folder = files.new_folder(s, "health-stream")
    statuses = webhook.delivery_status(_ingested(s, d))
    statuses.write.parquet(f"{folder}/statuses")
    statuses = s.read.parquet(f"{folder}/statuses")

    def run(*parts):
        for k in parts:  # a part and half of the part before
            again = statuses.where((F.col("delivery_id") % 3 == k - 1) & (F.col("delivery_id") % 2 == 0))
            statuses.where(F.col("delivery_id") % 3 == k).unionByName(again).repartition(1).write.mode("append").parquet(f"{folder}/in")
        stream = s.readStream.schema(statuses.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        webhook_stream.start_health(stream, f"{folder}/table", f"{folder}/checkpoint", available_now=True, delay="60 days").awaitTermination()

    run(0, 1)
    run(2)
    return webhook.health_report(snapshots.read(s, f"{folder}/table"))


def x2_resolve_stored(s, d):
    """Requests in two batches; the second meets the runs that the first stored."""
    requests = D.revalidation_requests(s, d)
    first, second = requests.where("arrival_seq < 10000000"), requests.where("arrival_seq >= 10000000")
    table, folder = _stored(s, "runs")
    resolved = revalidate.resolve(first)
    revalidate.store_runs(resolved, table, folder, tables.buckets(s))
    again = revalidate.resolve(second, s.table(table))
    columns = ["arrival_seq", "outcome", "run_event_id", "valid", "idempotent"]
    return resolved.select(*columns).unionByName(again.select(*columns))


def all_queries() -> dict[str, Query]:
    v = _vendor
    return {
        "a2_batches": a2_batches, "a3_raw_logs": a3_raw_logs, "a4_normalized_events": a4_events, "a5_audit": a5_audit,
        "a6_vendor_configs": a6_vendor_configs, "a7_dead_letters": a7_dead_letters, "a9_purge": a9_purge,
        "a13_spec_usage": a13_spec_usage, "a14_deliveries": a14_deliveries,
        "b1_detect_vendor": _detect("v2"), "b2_detect_vendor_legacy": _detect("legacy"),
        "b3_is_splunk": _is_splunk("v2"), "b4_is_splunk_legacy": _is_splunk("legacy"), "b5_unknown_vendor": b5_unknown,
        "c1_truthy_fallback": C1, "c2_presence_naming": C2, "c3_first_set_path": C3, "c4_which_key": C4,
        "c5_nested_or_flat": C5, "c6_extract": C6, "c7_provenance": c7_provenance, "c8_recorded_legacy": _legacy("qradar", "src_ip"),
        "f1_epoch_ms": v("webhook", "time"), "f2_epoch_ms_iso_only": v("sentinel", "time"), "f3_epoch_ms_truncating": v("qradar", "time"),
        "f4_iso_ms_legacy": _legacy("ecs", "time"), "f5_logscale_time_legacy": _legacy("logscale", "time"),
        "f6_qradar_time_legacy": _legacy("qradar", "time", "error"),
        "f7_convert_timestamp": F7, "f8_convert_timestamp_legacy": F8, "f9_convert_boolean": F9, "f10_convert_boolean_legacy": F10,
        "f11_integer_passthrough": F11, "f12_best_int": F12, "f13_bool_int": F13, "f14_strip": F14, "f15_units": F15,
        "f16_units_legacy": F16, "f17_enums": F17, "f18_enums_legacy": F18,
        "f19_severity_splunk": v("splunk", "severity_id"), "f20_severity_sentinel": v("sentinel", "severity_id"),
        "f21_severity_ecs": v("ecs", "severity_id"), "f22_severity_qradar": v("qradar", "severity_id"),
        "f23_severity_logscale": v("logscale", "severity_id"), "f24_severity_webhook": v("webhook", "severity_id"),
        "f25_severity_qradar_legacy": _legacy("qradar", "severity_id"), "f26_severity_logscale_legacy": _legacy("logscale", "severity_id"),
        "f27_status_cim": v("splunk", "status_id"), "f28_status_asim": v("sentinel", "status_id"), "f29_status_webhook": v("webhook", "status_id"),
        "f30_status_legacy": _legacy("sentinel", "status_id"), "f31_activity_legacy": _legacy("logscale", "activity_id"),
        "f32_spec_transforms": _spec("ASIM", "NetworkSession", {"time": "time", "src_port": "src_endpoint.port"}),
        "f33_request_hash": f33_hash, "f34_hmac_sign": f34_sign, "f35_type_names": F35,
        "n1_splunk": v("splunk"), "n2_sentinel": v("sentinel"), "n3_ecs": v("ecs"), "n4_qradar": v("qradar"),
        "n5_logscale": v("logscale"), "n6_webhook": v("webhook"), "n7_splunk_compat": n7_splunk_compat,
        "n8_splunk_legacy": _legacy("splunk"), "n9_sentinel_legacy": _legacy("sentinel"), "n10_ecs_legacy": _legacy("ecs"),
        "n11_qradar_legacy": _legacy("qradar"), "n12_logscale_legacy": _legacy("logscale"),
        "n13_dispatch": n13_dispatch, "n14_batch": n14_batch, "n15_summary": n15_summary,
        "o1_user": o1_user, "o2_endpoint": O2, "o3_hashes": O3, "o4_file": O4, "o5_process": O5, "o6_device": O6, "o7_actor": O7,
        "t1_transform": _transform("v2"), "t2_transform_legacy": _transform("legacy"), "t3_not_dict": t3_not_dict,
        "t4_spec_splunk": T4S, "t4_spec_asim_network": T4A, "t4_spec_ecs": T4E, "t5_template": t5_template,
        "t6_typed_model": t6_typed, "t7_typed_event": t7_typed_event,
        "v1_validate": _validate("v2"), "v2_object_checks": _validate("objects"), "v3_validate_legacy": _validate("legacy"), "v4_validate_revalidation": _validate("revalidation"),
        "v5_webhook_payload": v5_payload, "v6_readable_time": V6, "v7_split": v7_split,
        "w1_register": w1_register, "w2_list": w2_listed, "w3_delete": w3_delete, "w4_connector_lookup": w4_lookup,
        "w5_authenticate": w5_auth, "w5_authenticate_hmac": w5_auth_hmac, "w6_json": w6_json, "w7_ingest": w7_ingest,
        "w8_health": w8_health, "w9_health_report": w9_report,
        "r1_register_class": r1_register, "r2_list_classes": r2_listed, "r3_find_class": r3_find,
        "x1_key_check": x1_keys, "x2_resolve": x2_resolve, "x3_revalidate": x3_validate, "x4_run_ids": x4_run_ids,
        "x5_new_runs": x5_runs, "x6_find_runs": x6_find, "x7_delta": x7_delta, "x8_delta_report": x8_report,
        "u1_callable_extractor": U1, "u2_vendor_plugin": u2_plugin,
        "a2_batch_job": a2_batch_job, "a3_partition_read": a3_partition_read, "a4_events_with_logs": a4_events_with_logs, "a4_orphans": a4_orphans,
        "a8_dead_letter_read": a8_dead_letter_read, "a9_purge_log": a9_purge_log, "t4_specs_in_one_pass": t4_specs_in_one_pass,
        "w1_register_over_time": w1_register_over_time, "r1_register_over_time": r1_register_over_time,
        "w8_health_upsert": w8_health_upsert, "w11_streaming_health": w11_streaming_health, "x2_resolve_stored": x2_resolve_stored,
    }
