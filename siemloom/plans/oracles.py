"""DuckDB SQL stating what each registered query must return."""

from __future__ import annotations

from siemloom import fixed_values as X
from siemloom.sources import derived as D

RAW = D.render(D.RAW_LOGS, D.DUCKDB_TIME)
OBJ = "CASE WHEN json_valid({c}) AND json_type({c}) = 'OBJECT' THEN {c} END"


def _with(*parts: tuple[str, str]) -> str:
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts) + " "


def _over(table_sql: str, payload: str = "raw_payload") -> str:
    return _with(("t", table_sql), ("ev", f"SELECT *, {OBJ.format(c=payload)} AS j FROM t"))


EV = _over(RAW)
ASSETS = _over(D.render(D.ASSETS, D.DUCKDB_TIME))
CANDIDATES = _over(D.render(D.CANDIDATES, D.DUCKDB_TIME), "event_json")
REQ = D.render(D.REQUESTS, D.DUCKDB_TIME)
DELIVERIES = _with(("raw_logs", RAW), ("deliveries", D.DELIVERIES), ("connectors", D.CONNECTORS))


def p(*parts: str) -> str:
    return "'$" + "".join(f'."{x}"' for x in parts) + "'"


def t(*k: str) -> str:
    return f"(j->>{p(*k)})"


def ty(*k: str) -> str:
    return f"json_type(j, {p(*k)})"


def has(*k: str) -> str:
    return f"({ty(*k)} IS NOT NULL)"


def any_of(keys) -> str:
    return "(" + " OR ".join(has(k) for k in keys) + ")"


def truthy(k: str) -> str:
    return (f"coalesce(({ty(k)} = 'VARCHAR' AND {t(k)} <> '') OR "
            f"({ty(k)} <> 'VARCHAR' AND {t(k)} NOT IN ('0', '0.0', 'false', '{{}}', '[]')), false)")


def first_truthy(*keys: str, of=t) -> str:
    return "CASE " + " ".join(f"WHEN {truthy(k)} THEN {of(k)}" for k in keys[:-1]) + f" ELSE {of(keys[-1])} END" \
        if len(keys) > 1 else of(keys[0])


def first_present(*keys: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(k)} THEN '{k}'" for k in keys[:-1]) + f" ELSE '{keys[-1]}' END" \
        if len(keys) > 1 else f"'{keys[0]}'"


def coalesce(keys) -> str:
    return "coalesce(" + ", ".join(t(k) for k in keys) + ")"


def which(keys) -> str:
    return "CASE " + " ".join(f"WHEN {t(k)} IS NOT NULL THEN '{k}'" for k in keys) + " END"


def iso(x: str) -> str:
    return f"(epoch_us(try_cast(replace({x}, 'Z', '') AS TIMESTAMP)) // 1000)"


def iso_basic(x: str) -> str:
    """Like iso, but 13 digits also read as yyyymmdd, any separator, hhmm."""
    spelled = f"concat(substr({x}, 1, 4), '-', substr({x}, 5, 2), '-', substr({x}, 7, 2), ' ', substr({x}, 10, 2), ':', substr({x}, 12, 2), ':00')"
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{13}}') THEN epoch_us(try_cast({spelled} AS TIMESTAMP)) // 1000 ELSE {iso(x)} END"


def epoch(x: str, kind: str, digits: bool = True, now: str = "received_at_ms") -> str:
    whole = f"CASE WHEN CAST({x} AS BIGINT) > 1000000000000 THEN CAST({x} AS BIGINT) ELSE CAST({x} AS BIGINT) * 1000 END"
    numeric = f"regexp_full_match({x}, '-?[0-9]+')" + ("" if digits else f" AND {kind} <> 'VARCHAR'")
    return f"CASE WHEN {x} IS NULL THEN {now} WHEN {numeric} THEN {whole} ELSE coalesce({iso(x)}, {now}) END"


def words(x: str, table: dict, default: int = 1) -> str:
    return f"CASE lower({x}) " + " ".join(f"WHEN '{w}' THEN {c}" for w, c in table.items()) + f" ELSE {default} END"


def status(x: str, table) -> str:
    good, bad = (", ".join(f"'{w}'" for w in ws) for ws in table)
    return f"CASE WHEN lower({x}) IN ({good}) THEN 1 WHEN lower({x}) IN ({bad}) THEN 2 ELSE 99 END"


def whole(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN CAST(trim({x}) AS BIGINT) END"


def magnitude(n: str) -> str:
    return f"CASE WHEN {n} >= 9 THEN 5 WHEN {n} >= 7 THEN 4 WHEN {n} >= 5 THEN 3 WHEN {n} >= 3 THEN 2 ELSE 1 END"


def nested(*parts: str) -> str:
    return f"CASE WHEN {has(*parts)} THEN {t(*parts)} ELSE {t('.'.join(parts))} END"


def _mapping(time, severity, status_id, src, dst, user, product, notes, message="NULL", outs=None) -> dict[str, str]:
    """Result columns of one vendor; notes are (target, condition, source)."""
    outs = outs or {}
    prov = ", ".join(f"CASE WHEN {cond} THEN concat('{target}<', {source}) END" for target, cond, source in notes)
    cond = {n: c for n, c, _ in notes}
    out = {
        "time": time, "severity_id": severity, "status_id": status_id,
        "has_src": outs.get("src", cond["src_endpoint.ip"]), "has_dst": outs.get("dst", cond["dst_endpoint.ip"]),
        "has_actor": cond["actor.user.name"], "product": f"'{product}'", "provenance": f"concat_ws(';', {prov})",
    }
    out["src_ip"] = f"CASE WHEN {out['has_src']} THEN {src} END"
    out["dst_ip"] = f"CASE WHEN {out['has_dst']} THEN {dst} END"
    out["user_name"] = f"CASE WHEN {out['has_actor']} THEN {user} END"
    out["message"] = message
    return out


_mag = first_truthy("magnitude", "severity")
_sev = coalesce(X.SEVERITY_KEYS)
_sevkind = "coalesce(" + ", ".join(f"CASE WHEN {t(k)} IS NOT NULL THEN {ty(k)} END" for k in X.SEVERITY_KEYS) + ")"
_webtime = coalesce(X.TIME_KEYS)
VENDORS = {
    "splunk": _mapping(
        epoch(t("_time"), ty("_time")), words(t("vendor_severity"), X.SEVERITY_WORDS["splunk"]),
        status(first_truthy("action", "status"), X.STATUS_WORDS["cim"]),
        first_truthy("src_ip", "src"), first_truthy("dest_ip", "dest"), first_truthy("user", "src_user"), "Splunk Enterprise",
        [("time", t("_time") + " IS NOT NULL", "'_time'"), ("severity_id", has("vendor_severity"), "'vendor_severity'"),
         ("status_id", any_of(["action", "status"]), first_present("action", "status")),
         ("src_endpoint.ip", any_of(["src_ip", "src"]), first_present("src_ip", "src")),
         ("dst_endpoint.ip", any_of(["dest_ip", "dest"]), first_present("dest_ip", "dest")),
         ("actor.user.name", any_of(["user", "src_user"]), first_present("user", "src_user"))]),
    "sentinel": _mapping(
        epoch(first_truthy("EventStartTime", "TimeGenerated"), first_truthy("EventStartTime", "TimeGenerated", of=ty), False),
        words(t("SeverityLevel"), X.SEVERITY_WORDS["sentinel"]), status(t("EventResult"), X.STATUS_WORDS["asim"]),
        t("SrcIpAddr"), first_truthy("DstIpAddr", "TargetIpAddr"), t("TargetUsername"), "Microsoft Sentinel",
        [("time", f"({first_truthy('EventStartTime', 'TimeGenerated')}) IS NOT NULL", first_present("EventStartTime", "TimeGenerated")),
         ("severity_id", has("SeverityLevel"), "'SeverityLevel'"), ("status_id", has("EventResult"), "'EventResult'"),
         ("src_endpoint.ip", has("SrcIpAddr"), "'SrcIpAddr'"),
         ("dst_endpoint.ip", any_of(["DstIpAddr", "TargetIpAddr"]), first_present("DstIpAddr", "TargetIpAddr")),
         ("actor.user.name", has("TargetUsername"), "'TargetUsername'")]),
    "ecs": _mapping(
        epoch(t("@timestamp"), ty("@timestamp"), False),
        f"coalesce(least(5, greatest(1, 1 + CAST(floor(({whole(nested('event', 'severity'))}) / 20.0) AS BIGINT))), 1)",
        status(nested("event", "outcome"), X.STATUS_WORDS["asim"]),
        nested("source", "ip"), nested("destination", "ip"), nested("user", "name"), "Elasticsearch",
        [("time", "true", "'@timestamp'"), ("severity_id", "true", "'event.severity'"), ("status_id", "true", "'event.outcome'"),
         ("src_endpoint.ip", f"coalesce(({nested('source', 'ip')}) <> '', false)", "'source.ip'"),
         ("dst_endpoint.ip", f"coalesce(({nested('destination', 'ip')}) <> '', false)", "'destination.ip'"),
         ("actor.user.name", f"coalesce(({nested('user', 'name')}) <> '', false)", "'user.name'")]),
    "qradar": _mapping(
        epoch(first_truthy("starttime", "devicetime"), "''"), magnitude(f"({whole(_mag)})"),
        status(t("status"), X.STATUS_WORDS["cim"]), t("sourceip"), t("destinationip"),
        first_truthy("username", "identityusername"), "QRadar SIEM",
        [("time", f"({first_truthy('starttime', 'devicetime')}) IS NOT NULL", first_present("starttime", "devicetime")),
         ("severity_id", f"({_mag}) IS NOT NULL", first_present("magnitude", "severity")), ("status_id", has("status"), "'status'"),
         ("src_endpoint.ip", has("sourceip"), "'sourceip'"), ("dst_endpoint.ip", has("destinationip"), "'destinationip'"),
         ("actor.user.name", any_of(["username", "identityusername"]), first_present("username", "identityusername"))]),
    "logscale": _mapping(
        epoch(t("@timestamp"), "''"), words(t("loglevel"), X.SEVERITY_WORDS["logscale"]),
        status(first_truthy("status", "outcome"), X.STATUS_WORDS["cim"]), t("aip"),
        first_truthy("endpoint_ip", "dst_ip", "endpoint"), first_truthy("user", "user_name"), "LogScale",
        [("time", "true", "'@timestamp'"), ("severity_id", has("loglevel"), "'loglevel'"),
         ("status_id", any_of(["status", "outcome"]), first_present("status", "outcome")), ("src_endpoint.ip", has("aip"), "'aip'"),
         ("dst_endpoint.ip", f"({first_truthy('endpoint_ip', 'dst_ip', 'endpoint')}) IS NOT NULL", first_present("endpoint_ip", "dst_ip", "endpoint")),
         ("actor.user.name", any_of(["user", "user_name"]), first_present("user", "user_name"))]),
    "webhook": _mapping(
        epoch(_webtime, "''"),
        f"CASE WHEN {_sev} IS NULL THEN 1 WHEN {_sevkind} = 'VARCHAR' THEN {words(_sev, X.SEVERITY_WORDS['webhook'])} "
        f"WHEN CAST({_sev} AS BIGINT) <= 5 THEN greatest(1, CAST({_sev} AS BIGINT)) ELSE {magnitude(f'CAST({_sev} AS BIGINT)')} END",
        status(coalesce(X.STATUS_KEYS), X.STATUS_WORDS["webhook"]),
        coalesce(X.SOURCE_IP_KEYS[:-1]), coalesce(X.DEST_IP_KEYS[:-1]), coalesce(X.USER_KEYS), "Generic Webhook",
        [("time", f"{_webtime} IS NOT NULL", which(X.TIME_KEYS)), ("severity_id", f"{_sev} IS NOT NULL", which(X.SEVERITY_KEYS)),
         ("status_id", f"{coalesce(X.STATUS_KEYS)} IS NOT NULL", which(X.STATUS_KEYS)),
         ("src_endpoint.ip", f"{coalesce(X.SOURCE_IP_KEYS[:-1])} IS NOT NULL", which(X.SOURCE_IP_KEYS[:-1])),
         ("dst_endpoint.ip", f"{coalesce(X.DEST_IP_KEYS[:-1])} IS NOT NULL", which(X.DEST_IP_KEYS[:-1])),
         ("actor.user.name", f"{coalesce(X.USER_KEYS)} IS NOT NULL", which(X.USER_KEYS)),
         ("message", f"{coalesce(X.MESSAGE_KEYS + X.EVENT_KEYS)} IS NOT NULL", which(X.MESSAGE_KEYS + X.EVENT_KEYS))],
        coalesce(X.MESSAGE_KEYS + X.EVENT_KEYS)),
}
FLAGS = ("has_src", "has_dst", "has_actor")


def vendor(name: str, *columns: str, ctes: str = EV) -> str:
    cols = VENDORS[name]
    shown = ", ".join(
        (f"coalesce(j IS NOT NULL AND {cols[c]}, false) AS {c}" if c in FLAGS else f"CASE WHEN j IS NOT NULL THEN {cols[c]} END AS {c}")
        for c in (columns or cols))
    return f"{ctes} SELECT raw_log_id, {shown} FROM ev"


def detected(legacy: bool = False) -> str:
    dotted = "len(list_filter(json_keys(j), lambda k: starts_with(k, 'source.') OR starts_with(k, 'event.'))) > 0"
    rules = [("qradar", f"({has('magnitude')} AND {has('sourceip')}) OR {has('starttime')}"),
             ("logscale", f"{has('@timestamp')} AND {any_of(['aip', 'loglevel'])}")]
    if legacy:
        rules += [("splunk", any_of(X.SPLUNK_SIGNATURE_LEGACY)), ("sentinel", any_of(X.SENTINEL_SIGNATURE)),
                  ("ecs", f"({dotted}) OR ({has('@timestamp')} AND {any_of(X.ECS_OBJECTS_LEGACY)})")]
    else:
        rules += [("webhook", f"{any_of(X.WEBHOOK_DESCRIPTOR_SIGNATURE)} AND {any_of(X.WEBHOOK_TIME_SIGNATURE)}"),
                  ("splunk", any_of(X.SPLUNK_SIGNATURE)), ("sentinel", any_of(X.SENTINEL_SIGNATURE)),
                  ("ecs", f"({dotted}) OR ({any_of(X.ECS_OBJECTS)} AND {any_of(['@timestamp', 'timestamp'])})")]
    return "CASE WHEN j IS NULL THEN NULL " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in rules) + " ELSE 'unknown' END"


DET = EV[:-1] + f", d AS (SELECT *, {detected()} AS vendor FROM ev) "
ERROR = f"CASE WHEN j IS NULL THEN '{X.MSG_NOT_DICT}' WHEN vendor = 'unknown' THEN concat('{X.MSG_UNKNOWN_VENDOR}', raw_payload) END"
GOOD = "(j IS NOT NULL AND vendor <> 'unknown')"


def dispatched(column: str) -> str:
    return "CASE " + " ".join(f"WHEN vendor = '{n}' THEN {cols[column]}" for n, cols in VENDORS.items()) + " END"


def _all_flat() -> str:
    return ", ".join(
        (f"coalesce({GOOD} AND {dispatched(c)}, false) AS {c}" if c in FLAGS else f"{dispatched(c)} AS {c}")
        for c in VENDORS["splunk"])


def on_all(ctes: str = EV, **cols: str) -> str:
    return f"{ctes} SELECT raw_log_id, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM ev"


def enum(x: str, table: dict) -> str:
    return f"CASE lower(trim({x})) " + " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in table.items()) + f" ELSE {x} END"


def _boolean(k: str) -> str:
    return (f"CASE WHEN {ty(k)} = 'VARCHAR' THEN CASE WHEN lower({t(k)}) IN ('true','yes','1','enabled','success') THEN 'true' "
            f"WHEN lower({t(k)}) IN ('false','no','0','disabled','failure','failed') THEN 'false' ELSE {t(k)} END "
            f"ELSE CASE WHEN CAST({t(k)} AS BIGINT) <> 0 THEN 'true' ELSE 'false' END END")


def _legacy_cols() -> dict[str, dict[str, str]]:
    def base(**c):
        return {"class_uid": "3002", "activity_id": "1", "severity_id": "1", "src_port": "CAST(NULL AS BIGINT)",
                "dst_port": "CAST(NULL AS BIGINT)", "dst_ip": "CAST(NULL AS VARCHAR)", "provenance": "''", "error": "CAST(NULL AS VARCHAR)", **c}

    def exact(x, good, bad):
        return f"CASE WHEN {x} = '{good}' THEN 1 WHEN {x} = '{bad}' THEN 2 ELSE 99 END"

    def or_else(x, default):
        return f"CASE WHEN coalesce({x}, '') <> '' THEN {x} ELSE '{default}' END"

    def keys_used(*groups):
        names = ", ".join(which(g) for g in groups)
        return f"array_to_string(list_sort(list_filter([{names}], lambda x: x IS NOT NULL)), ';')"

    def inner(a, b):
        return f"coalesce({t(a, b)}, {t(a + '.' + b)})"

    def logout(x):
        return f"CASE WHEN lower(coalesce({x}, '')) LIKE '%logout%' THEN 2 ELSE 1 END"

    mag = whole(coalesce(["magnitude", "severity"]))
    qtime = coalesce(["starttime", "devicetime"])
    level = coalesce(["loglevel", "severity"])
    q = base(class_uid="3001", activity_id=logout(t("action")),
             severity_id=f"CASE WHEN coalesce({mag}, 1) <= 2 THEN 1 WHEN coalesce({mag}, 1) <= 4 THEN 2 WHEN coalesce({mag}, 1) <= 6 THEN 3 WHEN coalesce({mag}, 1) <= 8 THEN 4 ELSE 5 END",
             status_id=status(t("status"), X.STATUS_WORDS_LEGACY["qradar"]),
             time=f"CASE WHEN {qtime} IS NULL THEN received_at_ms ELSE CAST({qtime} AS BIGINT) END",
             user_name=coalesce(["username", "identityusername"]), src_ip=t("sourceip"), dst_ip=t("destinationip"),
             src_port=f"CASE WHEN {t('sourceip')} IS NOT NULL THEN {whole(t('sourceport'))} END",
             dst_port=f"CASE WHEN {t('destinationip')} IS NOT NULL THEN {whole(t('destinationport'))} END",
             provenance=keys_used(["magnitude", "severity"], ["action"], ["status"], ["starttime", "devicetime"], ["sourceip"],
                                  ["sourceport"], ["destinationip"], ["destinationport"], ["username", "identityusername"]))
    log = base(class_uid="3001", activity_id=logout(coalesce(["event_type", "action"])),
               severity_id=f"CASE WHEN {level} IS NULL THEN 1 ELSE {words(level, X.SEVERITY_WORDS_LOGSCALE_LEGACY, 99)} END",
               status_id=status(coalesce(["status", "outcome"]), X.STATUS_WORDS_LEGACY["logscale"]),
               time=f"CASE WHEN {ty('@timestamp')} = 'VARCHAR' THEN coalesce({iso(t('@timestamp'))}, received_at_ms) WHEN {t('@timestamp')} IS NOT NULL THEN CAST({t('@timestamp')} AS BIGINT) ELSE received_at_ms END",
               user_name=coalesce(["user", "user_name"]), src_ip=coalesce(["aip", "src_ip"]), dst_ip=coalesce(["endpoint_ip", "dst_ip"]),
               provenance=keys_used(["@timestamp"], ["loglevel", "severity"], ["event_type", "action"], ["status", "outcome"],
                                    ["aip", "src_ip"], ["endpoint_ip", "dst_ip"], ["user", "user_name"]))
    now = "received_at_ms"
    return {
        "splunk": base(status_id=status(t("action"), X.STATUS_WORDS_LEGACY["splunk"]), time=now,
                       user_name=or_else(coalesce(["user", "src_user"]), "Unknown"), src_ip=or_else(coalesce(["src_ip", "src"]), "0.0.0.0")),
        "sentinel": base(status_id=exact(t("EventResult"), "Success", "Failure"),
                         time=f"coalesce({iso(coalesce(['EventStartTime', 'TimeGenerated']))}, {now})",
                         user_name=or_else(t("TargetUsername"), "Unknown"), src_ip=t("SrcIpAddr")),
        "ecs": base(status_id=exact(inner("event", "outcome"), "success", "failure"), time=f"coalesce({iso_basic(t('@timestamp'))}, {now})",
                    user_name=or_else(inner("user", "name"), "Unknown"), src_ip=inner("source", "ip")),
        "qradar": q, "logscale": log,
    }


LEGACY = _legacy_cols()
LEGACY_FLAT = ["class_uid", "activity_id", "severity_id", "status_id", "time", "user_name", "src_ip", "src_port", "dst_ip", "dst_port"]


def legacy(name: str, *columns: str) -> str:
    cols = LEGACY[name]
    shown = ", ".join(f"CASE WHEN j IS NOT NULL THEN {cols[c]} END AS {c}" for c in [*(columns or LEGACY_FLAT), "provenance"])
    return f"{EV} SELECT raw_log_id, {shown} FROM ev"


def _event_errors(profile: str) -> str:
    names = "CASE {k} WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' END"
    errors = [f"CASE WHEN {t(f)} IS NULL THEN 'Missing mandatory OCSF field: ''{f}''' END" for f in X.MANDATORY_FIELDS]
    number = "('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')"
    errors.append(f"CASE WHEN {t('time')} IS NOT NULL AND {ty('time')} NOT IN {number} THEN concat('Invalid ''time'' type: Expected numeric timestamp, got ', {names.format(k=ty('time'))}) END")
    if profile == "objects":
        errors = []
    if profile in ("v2", "objects"):
        for f in X.OBJECT_FIELDS:
            errors.append(f"CASE WHEN {t(f)} IS NOT NULL AND {ty(f)} <> 'OBJECT' THEN concat('Invalid ''{f}'': Expected object/dict, got ', {names.format(k=ty(f))}) END")
            for n, expected in X.INNER_TYPES.get(f, []):
                good = f"{ty(f, n)} = 'VARCHAR'" if expected == "string" else f"{ty(f, n)} IN {number}"
                errors.append(f"CASE WHEN {t(f, n)} IS NOT NULL AND NOT ({good}) THEN concat('Invalid ''{f}.{n}'': Expected {expected}, got ', {names.format(k=ty(f, n))}) END")
    if profile in ("v2", "legacy"):
        for f in ("src_endpoint", "dst_endpoint"):
            errors.append(f"CASE WHEN {t('class_uid')} = '4001' AND NOT {has(f)} THEN 'Class 4001 (Network Activity) missing ''{f}''' END")
        errors.append(f"CASE WHEN {t('class_uid')} = '3002' AND NOT {any_of(['user', 'actor'])} THEN 'Class 3002 (Authentication) missing ''user'' or ''actor'' context' END")
    return "concat_ws(';', " + ", ".join(errors) + ")"


def _payload_errors() -> str:
    clock, clock_text = which(X.TIME_KEYS), coalesce(X.TIME_KEYS)
    described = "(" + " OR ".join(f"coalesce({t(k)}, '') <> ''" for k in X.DESCRIPTOR_KEYS + X.CONTEXT_KEYS) + ")"
    readable = f"(regexp_full_match({clock_text}, '-*[0-9]+') OR {iso(clock_text)} IS NOT NULL)"
    return (f"CASE WHEN j IS NULL THEN 'Invalid payload: Expected a JSON object, got list' ELSE concat_ws(';', "
            f"CASE WHEN {clock_text} IS NULL THEN '{X.MSG_NO_TIMESTAMP}' END, CASE WHEN NOT {described} THEN '{X.MSG_NO_CONTEXT}' END, "
            f"CASE WHEN {clock_text} IS NOT NULL AND NOT {readable} THEN concat('Invalid timestamp for field ''', {clock}, ''': Expected epoch seconds/ms or ISO-8601 string, got str') END) END")


INGEST = DELIVERIES[:-1] + f""", a AS (
  SELECT d.*, d.delivery_id AS raw_log_id, d.arrived_at_ms AS received_at_ms, CASE WHEN c.id IS NULL THEN 'connector_not_found' WHEN NOT c.is_active THEN 'connector_inactive'
    WHEN trim(d.secret_hdr) = c.secret THEN 'secret' ELSE 'unauthorized' END AS auth,
    {OBJ.format(c='raw_body')} AS j, json_valid(raw_body) AS ok
  FROM deliveries d LEFT JOIN connectors c ON c.id = d.connector_id),
b AS (SELECT *, {detected()} AS vendor, {_payload_errors()} AS perr FROM a),
i AS (SELECT *, CASE WHEN auth = 'connector_not_found' THEN 'CONNECTOR_NOT_FOUND' WHEN auth <> 'secret' THEN 'UNAUTHORIZED' WHEN NOT ok THEN 'INVALID_JSON'
    WHEN perr <> '' THEN 'SCHEMA_VALIDATION_FAILED' WHEN vendor = 'unknown' THEN 'NORMALIZATION_FAILED'
    WHEN NOT {dispatched('has_actor')} THEN 'OCSF_VALIDATION_FAILED' ELSE 'VALID' END AS outcome FROM b) """


def _pad(byte: int) -> str:
    """A secret of at most 64 ASCII letters as a block, each byte XOR-ed."""
    return f"unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02x', xor(CASE WHEN i <= length(secret) THEN ascii(secret[i]) ELSE 0 END, {byte}))), ''))"


def _signature(body: str) -> str:
    return f"CASE WHEN raw_body IS NOT NULL THEN sha256(opad || unhex(sha256(ipad || encode({body})))) END"


SIGNED = DELIVERIES[:-1] + f""", k AS (SELECT id, is_active, {_pad(0x36)} AS ipad, {_pad(0x5C)} AS opad FROM connectors),
s AS (SELECT * FROM deliveries d LEFT JOIN k ON k.id = d.connector_id) """
HEALTH = """count(*) AS delivered, count(*) FILTER (outcome = 'VALID') AS valid_count,
  count(*) FILTER (outcome NOT IN ('VALID', 'UNAUTHORIZED')) AS invalid_count, count(*) FILTER (outcome = 'UNAUTHORIZED') AS auth_failures,
  count(*) FILTER (outcome NOT IN ('VALID', 'UNAUTHORIZED')) AS dlq_count"""
LATENCY = "CAST(coalesce(sum(latency_ms) FILTER (outcome = 'VALID'), 0) AS BIGINT)"
REASON = "CASE outcome WHEN 'UNAUTHORIZED' THEN auth WHEN 'INVALID_JSON' THEN 'invalid_json' WHEN 'SCHEMA_VALIDATION_FAILED' THEN 'schema_validation_failed' WHEN 'NORMALIZATION_FAILED' THEN 'normalization_failed' WHEN 'OCSF_VALIDATION_FAILED' THEN 'ocsf_validation_failed' END"

BAD_KEY = "coalesce(trim(idempotency_key) = '' OR length(idempotency_key) > 255, true)"
RERR = ("concat_ws(';', " + ", ".join(f"CASE WHEN json_extract_string(updated_event, '$.{f}') IS NULL THEN 'Missing mandatory OCSF field: ''{f}''' END" for f in X.MANDATORY_FIELDS)
        + ", CASE WHEN json_type(updated_event, '$.time') = 'VARCHAR' THEN 'Invalid ''time'' type: Expected numeric timestamp, got str' END)")
RESOLVED = _with(("r", REQ)) [:-1] + f""", f AS (SELECT *, {RERR} AS errs, concat(event_id, '|', original_event, '|', updated_event) AS h FROM r),
w AS (SELECT idempotency_key AS k, min(arrival_seq) AS first_seq, arg_min(h, arrival_seq) AS first_h, arg_min(event_id, arrival_seq) AS first_id,
  arg_min(errs, arrival_seq) AS first_errs FROM f WHERE NOT {BAD_KEY} GROUP BY 1),
x AS (SELECT f.*, w.*, CASE WHEN {BAD_KEY} THEN 'INVALID_IDEMPOTENCY_KEY' WHEN arrival_seq = first_seq THEN 'completed'
  WHEN h = first_h THEN 'already_processed' ELSE 'IDEMPOTENCY_KEY_CONFLICT' END AS outcome FROM f LEFT JOIN w ON w.k = f.idempotency_key) """
ANSWERED = "outcome IN ('completed', 'already_processed')"
FIELDS = ["big", "category_uid", "class_uid", "message", "nest", "severity_id", "status_id", "time", "user"]


def _change(f: str) -> tuple[str, str, str]:
    # The user objects differ only in key order, the nested ones in one number and in forms of the others.
    if f == "nest":
        third = [f"CAST(json_extract({e}, '$.nest.a[2]') AS DOUBLE)" for e in ("original_event", "updated_event")]
        return """'{"a":[1,true,0.5],"b":{"c":2}}'""", f"""concat('{{"a":[1,1,', {third[1]}, '],"b":{{"c":2}}}}')""", f"({third[0]} <> {third[1]})"
    b, a = (f"nullif(CAST(json_extract({e}, '$.{f}') AS VARCHAR), 'null')" for e in ("original_event", "updated_event"))
    return b, a, "false" if f == "user" else f"({b} IS DISTINCT FROM {a})"


def _delta() -> str:
    parts = []
    for f in FIELDS:
        b, a, differs = _change(f)
        parts.append(f"SELECT arrival_seq, '{f}' AS field, {b} AS before, {a} AS after FROM r WHERE {differs}")
    return _with(("r", REQ)) + " UNION ALL ".join(parts)


def _report() -> str:
    flags = [f"CASE WHEN {_change(f)[2]} THEN '{f}' END" for f in FIELDS]
    return RESOLVED + (f"SELECT event_id, CAST({' + '.join(f'(CASE WHEN {_change(f)[2]} THEN 1 ELSE 0 END)' for f in FIELDS)} AS INT) AS n_changes, "
                       f"concat_ws(';', {', '.join(flags)}) AS fields FROM x WHERE outcome = 'completed'")


def _transformed(legacy_profile: bool) -> str:
    table = {v: dict(m) for v, m in X.RENAMES.items()}
    if legacy_profile:
        for v, gone in X.RENAMES_LEGACY_ABSENT.items():
            for g in gone:
                table[v].pop(g)
    enums = X.ENUMS_LEGACY if legacy_profile else X.ENUMS
    out = []
    for target in ("src_ip", "dst_ip", "src_port", "user_name", "severity", "timestamp", "outcome", "action", "status"):
        branches = []
        for v, m in list(table.items()) + [("webhook", {}), ("unknown", {})]:
            # in the fixture a target's own name and its source never occur together
            sources = list(dict.fromkeys([k for k, x in m.items() if x == target] + ([target] if target not in m or m[target] == target else [])))
            x = coalesce(sources)
            if target == "timestamp":
                num = f"CAST({x} AS BIGINT)"
                ms = f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN CASE WHEN {num} < 10000000000 THEN {num} * 1000 ELSE {num} END ELSE {iso(x)} END"
                if legacy_profile:
                    kinds = "coalesce(" + ", ".join(f"CASE WHEN {t(k)} IS NOT NULL THEN {ty(k)} END" for k in sources) + ")"
                    stamp = (f"concat(strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S'), CASE WHEN ({ms}) % 1000 = 0 THEN '' ELSE "
                             f"concat('.', lpad(CAST(({ms}) % 1000 AS VARCHAR), 3, '0'), '000') END, '+00:00')")
                    x = f"CASE WHEN {x} IS NULL THEN NULL WHEN {kinds} = 'VARCHAR' AND regexp_full_match({x}, '[0-9]+') THEN {x} ELSE {stamp} END"
                else:
                    x = f"CAST(({ms}) AS VARCHAR)"
            elif target in enums.get(v, {}):
                x = enum(x, enums[v][target])
            branches.append(f"WHEN vendor = '{v}' THEN {x}")
        out.append("CASE " + " ".join(branches) + f" END AS {target}")
    return DET + "SELECT raw_log_id, " + ", ".join(out) + " FROM d"


def _legacy_iso(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE concat(strftime(make_timestamp({{ms}} * 1000), '%Y-%m-%dT%H:%M:%S'), CASE WHEN {{ms}} % 1000 = 0 THEN '' "
            f"ELSE concat('.', lpad(CAST({{ms}} % 1000 AS VARCHAR), 3, '0'), '000') END, '+00:00') END")


def all_oracles() -> dict[str, str]:
    v = vendor
    spec_rows = ", ".join(
        f"('{s}', '{n}', '{f[0]}', '{f[1]}')" for s, bs in X.MAPPING_SPECS.items() for n, b in bs.items() for f in b["field_maps"])
    seed = ", ".join(f"('{a}', '{b}')" for a, b in X.VENDOR_CONFIG_SEED)
    class_ctes = _with(("req", D.CLASS_REQUESTS), ("old", D.CLASSES_BEFORE))
    conn_ctes = _with(("req", D.CONNECTOR_REQUESTS), ("old", D.CONNECTORS_BEFORE))
    valid_class = "(organization <> '' AND class_name <> '' AND version <> '' AND CASE WHEN json_valid(schema) THEN json_type(schema) = 'OBJECT' ELSE false END)"
    typed = [f"CASE WHEN {whole(t(k))} IS NULL THEN '{k}' END" for k in ("activity_id", "category_uid", "class_uid", "severity_id", "status_id")]
    typed += [f"CASE WHEN coalesce({ty(*k)}, '') <> 'VARCHAR' THEN '{'.'.join(k)}' END" for k in (("user", "name"), ("device", "ip"), ("actor", "user", "name"))]
    out = {
        "a2_batches": EV + "SELECT batch_id, count(*) <= 2000 AS accepted, count(*) AS n FROM (SELECT CAST(floor(sqrt(raw_log_id)) AS BIGINT) % 7 AS batch_id FROM ev) GROUP BY 1",
        "a2_batch_job": DET[:-1] + f""", x AS (SELECT CASE WHEN raw_log_id % 3 = 0 THEN -1 ELSE raw_log_id // 1500 END AS batch_id, count(*) AS received,
          count(*) FILTER ({GOOD}) AS good FROM d GROUP BY 1),
          y AS (SELECT batch_id, received <= 2000 AS accepted, received, if(received <= 2000, received, 0) AS taken, if(received <= 2000, good, 0) AS good FROM x)
          SELECT batch_id, accepted, received, good AS success_count, taken - good AS failure_count, taken AS raw_logs, good AS events, taken AS audit, taken - good AS dead_letters FROM y""",
        "a3_raw_logs": DET + "SELECT coalesce(vendor, 'unknown') AS vendor_source, strftime(make_timestamp(received_at_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM d GROUP BY 1, 2",
        "a4_normalized_events": DET + f"SELECT raw_log_id, 3002 AS class_uid, 3 AS category_uid, 1 AS activity_id, {dispatched('severity_id')} AS severity_id, {dispatched('time')} AS event_time_ms, {dispatched('src_ip')} AS src_ip, strftime(make_timestamp(({dispatched('time')}) * 1000), '%Y-%m-%d') AS day FROM d WHERE {GOOD}",
        "a5_audit": DET + f"SELECT raw_log_id, coalesce(vendor, 'unknown') AS vendor, CASE WHEN NOT coalesce({GOOD}, false) THEN 'FAILED' WHEN NOT {dispatched('has_actor')} THEN 'VALIDATION_ERROR' ELSE 'SUCCESS' END AS status, CASE WHEN NOT coalesce({GOOD}, false) THEN {ERROR} WHEN NOT {dispatched('has_actor')} THEN 'Class 3002 (Authentication) missing ''user'' or ''actor'' context' END AS error_message FROM d",
        "a6_vendor_configs": DET + f"SELECT DISTINCT vendor AS vendor_name, 'Custom' AS adapter_class, true AS is_active FROM d WHERE vendor IS NOT NULL UNION ALL SELECT n, c, true FROM (VALUES {seed}) s(n, c) WHERE n NOT IN (SELECT vendor FROM d WHERE vendor IS NOT NULL)",
        "a7_dead_letters": DET + f"SELECT raw_log_id, 'normalization_failed' AS failure_reason, {ERROR} AS errors, raw_payload AS payload, received_at_ms AS dlq_timestamp FROM d WHERE NOT coalesce({GOOD}, false)",
        "a9_purge": DET + f"SELECT raw_log_id, 'normalization_failed' AS failure_reason, {ERROR} AS errors, raw_payload AS payload, received_at_ms AS dlq_timestamp FROM d WHERE NOT coalesce({GOOD}, false) AND received_at_ms >= 1704672000000",
        "a13_spec_usage": EV[:-1] + f", k AS (SELECT unnest(json_keys(j)) AS source_field FROM ev WHERE j IS NOT NULL) SELECT s.a AS source_schema, s.b AS class_name, s.c AS source_field, s.d AS target_field, count(*) AS n FROM (VALUES {spec_rows}) s(a, b, c, d) JOIN k ON k.source_field = s.c GROUP BY ALL",
        "a14_deliveries": DELIVERIES + "SELECT delivery_id, connector_id, CAST(length(raw_body) AS INT) AS n_chars FROM deliveries",
        "b1_detect_vendor": on_all(vendor=detected()), "b2_detect_vendor_legacy": on_all(vendor=detected(True)),
        "b3_is_splunk": on_all(is_splunk=f"CASE WHEN j IS NOT NULL THEN {any_of(X.SPLUNK_PAYLOAD_KEYS)} END"),
        "b4_is_splunk_legacy": on_all(is_splunk=f"CASE WHEN j IS NOT NULL THEN {any_of(X.SPLUNK_PAYLOAD_KEYS_LEGACY)} END"),
        "b5_unknown_vendor": DET + f"SELECT raw_log_id, coalesce({GOOD}, false) AS success, {ERROR} AS error FROM d",
        "c1_truthy_fallback": on_all(first=first_truthy("magnitude", "severity", "sourceport"), user_name=first_truthy("user", "src_user")),
        "c2_presence_naming": on_all(user_key=first_present("username", "user", "src_user"), status_key=first_present("status", "outcome")),
        "c3_first_set_path": on_all(value=f"coalesce({t('username')}, {t('source', 'ip')}, {t('user')})"),
        "c4_which_key": on_all(key=f"CASE WHEN {t('username')} IS NOT NULL THEN 'username' WHEN {t('source', 'ip')} IS NOT NULL THEN 'source.ip' WHEN {t('user')} IS NOT NULL THEN 'user' END"),
        "c5_nested_or_flat": on_all(severity=nested("event", "severity"), outcome=nested("event", "outcome"), ip=nested("source", "ip")),
        "c6_extract": on_all(ASSETS, name=coalesce(["user_name", "user"]), pid=t("pid")),
        "c7_provenance": on_all(ASSETS, name=f"CASE WHEN {t('user_name')} IS NOT NULL THEN concat('user_name=', {t('user_name')}) ELSE concat('user=', {t('user')}) END", uid=f"concat('user_sid=', {t('user_sid')})", type_id=f"concat('user_type_id=', {t('user_type_id')})"),
        "c8_recorded_legacy": legacy("qradar", "src_ip"),
        "f1_epoch_ms": v("webhook", "time"), "f2_epoch_ms_iso_only": v("sentinel", "time"), "f3_epoch_ms_truncating": v("qradar", "time"),
        "f4_iso_ms_legacy": legacy("ecs", "time"), "f5_logscale_time_legacy": legacy("logscale", "time"), "f6_qradar_time_legacy": legacy("qradar", "time", "error"),
        "f7_convert_timestamp": on_all(
            splunk=f"CAST(CAST({t('_time')} AS BIGINT) * 1000 AS VARCHAR)", sentinel=f"CAST({iso(t('TimeGenerated'))} AS VARCHAR)", qradar=t("starttime"),
            webhook=f"CAST(CASE WHEN regexp_full_match({t('event_time')}, '[0-9]+') THEN CASE WHEN CAST({t('event_time')} AS BIGINT) < 10000000000 THEN CAST({t('event_time')} AS BIGINT) * 1000 ELSE CAST({t('event_time')} AS BIGINT) END ELSE {iso(t('event_time'))} END AS VARCHAR)"),
        "f8_convert_timestamp_legacy": on_all(sentinel=_legacy_iso(t("TimeGenerated")).format(ms=iso(t("TimeGenerated"))), qradar=_legacy_iso(t("starttime")).format(ms=f"CAST({t('starttime')} AS BIGINT)")),
        "f9_convert_boolean": on_all(ASSETS, enabled=_boolean("enabled"), pid=_boolean("pid")),
        "f10_convert_boolean_legacy": on_all(ASSETS, enabled=_boolean("enabled"), pid=_boolean("pid")),
        "f11_integer_passthrough": on_all(ASSETS, port=t("port")),
        "f12_best_int": on_all(ASSETS, port=whole(t("port")), pid=whole(t("pid"))), "f13_bool_int": on_all(ASSETS, port=whole(t("port")), pid=whole(t("pid"))),
        "f14_strip": on_all(src_ip=f"trim({t('src_ip')})", result=f"trim({t('result')})"),
        "f15_units": on_all(ASSETS, size_bytes=t("size_bytes"), duration=t("duration")),
        "f16_units_legacy": on_all(ASSETS, duration=f"CASE WHEN {t('duration')} LIKE '%ms' THEN CAST(replace({t('duration')}, 'ms', '') AS DOUBLE) WHEN {t('duration')} LIKE '%s' THEN CAST(replace({t('duration')}, 's', '') AS DOUBLE) * 1000 WHEN {t('duration')} LIKE '%m' THEN CAST(replace({t('duration')}, 'm', '') AS DOUBLE) * 60000 ELSE CAST({t('duration')} AS DOUBLE) END"),
        "f17_enums": on_all(severity=enum(t("SeverityLevel"), X.ENUMS["sentinel"]["severity"]), action=enum(t("action"), X.ACTION_ENUM)),
        "f18_enums_legacy": on_all(severity=enum(t("SeverityLevel"), X.ENUMS_LEGACY["sentinel"]["severity"]), level=enum(t("loglevel"), X.ENUMS_LEGACY["logscale"]["severity"])),
        **{f"{q}": v(n, "severity_id") for q, n in {"f19_severity_splunk": "splunk", "f20_severity_sentinel": "sentinel", "f21_severity_ecs": "ecs", "f22_severity_qradar": "qradar", "f23_severity_logscale": "logscale", "f24_severity_webhook": "webhook"}.items()},
        "f25_severity_qradar_legacy": legacy("qradar", "severity_id"), "f26_severity_logscale_legacy": legacy("logscale", "severity_id"),
        "f27_status_cim": v("splunk", "status_id"), "f28_status_asim": v("sentinel", "status_id"), "f29_status_webhook": v("webhook", "status_id"),
        "f30_status_legacy": legacy("sentinel", "status_id"), "f31_activity_legacy": legacy("logscale", "activity_id"),
        "f32_spec_transforms": on_all(time=iso(t("TimeGenerated")), src_port=f"CAST({whole(t('SrcPortNumber'))} AS INT)"),
        "f35_type_names": on_all(**{k: f"CASE {ty(k)} WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'OBJECT' THEN 'dict' WHEN 'NULL' THEN 'NoneType' END" for k in ("starttime", "source", "src_ip", "username")}),
        "n1_splunk": v("splunk"), "n2_sentinel": v("sentinel"), "n3_ecs": v("ecs"), "n4_qradar": v("qradar"), "n5_logscale": v("logscale"), "n6_webhook": v("webhook"),
        "n7_splunk_compat": on_all(time=f"CASE WHEN j IS NOT NULL THEN {VENDORS['splunk']['time']} END", user_name=first_truthy("user", "src_user"), device_ip=first_truthy("dest_ip", "dest")),
        "n8_splunk_legacy": legacy("splunk"), "n9_sentinel_legacy": legacy("sentinel"), "n10_ecs_legacy": legacy("ecs"), "n11_qradar_legacy": legacy("qradar"), "n12_logscale_legacy": legacy("logscale"),
        "n13_dispatch": DET + f"SELECT raw_log_id, vendor, {_all_flat()} FROM d",
        "n14_batch": DET + f"SELECT raw_log_id, coalesce({GOOD}, false) AS success, {ERROR} AS error, {dispatched('time')} AS time FROM d",
        "n15_summary": DET + f"SELECT count(*) AS total, count(*) FILTER (coalesce({GOOD}, false)) AS success_count, count(*) FILTER (NOT coalesce({GOOD}, false)) AS failure_count FROM d",
        "o1_user": on_all(ASSETS, name=coalesce(["user_name", "user"]), uid=t("user_sid"), type_id=whole(t("user_type_id")), group_names=f"CASE WHEN {has('groups')} THEN concat(j->>'$.groups[0]', ';admins/', j->>'$.groups[1].uid') ELSE '' END"),
        "o2_endpoint": on_all(ASSETS, built="true", ip=t("ip"), port=whole(t("port")), mac=t("mac")),
        "o3_hashes": on_all(ASSETS, built=f"{t('file_hash_sha256')} <> ''", sha256=f"CASE WHEN {t('file_hash_sha256')} <> '' THEN {t('file_hash_sha256')} END"),
        "o4_file": on_all(ASSETS, built=has("file_name"), name=t("file_name"), size=whole(t("file_size")), md5=t("file_hashes", "md5")),
        "o5_process": on_all(ASSETS, built="true", pid=whole(t("pid")), name=t("process_name"), user_name=t("process_user")),
        "o6_device": on_all(ASSETS, built=has("device_name"), name=t("device_name"), os=t("device_os", "name"), os_version=t("device_os", "version")),
        "o7_actor": on_all(ASSETS, built="true", user_name=t("actor_user"), session_uid=t("session_uid"), process=t("process_name")),
        "t1_transform": _transformed(False), "t2_transform_legacy": _transformed(True),
        "t3_not_dict": on_all(error=f"CASE WHEN j IS NULL THEN '{X.MSG_NOT_DICT}' END"),
        "t4_spec_splunk": on_all(**{k: f"CASE WHEN j IS NOT NULL THEN {e} END" for k, e in {"class_uid": "3002", "time": f"CAST({t('_time')} AS BIGINT) * 1000", "user_name": t("user"), "status_id": f"CASE {t('action')} WHEN 'success' THEN 1 WHEN 'failure' THEN 2 ELSE 99 END"}.items()}),
        "t4_spec_asim_network": on_all(**{k: f"CASE WHEN j IS NOT NULL THEN {e} END" for k, e in {"class_uid": "4001", "time": iso(t("TimeGenerated")), "src_ip": t("SrcIpAddr"), "src_port": f"CAST({whole(t('SrcPortNumber'))} AS INT)", "dst_ip": t("DstIpAddr"), "status": t("EventResult"), "status_id": f"CASE {t('EventResult')} WHEN 'Success' THEN 1 WHEN 'Failure' THEN 2 ELSE 99 END"}.items()}),
        "t4_spec_ecs": on_all(**{k: f"CASE WHEN j IS NOT NULL THEN {e} END" for k, e in {"class_uid": "3002", "time": iso_basic(t("@timestamp")), "user_name": f"coalesce({t('user.name')}, {t('user', 'name')})", "src_ip": f"coalesce({t('source.ip')}, {t('source', 'ip')})", "status_id": f"CASE coalesce({t('event.outcome')}, {t('event', 'outcome')}) WHEN 'success' THEN 1 WHEN 'failure' THEN 2 ELSE 99 END"}.items()}),
        "t5_template": on_all(ASSETS, class_uid="1001", user_name=t("TargetUserName"), ip=t("IpAddress"), port=t("IpPort"), actor=t("SubjectUserName")),
        "t6_typed_model": on_all(CANDIDATES, errors=f"concat_ws(';', {', '.join(typed)})"),
        "t7_typed_event": on_all(CANDIDATES, class_uid=f"coalesce({whole(t('class_uid'))}, 3001)", category_uid=f"coalesce({whole(t('category_uid'))}, 3)", activity_id="1", severity_id="1", status_id="99", time=f"CASE WHEN {t('time')} = 'true' THEN 1 ELSE {whole(t('time'))} END"),
        **{q: CANDIDATES + f"SELECT raw_log_id, {_event_errors(pr)} = '' AS is_valid, {_event_errors(pr)} AS errors FROM ev" for q, pr in {"v1_validate": "v2", "v2_object_checks": "objects", "v3_validate_legacy": "legacy", "v4_validate_revalidation": "revalidation"}.items()},
        "v5_webhook_payload": INGEST + "SELECT delivery_id, CASE WHEN ok THEN perr END AS errors FROM i",
        "v6_readable_time": on_all(**{k: f"coalesce(regexp_full_match({t(k)}, '-*[0-9]+') OR {iso(t(k))} IS NOT NULL, false)" for k in ("event_time", "TimeGenerated", "action")}),
        "v7_split": DET + f"SELECT raw_log_id, CASE WHEN coalesce({GOOD} AND {dispatched('has_actor')}, false) THEN 'valid' ELSE 'dead' END AS side FROM d",
        "w1_register": conn_ctes + "SELECT seq, id, CASE WHEN id NOT IN (SELECT id FROM old) AND seq = min(seq) OVER (PARTITION BY id) THEN 'registered' ELSE 'CONNECTOR_EXISTS' END AS outcome FROM req",
        "w2_list": conn_ctes + "SELECT id, name, hmac_enabled, is_active FROM old",
        "w3_delete": conn_ctes + "SELECT id, name FROM old WHERE id NOT IN (SELECT id FROM req)",
        "w4_connector_lookup": DELIVERIES + "SELECT delivery_id, connector_id IN (SELECT id FROM connectors) AS known FROM deliveries",
        "f34_hmac_sign": SIGNED + f"SELECT delivery_id, {_signature('raw_body')} AS signature FROM s",
        "w5_authenticate_hmac": SIGNED + f"""SELECT delivery_id, CASE WHEN ipad IS NULL THEN 'connector_not_found' WHEN NOT is_active THEN 'connector_inactive'
          WHEN {_signature("concat(raw_body, CASE delivery_id % 3 WHEN 2 THEN ' ' ELSE '' END)")} = {_signature('raw_body')} THEN 'hmac' ELSE 'unauthorized' END AS auth FROM s""",
        "w5_authenticate": INGEST + "SELECT delivery_id, auth FROM i", "w6_json": INGEST + "SELECT delivery_id, ok AS is_json FROM i",
        "w7_ingest": INGEST + f"SELECT delivery_id, outcome, CASE outcome WHEN 'INVALID_JSON' THEN 'invalid JSON' WHEN 'SCHEMA_VALIDATION_FAILED' THEN perr WHEN 'NORMALIZATION_FAILED' THEN concat('{X.MSG_UNKNOWN_VENDOR}', raw_body) WHEN 'OCSF_VALIDATION_FAILED' THEN 'Class 3002 (Authentication) missing ''user'' or ''actor'' context' END AS errors, CASE WHEN outcome = 'VALID' THEN {dispatched('time')} END AS time, CASE WHEN outcome = 'VALID' THEN {dispatched('status_id')} END AS status_id FROM i",
        "w8_health": INGEST + f"SELECT connector_id, {HEALTH}, {LATENCY} AS total_latency_ms FROM i WHERE outcome <> 'CONNECTOR_NOT_FOUND' GROUP BY 1",
        "w9_health_report": INGEST + f"SELECT connector_id, {HEALTH}, {LATENCY} // count(*) AS avg_latency_ms, max(arrived_at_ms) AS last_seen_ms, arg_max(CASE outcome WHEN 'VALID' THEN 'valid' WHEN 'UNAUTHORIZED' THEN 'auth_failed' ELSE 'invalid' END, (arrived_at_ms - 1704000000000) * 1000000 + delivery_id) AS last_status, arg_max({REASON}, (arrived_at_ms - 1704000000000) * 1000000 + delivery_id) AS last_error FROM i WHERE outcome <> 'CONNECTOR_NOT_FOUND' GROUP BY 1".replace(f"arg_max({REASON}", f"nullif(arg_max(coalesce({REASON}, '')").replace("+ delivery_id) AS last_error", "+ delivery_id), '') AS last_error"),
        "r1_register_class": class_ctes + f"SELECT seq, CASE WHEN NOT {valid_class} THEN 'INVALID_REGISTRATION' WHEN (organization, class_uid) NOT IN (SELECT (organization, class_uid) FROM old) AND seq = min(seq) FILTER ({valid_class}) OVER (PARTITION BY organization, class_uid) THEN 'registered' ELSE 'CUSTOM_CLASS_EXISTS' END AS outcome FROM req",
        "r2_list_classes": class_ctes + "SELECT id, organization, class_uid FROM req WHERE organization = 'org-7' ORDER BY seq DESC",
        "r3_find_class": class_ctes + "SELECT CASE WHEN req.id IS NULL THEN 'CUSTOM_CLASS_NOT_FOUND' ELSE 'found' END AS outcome, count(*) AS n FROM lineitem l LEFT JOIN req ON req.id = concat('id-', l.l_orderkey + l.l_linenumber) GROUP BY 1",
        "x1_key_check": _with(("r", REQ)) + f"SELECT arrival_seq, {BAD_KEY} AS bad FROM r",
        "x2_resolve": RESOLVED + f"SELECT arrival_seq, outcome, CASE WHEN {ANSWERED} THEN first_id END AS run_event_id, CASE WHEN {ANSWERED} THEN first_errs = '' END AS valid, outcome = 'already_processed' AS idempotent FROM x",
        "x3_revalidate": _with(("r", REQ)) + f"SELECT arrival_seq, {RERR} = '' AS valid, {RERR} AS errors FROM r",
        "x4_run_ids": RESOLVED + f"SELECT arrival_seq, CASE WHEN {ANSWERED} THEN concat('rerun-', substr(sha256(idempotency_key), 1, 32)) END AS re_run_id FROM x",
        "x5_new_runs": RESOLVED + "SELECT event_id, idempotency_key, errs = '' AS valid FROM x WHERE outcome = 'completed'",
        "x6_find_runs": RESOLVED + "SELECT arrival_seq, CASE WHEN k IS NULL THEN 'RE_RUN_NOT_FOUND' ELSE 'found' END AS outcome, first_id AS event_id FROM x",
        "x7_delta": _delta(), "x8_delta_report": _report(),
        "u1_callable_extractor": on_all(ASSETS, built="true", ip=t("ip"), hostname=f"concat('host-', {t('ip')})"),
        "u2_vendor_plugin": DET + f"SELECT raw_log_id, CASE vendor WHEN 'unknown' THEN 'acme' ELSE vendor END AS vendor, CASE vendor WHEN 'unknown' THEN received_at_ms ELSE {dispatched('time')} END AS time, CASE vendor WHEN 'unknown' THEN {t('some_random_key')} ELSE {dispatched('user_name')} END AS user_name, CASE vendor WHEN 'unknown' THEN 'Acme Box' ELSE {dispatched('product')} END AS product, CASE vendor WHEN 'unknown' THEN 'actor.user.name<some_random_key' ELSE {dispatched('provenance')} END AS provenance FROM d",
    }
    specs = {"splunk": "t4_spec_splunk", "asim": "t4_spec_asim_network", "ecs": "t4_spec_ecs"}
    shown = ", ".join(f"{n}.{c} AS {n}_{c}" for n in specs for c in T4_NAMES[n])
    dead = out["a7_dead_letters"]
    return out | {
        "a3_partition_read": DET + "SELECT raw_log_id, raw_payload, received_at_ms FROM d WHERE vendor = 'ecs' AND strftime(make_timestamp(received_at_ms * 1000), '%Y-%m-%d') = '2024-01-05'",
        "a4_events_with_logs": DET + f"SELECT raw_log_id, vendor AS vendor_source, {dispatched('severity_id')} AS severity_id, {dispatched('time')} AS event_time_ms, received_at_ms FROM d WHERE {GOOD} AND raw_log_id % 50 <> 0",
        "a4_orphans": DET + f"SELECT raw_log_id, {dispatched('time')} AS event_time_ms FROM d WHERE {GOOD} AND raw_log_id % 50 = 0",
        "a8_dead_letter_read": f"SELECT row_number() OVER (ORDER BY raw_log_id % 2, dlq_timestamp, raw_log_id) - 1 AS position, raw_log_id, failure_reason, errors, dlq_timestamp FROM ({dead})",
        "a9_purge_log": out["a9_purge"],
        "f33_request_hash": _request_hash(),
        "t4_specs_in_one_pass": f"SELECT splunk.raw_log_id, {shown} FROM ({out[specs['splunk']]}) splunk JOIN ({out[specs['asim']]}) asim USING (raw_log_id) JOIN ({out[specs['ecs']]}) ecs USING (raw_log_id)",
        "w1_register_over_time": conn_ctes + "SELECT seq, CASE WHEN id NOT IN (SELECT id FROM old) AND seq = first_value(seq) OVER (PARTITION BY id ORDER BY seq % 2 = 0, seq) THEN 'registered' ELSE 'CONNECTOR_EXISTS' END AS outcome FROM req",
        "r1_register_over_time": class_ctes + f"SELECT seq, CASE WHEN NOT {valid_class} THEN 'INVALID_REGISTRATION' WHEN seq = first_value(seq) OVER (PARTITION BY organization, class_uid, {valid_class} ORDER BY seq % 2 = 0, seq) THEN 'registered' ELSE 'CUSTOM_CLASS_EXISTS' END AS outcome FROM req",
        "w8_health_upsert": out["w8_health"], "w11_streaming_health": out["w9_health_report"], "x2_resolve_stored": out["x2_resolve"],
    }


T4_NAMES = {"splunk": ["class_uid", "time", "user_name", "status_id"], "asim": ["class_uid", "time", "src_ip", "src_port", "dst_ip", "status", "status_id"],
            "ecs": ["class_uid", "time", "user_name", "src_ip", "status_id"]}


def _request_hash() -> str:
    """The canonical request spelled out: keys in order, no spaces, floating numbers in their shortest form."""
    def number(e: str, k: str) -> str:
        return f"json_extract_string({e}, '$.{k}')"

    u, o = "updated_event", "original_event"
    name = "json_extract_string({}, '$.user.name')"
    updated = (f"""concat('{{"big":', {number(u, 'big')}, ',"category_uid":3', CASE WHEN json_exists({u}, '$.class_uid') THEN ',"class_uid":3002' ELSE '' END,
      ',"message":', CAST(json_extract({u}, '$.message') AS VARCHAR), ',"nest":{{"a":[1.0,1,', CAST(CAST(json_extract({u}, '$.nest.a[2]') AS DOUBLE) AS VARCHAR), '],"b":{{"c":2.0}}}},"severity_id":',
      {number(u, 'severity_id')}, ',"status_id":', {number(u, 'status_id')}, ',"time":', CAST(json_extract({u}, '$.time') AS VARCHAR),
      ',"user":{{"name":"', {name.format(u)}, '","uid":null}}}}')""")
    original = (f"""concat('{{"big":', {number(o, 'big')}, ',"category_uid":3,"class_uid":3002,"nest":{{"a":[1,true,0.5],"b":{{"c":2}}}},"severity_id":', {number(o, 'severity_id')},
      ',"status_id":1,"time":', {number(o, 'time')}, ',"user":{{"name":"', {name.format(o)}, '","uid":null}}}}')""")
    return _with(("r", REQ)) + f"""SELECT arrival_seq, sha256(concat('{{"event":', {updated}, ',"event_id":"', event_id, '","original_event":', {original}, '}}')) AS h FROM r"""
