"""Builders of nested objects from flat vendor fields.

A key map overrides the default source keys of an object; an entry is a key, a
list of fallback keys, or a function of the parsed event.  An object is NULL
unless one of its identifying fields is set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import values as V

GROUPS = "array<struct<name:string,uid:string>>"


def best_int(v: Column) -> Column:
    return V.Value.of(v).whole


def bool_int(v: Column) -> Column:
    r = V.Value.of(v)
    return F.when(r.is_boolean, (r.text == "true").cast("bigint")).otherwise(r.whole)


def _any_set(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])


class _Fields:
    def __init__(self, m: Column, defaults: dict, key_map: dict | None):
        self.m = m
        self.spec = {**defaults, **(key_map or {})}

    def raw(self, name: str) -> Column:
        return V.extract(self.m, self.spec.get(name))

    def text(self, name: str) -> Column:
        return V.text(self.raw(name))

    def int(self, name: str) -> Column:
        return best_int(self.raw(name))

    def struct(self, names: dict[str, str]) -> list[Column]:
        return [(self.int(n) if t == "int" else self.text(n)).alias(n) for n, t in names.items()]


def _os(v: Column) -> Column:
    return F.when(V.Value.of(v).is_object, F.struct(
        V.text(V.member(v, "name")).alias("name"), V.text(V.member(v, "version")).alias("version")))


def user(m: Column, key_map: dict | None = None) -> Column:
    f = _Fields(m, X.USER_FIELDS, key_map)
    items = F.try_variant_get(f.raw("groups"), "$", "array<variant>")
    groups = F.filter(F.transform(items, lambda g: F.when(V.Value.of(g).is_string, F.struct(
        V.text(g).alias("name"), F.lit(None).cast("string").alias("uid"))).when(V.Value.of(g).is_object, F.struct(
            V.text(V.member(g, "name")).alias("name"), V.text(V.member(g, "uid")).alias("uid")))),
        lambda g: g.isNotNull())
    return F.when(_any_set(f.text("name"), f.text("uid"), f.text("domain")), F.struct(
        *f.struct({"name": "", "uid": "", "domain": "", "email_addr": "", "type_id": "int"}),
        F.coalesce(groups, F.array().cast(GROUPS)).alias("groups")))


def endpoint(m: Column, key_map: dict | None = None) -> Column:
    f = _Fields(m, X.ENDPOINT_FIELDS, key_map)
    return F.when(_any_set(f.text("ip"), f.int("port"), f.text("hostname"), f.text("name")), F.struct(
        *f.struct({"ip": "", "port": "int", "hostname": "", "name": "", "domain": "", "mac": "", "uid": "",
                   "svc_name": "", "interface_uid": "", "type_id": "int"}),
        _os(f.raw("os")).alias("os")))


def hashes(m: Column, key_map: dict | None = None) -> Column:
    f = _Fields(m, X.HASH_FIELDS, key_map)
    names = list(X.HASH_FIELDS)
    found = reduce(lambda a, b: a | b, [F.coalesce(V.truthy(f.raw(n)), F.lit(False)) for n in names])
    return F.when(found, F.struct(*[f.text(n).alias(n) for n in names]))


def file(m: Column, key_map: dict | None = None) -> Column:
    f = _Fields(m, X.FILE_FIELDS, key_map)
    spec = f.spec.get("hashes")
    if isinstance(spec, dict):
        digests = hashes(m, spec)
    else:
        v = f.raw("hashes")
        digests = F.when(V.Value.of(v).is_object, F.struct(
            *[V.text(V.member(v, n)).alias(n) for n in X.HASH_FIELDS]))
    return F.when(_any_set(f.text("name"), f.text("path"), f.text("uid")), F.struct(
        *f.struct({"name": "", "path": "", "size": "int", "uid": "", "type_id": "int", "parent_folder": ""}),
        digests.alias("hashes")))


def _inner_user(m: Column, spec) -> Column:
    if isinstance(spec, dict):
        return user(m, spec)
    name = V.text(V.extract(m, spec or None))
    nothing = F.lit(None).cast("string")
    return F.when(name.isNotNull(), F.struct(
        name.alias("name"), nothing.alias("uid"), nothing.alias("domain"), nothing.alias("email_addr"),
        F.lit(None).cast("bigint").alias("type_id"), F.array().cast(GROUPS).alias("groups")))


def process(m: Column, key_map: dict | None = None) -> Column:
    f = _Fields(m, X.PROCESS_FIELDS, key_map)
    return F.when(_any_set(f.int("pid"), f.text("name"), f.text("path"), f.text("cmd_line")), F.struct(
        *f.struct({"pid": "int", "name": "", "path": "", "cmd_line": "", "created_time": "int"}),
        _inner_user(m, f.spec.get("user")).alias("user")))


def device(m: Column, key_map: dict | None = None) -> Column:
    f = _Fields(m, X.DEVICE_FIELDS, key_map)
    return F.when(_any_set(f.text("name"), f.text("ip"), f.text("hostname"), f.text("uid")), F.struct(
        *f.struct({"name": "", "uid": "", "ip": "", "port": "int", "hostname": "", "domain": "", "mac": "",
                   "type_id": "int"}),
        _os(f.raw("os")).alias("os")))


def actor(m: Column, key_map: dict | None = None) -> Column:
    f = _Fields(m, X.ACTOR_FIELDS, key_map)
    who = _inner_user(m, f.spec.get("user"))
    spec = f.spec.get("process")
    what = process(m, spec if isinstance(spec, dict) else {})
    what = what if isinstance(spec, dict) else F.when(F.lit(False), what)
    return F.when(_any_set(who, what, f.text("session_uid")), F.struct(
        who.alias("user"), what.alias("process"), f.text("session_uid").alias("session_uid"),
        f.int("type_id").alias("type_id")))


def provenance(m: Column, prefix: str, defaults: dict, key_map: dict | None = None) -> Column:
    """Map of ``mapped.<prefix>.<field>`` to source key and value, for fields that are set."""
    spec = {**defaults, **(key_map or {})}
    entries = []
    for name, s in spec.items():
        if s is None or isinstance(s, dict):
            continue
        path = f"{prefix}.{name}"
        v = V.extract(m, s)
        entries.append(F.when(V.is_set(v), F.struct(
            F.lit(f"mapped.{path}").alias("key"),
            F.struct(V.extract_name(m, s, path).alias("original_field"), v.alias("original_value")).alias("value"))))
    return F.map_from_entries(V.compact(*entries))
