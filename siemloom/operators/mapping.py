"""Projections generated from declarative mapping specs and templates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import times
from siemloom.functions import values as V
from siemloom.sources import files

TYPES = {"long": "bigint", "integer": "int", "string": "string"}


def read_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON mapping specs, one spec a file: field maps and value maps."""
    raw = spark.read.text(path, wholetext=True)
    block = ("struct<target_class_uid:int,target_category_uid:int,"
             "field_maps:array<struct<source_field:string,target_field:string,data_type:string,transformation:string>>,"
             "value_mappings:map<string,struct<source_field:string,default_value:int,value_map:map<string,int>>>>")
    spec = raw.select(F.from_json("value", f"struct<source_schema:string,mappings:map<string,{block}>>").alias("s"))
    blocks = spec.select("s.source_schema", F.explode("s.mappings").alias("class_name", "b"))
    fields = blocks.select(
        "source_schema", "class_name", "b.target_class_uid", "b.target_category_uid",
        F.explode("b.field_maps").alias("f")).select("*", "f.*").drop("f")
    values = blocks.select("source_schema", "class_name", F.explode("b.value_mappings").alias("target", "v"))
    values = values.select(
        "source_schema", "class_name", "target", "v.source_field", "v.default_value",
        F.explode("v.value_map").alias("word", "code"))
    return fields, values


def spec_rows(spark: SparkSession) -> DataFrame:
    """Field maps of the built-in specs."""
    rows = [
        (schema, name, block["target_class_uid"], *field)
        for schema, blocks in X.MAPPING_SPECS.items()
        for name, block in blocks.items()
        for field in block["field_maps"]
    ]
    return spark.createDataFrame(
        rows, "source_schema string, class_name string, target_class_uid int, source_field string,"
              " target_field string, data_type string, transformation string")


#: Rows of specs (fields and words of values) that are compiled into one projection.
MAX_SPEC_ROWS = 10_000


def blocks_of(fields: DataFrame, values: DataFrame) -> dict[tuple[str, str], dict]:
    """Spec blocks by (schema, class), in the form of the built-in specs, from the tables of :func:`read_spec`."""
    rows, words = (df.limit(MAX_SPEC_ROWS + 1).collect() for df in (fields, values))
    if max(len(rows), len(words)) > MAX_SPEC_ROWS:
        raise ValueError(f"more than {MAX_SPEC_ROWS} rows of mapping specs")
    blocks: dict[tuple[str, str], dict] = {}
    for r in rows:
        block = blocks.setdefault((r.source_schema, r.class_name), {
            "target_class_uid": r.target_class_uid, "target_category_uid": r.target_category_uid, "field_maps": [], "value_mappings": {}})
        block["field_maps"].append((r.source_field, r.target_field, r.data_type, r.transformation))
    for r in words:
        maps = blocks[r.source_schema, r.class_name]["value_mappings"]
        maps.setdefault(r.target, (r.source_field, r.default_value, {}))[2][r.word] = r.code
    return blocks


def write_specs(spark: SparkSession, specs: dict, path: str) -> None:
    """Specs as JSON, one a file, as :func:`read_spec` takes them."""
    for schema, blocks in specs.items():
        mappings = {name: {
            "target_class_uid": b["target_class_uid"], "target_category_uid": b["target_category_uid"],
            "field_maps": [dict(zip(("source_field", "target_field", "data_type", "transformation"), f, strict=True)) for f in b["field_maps"]],
            "value_mappings": {t: {"source_field": v[0], "default_value": v[1], "value_map": v[2]} for t, v in b["value_mappings"].items()},
        } for name, b in blocks.items()}
        files.publish(spark, f"{path}/{schema}.json", json.dumps({"source_schema": schema, "mappings": mappings}, indent=1))


def _source(m: Column, name: str) -> Column:
    """A flat key, else the nested path of that name."""
    return F.coalesce(m[name], V.walk(m, name)) if "." in name else m[name]


def _mapped(m: Column, source: str, data_type: str, transformation: str | None) -> Column:
    v = V.Value.of(_source(m, source))
    if transformation == "iso_to_epoch_ms":
        out = times.iso_ms(v.text)
    elif transformation == "epoch_to_epoch_ms":
        out = (times.float_text(v.text) * 1000).try_cast("bigint")
    elif transformation == "uppercase":
        out = F.upper(v.text)
    else:
        out = v.text if data_type == "string" else v.whole
    return out.try_cast(TYPES[data_type])


def _nest(columns: dict[str, Column]) -> list[Column]:
    """Columns named by dotted paths as nested structs."""
    tree: dict = {}
    for path, column in columns.items():
        *parents, leaf = path.split(".")
        node = tree
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = column

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(c)) if isinstance(c, dict) else c).alias(k) for k, c in node.items()]

    return build(tree)


def spec_sources(block: dict) -> list[str]:
    names = [f[0] for f in block["field_maps"]] + [v[0] for v in block["value_mappings"].values()]
    return list(dict.fromkeys(k for n in names for k in (n, n.split(".")[0])))


def apply_spec(df: DataFrame, block: dict, payload: str = "raw_payload") -> DataFrame:
    """Add ``event``, one struct generated from the spec block."""
    df = V.parse_event(df, payload, spec_sources(block))
    return df.withColumn("event", F.when(F.col("m").isNotNull(), _spec_event(F.col("m"), block))).drop("m")


def apply_specs(df: DataFrame, blocks: dict[str, dict], schema: Column | None = None, payload: str = "raw_payload") -> DataFrame:
    """Add one struct for each named spec block, all from one parse of the payload; with ``schema`` only the struct it names for a row is filled."""
    df = V.parse_event(df, payload, list(dict.fromkeys(k for b in blocks.values() for k in spec_sources(b))))
    wanted = {name: F.col("m").isNotNull() & (F.lit(True) if schema is None else schema == name) for name in blocks}
    return df.withColumns({name: F.when(wanted[name], _spec_event(F.col("m"), b)) for name, b in blocks.items()}).drop("m")


def _spec_event(m: Column, block: dict) -> Column:
    columns = {
        "class_uid": F.lit(block["target_class_uid"]),
        "category_uid": F.lit(block["target_category_uid"]),
    }
    for source, target, data_type, transformation in block["field_maps"]:
        columns[target] = _mapped(m, source, data_type, transformation)
    for target, (source, default, words) in block["value_mappings"].items():
        columns[target] = F.coalesce(V.literal_map(words)[V.text(_source(m, source))], F.lit(default))
    return F.struct(*_nest(columns))


def template_sources(template: dict) -> list[str]:
    out = []
    for leaf in template.values():
        out += template_sources(leaf) if isinstance(leaf, dict) else [leaf] if isinstance(leaf, str) else []
    return out


def fill_template(m: Column, template: dict) -> Column:
    """A struct of the template's shape; string leaves take the source's text, numbers are constants."""
    parts = []
    for name, leaf in template.items():
        if isinstance(leaf, dict):
            value = fill_template(m, leaf)
        else:
            value = V.text(m[leaf]) if isinstance(leaf, str) else F.lit(leaf)
        parts.append(value.alias(name))
    return F.struct(*parts)


def apply_template(df: DataFrame, template: dict, payload: str = "raw_payload") -> DataFrame:
    df = V.parse_event(df, payload, template_sources(template))
    return df.withColumn("event", F.when(F.col("m").isNotNull(), fill_template(F.col("m"), template))).drop("m")


def _whole_or_null(v: Column) -> Column:
    return V.Value.of(v).whole


def typed_errors(m: Column) -> Column:
    """Paths of an authentication event that break its typed model: required integers and names."""
    errors = [
        F.when(_whole_or_null(m[k]).isNull(), F.lit(k))
        for k in ("activity_id", "category_uid", "class_uid", "severity_id", "status_id")
    ]
    for path in (("user", "name"), ("device", "ip"), ("actor", "user", "name")):
        v = m[path[0]]
        for p in path[1:]:
            v = V.member(v, p)
        errors.append(F.when(~F.coalesce(V.Value.of(v).is_string, F.lit(False)), F.lit(".".join(path))))
    port = V.member(m["device"], "port")
    errors.append(F.when(V.is_set(port) & _whole_or_null(port).isNull(), F.lit("device.port")))
    return V.compact(*errors)


TYPED_DEFAULTS = {
    "event": {"class_uid": None, "category_uid": None, "activity_id": 0, "severity_id": 1, "status_id": 99},
    "authentication": {"class_uid": 3001, "category_uid": 3, "activity_id": 1, "severity_id": 1, "status_id": 99},
}


def typed_event(m: Column, model: str = "event") -> Column:
    """Base fields cast to their types with the model's defaults; ``time`` has none."""
    parts = [
        F.coalesce(_whole_or_null(m[k]).try_cast("int"), F.lit(d).cast("int")).alias(k)
        for k, d in TYPED_DEFAULTS[model].items()
    ]
    parts += [
        _whole_or_null(m["time"]).alias("time"), V.text(m["message"]).alias("message"),
        _whole_or_null(m["type_uid"]).alias("type_uid"), V.text(m["type_name"]).alias("type_name"),
    ]
    return F.struct(*parts)


TYPED_KEYS = [*TYPED_DEFAULTS["event"], "time", "message", "type_uid", "type_name"]
