"""Normalization of raw vendor events to one authentication event.

All vendors are compiled into a single projection over the parsed event: the
source is scanned once, nothing is unioned and nothing is shuffled.  Values are
picked per vendor first; the conversions (time, severity, status) then exist
once and work on the picked value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import scales, times
from siemloom.functions import values as V
from siemloom.functions.texts import Texts, read_texts, with_document, with_kept
from siemloom.operators import detect
from siemloom.operators.vendors import VENDORS, Field, Vendor

PICKED = ["time", "severity", "status", "src", "dst", "actor", "message"]
READ = ["time", "severity", "status"]     # read as text at once; the others stay VARIANT
TYPED = ["time", "severity"]              # conversions that depend on the JSON type
TARGETS = {
    "time": "time", "severity": "severity_id", "status": "status_id", "src": "src_endpoint.ip",
    "dst": "dst_endpoint.ip", "actor": "actor.user.name", "message": "message",
}


def _by_vendor(vendors: Sequence[Vendor], build: Callable[[Vendor], Column],
               numbers: dict[str, int] | None = None, single: bool | None = None) -> Column:
    """CASE over the vendor number; NULL without a match."""
    if len(vendors) == 1 and single is not False:
        return build(vendors[0])
    chain = None
    for i, v in enumerate(vendors):
        test = F.col("_vendor") == (numbers[v.name] if numbers else i)
        chain = F.when(test, build(v)) if chain is None else chain.when(test, build(v))
    return chain


def _vendor_in(vendors: Sequence[Vendor], test: Callable[[Vendor], bool]) -> Column:
    numbers = [i for i, v in enumerate(vendors) if test(v)]
    if len(numbers) == len(vendors):
        return F.lit(True)
    return F.col("_vendor").isin(numbers) if numbers else F.lit(False)


def _fields(v: Vendor) -> list[Field]:
    return [f for f in (getattr(v, p) for p in PICKED) if f]


def _many(v: Vendor, vendors: Sequence[Vendor]) -> bool:
    """Whether members are looked up ahead of the vendor's rules: of one vendor alone, or of one with long lists of keys."""
    return len(vendors) == 1 or any(f.look == "path" for f in _fields(v))


def _looked_up(vendors: Sequence[Vendor]) -> tuple[str, ...]:
    keys = {k: None for v in vendors if _many(v, vendors) for f in _fields(v) for path in f.keys for k in (path, path.split(".")[0])}
    return tuple(keys)


def _pick(vendors: Sequence[Vendor], kept: tuple[str, ...]) -> dict[str, Column]:
    """Values, noted sources and emission flags of every field."""
    plain, ahead = Texts(), Texts(kept)
    columns = {}
    for p in PICKED:
        having = [v for v in vendors if getattr(v, p)]
        numbers = {v.name: i for i, v in enumerate(vendors)}

        def pick(build: Callable[[Field, Texts], Column], having=having, numbers=numbers, p=p) -> Column:
            return _by_vendor(having, lambda v: build(getattr(v, p), ahead if _many(v, vendors) else plain),
                              numbers=numbers, single=len(vendors) == 1)

        columns[f"_{p}"] = pick(lambda f, e: f.text(e) if p in READ else f.variant(e)) \
            if having else F.lit(None).cast("string" if p in READ else "variant")
        columns[f"_{p}_from"] = pick(lambda f, e: f.source(e)) if having else F.lit(None).cast("string")
        if p in TYPED:
            columns[f"_{p}_kind"] = pick(lambda f, e: f.kind(e))
        if p not in READ:
            columns[f"_{p}_out"] = pick(lambda f, e: f.holds(f.emitted, e)) if having else F.lit(False)
    return columns


def _value(p: str) -> V.Value:
    return V.Value(F.col(f"_{p}_kind") if p in TYPED else F.lit("STRING"), F.col(f"_{p}"))


def _severity(v: Vendor) -> Column:
    raw = _value("severity")
    if v.severity_scale == "hundred":
        return scales.severity_of_hundred(raw)
    if v.severity_scale == "magnitude":
        return scales.severity_of_magnitude(raw)
    words = X.SEVERITY_WORDS.get(v.name, v.severity_words)
    if v.severity_scale == "mixed":
        return scales.severity_of_mixed(raw, words)
    return scales.severity_of_words(raw, words)


def _status(v: Vendor) -> Column:
    return scales.status_of_words(_value("status"), X.STATUS_WORDS[v.status_words], trim=v.strip_words)


def provenance_entry(target: str, source: Column) -> Column:
    return F.when(
        source.isNotNull(), F.struct(F.lit(target).alias("ocsf_field"), source.alias("raw_field")))


def _or_null(v: Column) -> Column:
    """Emitted values that are absent show as JSON null."""
    return F.coalesce(v, V.json_null())


def _event(vendors: Sequence[Vendor]) -> Column:
    provenance = V.compact(*[provenance_entry(TARGETS[p], F.col(f"_{p}_from")) for p in PICKED])
    metadata = F.struct(
        F.lit(X.SCHEMA_VERSION).alias("version"),
        F.struct(
            _by_vendor(vendors, lambda v: F.lit(v.product[0])).alias("name"),
            _by_vendor(vendors, lambda v: F.lit(v.product[1])).alias("vendor_name"),
        ).alias("product"),
        provenance.alias("provenance"),
    )

    def endpoint(p: str) -> Column:
        return F.when(F.col(f"_{p}_out"), F.struct(_or_null(F.col(f"_{p}")).alias("ip")))

    actor = F.when(
        F.col("_actor_out"), F.struct(F.struct(_or_null(F.col("_actor")).alias("name")).alias("user")))
    return F.struct(
        F.lit(X.CLASS_AUTHENTICATION).alias("class_uid"),
        F.lit(X.CATEGORY_IAM).alias("category_uid"),
        F.lit(X.ACTIVITY_LOGON).alias("activity_id"),
        F.col("_time_ms").alias("time"),
        F.col("_severity_id").alias("severity_id"),
        F.col("_status_id").alias("status_id"),
        metadata.alias("metadata"),
        endpoint("src").alias("src_endpoint"),
        endpoint("dst").alias("dst_endpoint"),
        actor.alias("actor"),
        F.when(F.col("_message_out"), F.col("_message")).alias("message"),
    )


def _project(df: DataFrame, vendors: Sequence[Vendor], received_ms: Column, payload: str) -> DataFrame:
    """Add ``event`` and ``error`` for rows whose ``_vendor`` is one of ``vendors``."""
    df = with_document(df, payload)
    keys = _looked_up(vendors)
    if keys:
        df = with_kept(df, keys, F.col("m").isNotNull() & _vendor_in(vendors, lambda v: _many(v, vendors)))
    df = df.withColumns(_pick(vendors, keys))
    digit_times = _vendor_in(vendors, lambda v: v.digit_times)
    df = df.withColumns({
        "_time_ms": times.epoch_ms(
            _value("time"), received_ms, digit_strings=digit_times,
            truncate_first=_vendor_in(vendors, lambda v: v.truncate_times)),
        "_time_bad": F.when(digit_times, times.malformed_digits(_value("time"))),
        "_severity_id": _by_vendor(vendors, _severity).cast("int"),
        "_status_id": _by_vendor(vendors, _status).cast("int"),
    })
    known = F.col("m").isNotNull() & V.fence()
    if len(vendors) > 1:
        known = known & (F.col("_vendor") >= 0)
    df = df.withColumns({
        "event": F.when(known & F.col("_time_bad").isNull(), _event(vendors)),
        "error": F.when(
            F.col("_time_bad").isNotNull(), F.format_string(X.MSG_BAD_INTEGER, F.col("_time_bad"))),
        # On its own, so that counting outcomes does not build the events.
        "success": known & F.col("_time_bad").isNull(),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def received_ms(df: DataFrame, received: str | None = "received_at_ms") -> Column:
    """Arrival time standing in for absent or unreadable event times."""
    if received and received in df.columns:
        return F.col(received).cast("bigint")
    return F.unix_millis(F.current_timestamp())


def normalize_vendor(df: DataFrame, vendor: str, payload: str = "raw_payload", received: str | None = "received_at_ms",
                     vendors: Sequence[Vendor] = VENDORS) -> DataFrame:
    """Map every row as one vendor's event, without detection."""
    rule = next(v for v in vendors if v.name == vendor)
    if "m" not in df.columns:
        df = read_texts(df, payload)
    return _project(df, [rule], received_ms(df, received), payload)


def normalize(df: DataFrame, payload: str = "raw_payload", received: str | None = "received_at_ms",
              vendors: Sequence[Vendor] = VENDORS) -> DataFrame:
    """Detect and map raw events; adds ``m``, ``vendor``, ``event``, ``error``, ``success``.

    One row in, one row out: a row that fails carries its error and no event.
    """
    rules = [(v.name, v.detect) for v in vendors if v.detect] + detect.RULES
    if "m" not in df.columns:
        df = read_texts(df, payload)
    numbers = {v.name: i for i, v in enumerate(vendors)}
    df = df.withColumn("_vendor", F.when(V.fence(), detect.vendor_number(Texts(), rules, numbers)))
    names = F.when(F.col("_vendor") == -1, F.lit(detect.UNKNOWN))
    for name, i in numbers.items():
        names = names.when(F.col("_vendor") == i, F.lit(name))
    df = df.withColumn("vendor", names)
    df = _project(df, vendors, received_ms(df, received), payload)
    unknown = F.when(
        F.col("vendor") == detect.UNKNOWN, F.concat(F.lit(X.MSG_UNKNOWN_VENDOR), F.col(payload)))
    not_object = F.when(F.col("m").isNull(), F.lit(X.MSG_NOT_DICT))
    return df.withColumn("error", F.coalesce(not_object, unknown, F.col("error")))


def register_vendor(vendor: Vendor, vendors: Sequence[Vendor] = VENDORS) -> list[Vendor]:
    """Vendor list with a plug-in; its ``detect`` rule is tried before the built-in rules."""
    return [vendor, *vendors]


def event_json(event: Column) -> Column:
    """The event as JSON text; absent objects are left out, nulls inside them are kept."""
    return F.to_json(event)


def summarize(normalized: DataFrame) -> DataFrame:
    """Totals of a batch; an empty batch gives one row of zeros."""
    return normalized.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
    )


def splunk_compat(df: DataFrame, payload: str = "raw_payload", received: str | None = "received_at_ms") -> DataFrame:
    """Splunk mapping with two extra objects, ``user.name`` and ``device.ip``."""
    e = Texts()
    df = with_document(normalize_vendor(df, "splunk", payload, received), payload)
    df = df.withColumns({
        "user": F.struct(Field(("user", "src_user")).variant(e).alias("name")),
        "device": F.struct(Field(("dest_ip", "dest")).variant(e).alias("ip")),
    })
    return df.drop("_document")
