"""Vendor field rules as data.

Each vendor lists, per target field, which source keys feed it, how the value is
looked up, when the source is noted as provenance and when the target is emitted.
:mod:`siemloom.operators.normalize` compiles the table to one set of columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import values as V
from siemloom.functions.texts import Texts

# look:  truthy  first truthy of the keys
#        path    first non-null along dotted paths
#        nested  nested path, else the flat dotted key
# when:  present any key is present | value the value is not null
#        truthy  the value is truthy | always


@dataclass(frozen=True)
class Field:
    keys: tuple[str, ...]
    look: str = "truthy"
    noted: str = "present"
    emitted: str = "present"

    def choose(self, e: Texts, of: Callable[[str], Column], nested: Callable[[Column], Column]) -> Column:
        """``of(key)`` for the key the lookup settles on, ``nested(value)`` for a nested hit."""
        if self.look == "nested":
            path = self.keys[0]
            if "." not in path:
                return of(path)
            return F.when(e.walk(path).isNotNull(), nested(e.walk(path))).otherwise(of(path))
        if self.look == "path":
            plain = [F.when(e[k].isNotNull(), of(k)) for k in self.keys if "." not in k]
            dotted = [F.when(V.is_set(e.walk(k)), nested(e.walk(k))) for k in self.keys if "." in k]
            return F.coalesce(*plain, *dotted)
        if len(self.keys) == 1:
            return of(self.keys[0])
        chain = F.when(e.truthy(self.keys[0]), of(self.keys[0]))
        for k in self.keys[1:-1]:
            chain = chain.when(e.truthy(k), of(k))
        return chain.otherwise(of(self.keys[-1]))

    def text(self, e: Texts) -> Column:
        return self.choose(e, lambda k: e[k], V.text)

    def kind(self, e: Texts) -> Column:
        return self.choose(e, e.kind, V.kind)

    def variant(self, e: Texts) -> Column:
        return self.choose(e, e.variant, lambda v: v)

    def truthy(self, e: Texts) -> Column:
        """Whether the looked-up value is truthy."""
        if self.look == "nested" and "." in self.keys[0]:
            return self.choose(e, e.truthy, V.truthy)
        return reduce(lambda a, b: a | b, [e.truthy(k) for k in self.keys])

    def holds(self, when: str, e: Texts) -> Column:
        if when == "always":
            return F.lit(True)
        if when == "present":
            return e.has_any(self.keys)
        return self.text(e).isNotNull() if when == "value" else F.coalesce(self.truthy(e), F.lit(False))

    def source(self, e: Texts) -> Column:
        """Source key to note, NULL when nothing is noted."""
        if self.look == "path":
            plain = [F.when(e[k].isNotNull(), F.lit(k)) for k in self.keys if "." not in k]
            dotted = [F.when(V.is_set(e.walk(k)), F.lit(k)) for k in self.keys if "." in k]
            return F.coalesce(*plain, *dotted)
        name = F.lit(self.keys[-1])
        for k in reversed(self.keys[:-1]):
            name = F.when(e.has(k), F.lit(k)).otherwise(name)
        return name if self.noted == "always" else F.when(self.holds(self.noted, e), name)


@dataclass(frozen=True)
class Vendor:
    name: str
    product: tuple[str, str]
    time: Field
    severity: Field
    status: Field
    src: Field
    dst: Field
    actor: Field
    message: Field | None = None
    status_words: str = "cim"
    severity_scale: str = "words"      # words | hundred | magnitude | mixed
    severity_words: dict = field(default_factory=dict, compare=False)
    strip_words: bool = False
    digit_times: bool = True
    truncate_times: bool = False
    detect: Callable[[Texts], Column] | None = field(default=None, compare=False)


def _f(*keys: str, **how: str) -> Field:
    return Field(tuple(keys), **how)


def _nested(key: str, always: bool = False) -> Field:
    when = "always" if always else "truthy"
    return Field((key,), "nested", when, when)


def _path(keys: list[str]) -> Field:
    return Field(tuple(keys), "path", "value", "value")


VENDORS: list[Vendor] = [
    Vendor(
        "splunk", X.PRODUCTS["splunk"],
        time=_f("_time", noted="value"), severity=_f("vendor_severity"), status=_f("action", "status"),
        src=_f("src_ip", "src"), dst=_f("dest_ip", "dest"), actor=_f("user", "src_user"),
    ),
    Vendor(
        "sentinel", X.PRODUCTS["sentinel"],
        time=_f("EventStartTime", "TimeGenerated", noted="value"), severity=_f("SeverityLevel"),
        status=_f("EventResult"), src=_f("SrcIpAddr"), dst=_f("DstIpAddr", "TargetIpAddr"),
        actor=_f("TargetUsername"), status_words="asim", digit_times=False,
    ),
    Vendor(
        "ecs", X.PRODUCTS["ecs"],
        time=_nested("@timestamp", True), severity=_nested("event.severity", True),
        status=_nested("event.outcome", True), src=_nested("source.ip"), dst=_nested("destination.ip"),
        actor=_nested("user.name"), status_words="asim", severity_scale="hundred", digit_times=False,
    ),
    Vendor(
        "qradar", X.PRODUCTS["qradar"],
        time=_f("starttime", "devicetime", noted="value"),
        severity=_f("magnitude", "severity", noted="value"), status=_f("status"), src=_f("sourceip"),
        dst=_f("destinationip"), actor=_f("username", "identityusername"),
        severity_scale="magnitude", truncate_times=True,
    ),
    Vendor(
        "logscale", X.PRODUCTS["logscale"],
        time=_f("@timestamp", noted="always"), severity=_f("loglevel"), status=_f("status", "outcome"),
        src=_f("aip"), dst=_f("endpoint_ip", "dst_ip", "endpoint", noted="value", emitted="truthy"),
        actor=_f("user", "user_name"), truncate_times=True,
    ),
    Vendor(
        "webhook", X.PRODUCTS["webhook"],
        time=_path(X.TIME_KEYS), severity=_path(X.SEVERITY_KEYS), status=_path(X.STATUS_KEYS),
        src=_path(X.SOURCE_IP_KEYS), dst=_path(X.DEST_IP_KEYS), actor=_path(X.USER_KEYS),
        message=_path(X.MESSAGE_KEYS + X.EVENT_KEYS), status_words="webhook", severity_scale="mixed",
        strip_words=True,
    ),
]
