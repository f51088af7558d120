"""Column helpers over a parsed event.

A parsed event ``m`` is a struct or a map of VARIANT values; ``m[key]`` is NULL
only when the key is absent.  A key can be absent, present with JSON null, present but empty, or present with
a value; the vendor rules tell these apart, so each test is its own function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_MAP = "map<string,variant>"
JSON_OPTIONS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
# Texts of values that count as empty unless they are strings.
EMPTY_TEXTS = ["0", "0.0", "-0.0", "false", "{}", "[]"]


def event_type(keys: Sequence[str] | None = None) -> str:
    """Type of a parsed event: a struct of the wanted keys, or a map of all keys."""
    if keys is None:
        return EVENT_MAP
    return "struct<" + ",".join(f"`{k}`:variant" for k in keys) + ">"


def only_item(items: Column) -> Column:
    """The item of an array of one, else NULL."""
    return bind(items, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))


def parse_event(df: DataFrame, payload: str, keys: Sequence[str] | None = None, last: bool = False) -> DataFrame:
    """Add ``m``, the payload parsed once; NULL when it is not exactly one JSON object.

    With ``keys`` only those members are kept and each is read by position; an
    absent key is NULL and a JSON null is a VARIANT null.  The text is parsed as
    a one-element array so that trailing content makes it invalid instead of
    being ignored.  Parsing has its own projection, because a parser call inside
    a CASE would run once per use; what needs no other projection is done in the
    same one, as each writes the members anew.  ``last``: of a key repeated in a
    map the last value stays.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), F.col(payload), F.lit("]")), f"array<{event_type(keys)}>", JSON_OPTIONS)
    m = only_item(wrapped)
    return df.withColumn("m", F.when(fence(), bind(m, last_key_wins) if last else m))


def last_key_wins(m: Column) -> Column:
    """Keep the last value of a key repeated in a map (structs do so by themselves)."""
    keys = F.map_keys(m)
    later = lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
    deduplicated = F.map_from_entries(F.filter(F.map_entries(m), later))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), deduplicated).otherwise(m)


def any_json(raw: Column) -> Column:
    """The text as one VARIANT of whatever kind; NULL when it is not valid JSON."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


# ------------------------------------------------------------------- presence
def has(m: Column, key: str) -> Column:
    return m[key].isNotNull()


def has_any(m: Column, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [has(m, k) for k in keys])


def is_set(v: Column) -> Column:
    """Neither absent nor JSON null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def set_or_null(v: Column) -> Column:
    return F.when(is_set(v), v)


def truthy(v: Column) -> Column:
    """Set and not an empty string, zero, false, or an empty collection."""
    t = text(v)
    return t.isNotNull() & (t != "") & (~t.isin(EMPTY_TEXTS) | is_string(v))


# ----------------------------------------------------------------- extraction
def member(v: Column, name: str) -> Column:
    """One member of an object VARIANT; NULL when ``v`` is no object or lacks it."""
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def first_truthy(m: Column, keys: Sequence[str]) -> Column:
    """First truthy value; the last key's value when none is."""
    if len(keys) == 1:
        return m[keys[0]]
    out = F.when(truthy(m[keys[0]]), m[keys[0]])
    for k in keys[1:-1]:
        out = out.when(truthy(m[k]), m[k])
    return out.otherwise(m[keys[-1]])


def first_present(m: Column, keys: Sequence[str]) -> Column:
    """Name of the first present key, the last one when none is present."""
    if len(keys) == 1:
        return F.lit(keys[0])
    out = F.when(has(m, keys[0]), F.lit(keys[0]))
    for k in keys[1:-1]:
        out = out.when(has(m, k), F.lit(k))
    return out.otherwise(F.lit(keys[-1]))


def walk(m: Column, path: str) -> Column:
    """Walk nested objects along a dotted path; flat dotted keys do not count."""
    head, *rest = path.split(".")
    return reduce(member, rest, m[head])


def first_set(m: Column, paths: Sequence[str]) -> Column:
    """First value along the paths that is neither absent nor null."""
    return F.coalesce(*[set_or_null(walk(m, p)) for p in paths])


def first_set_name(m: Column, paths: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(is_set(walk(m, p)), F.lit(p)) for p in paths])


def nested_or_flat(m: Column, path: str) -> Column:
    """Nested value when the whole path exists (even as null), else the flat key."""
    return F.coalesce(walk(m, path), m[path])


def extract(m: Column, spec) -> Column:
    """Value for a key-map entry: a key, a list of fallback keys, or a function of ``m``."""
    if spec is None:
        return F.lit(None).cast("variant")
    if callable(spec):
        return set_or_null(spec(m))
    keys = [spec] if isinstance(spec, str) else list(spec)
    return F.coalesce(*[set_or_null(m[k]) for k in keys])


def extract_name(m: Column, spec, attribute: str) -> Column:
    """Source name of :func:`extract`; functions are recorded under the attribute name."""
    if callable(spec):
        return F.lit(attribute)
    keys = [spec] if isinstance(spec, str) else list(spec)
    return F.coalesce(*[F.when(is_set(m[k]), F.lit(k)) for k in keys])


KeySpec = str | Sequence[str] | Callable[[Column], Column] | None


# ---------------------------------------------------------------------- types
def kind(v: Column) -> Column:
    """Type text of a VARIANT, e.g. STRING, BIGINT, DECIMAL(3,1), OBJECT<...>."""
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    """Plain text of a VARIANT (strings unquoted, objects as JSON); NULL for JSON null."""
    return F.try_variant_get(v, "$", "string")


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITESPACE))


@dataclass(frozen=True)
class Value:
    """A VARIANT as its type and text.

    Reading a VARIANT copies it, so wide projections read both once, into
    columns of their own, and convert from there.
    """

    kind: Column
    text: Column

    @staticmethod
    def of(v: Column) -> Value:
        return Value(kind(v), text(v))

    @property
    def is_set(self) -> Column:
        return self.text.isNotNull()

    @property
    def is_string(self) -> Column:
        return self.kind == "STRING"

    @property
    def is_whole(self) -> Column:
        return self.kind == "BIGINT"

    @property
    def is_boolean(self) -> Column:
        return self.kind == "BOOLEAN"

    @property
    def is_number(self) -> Column:
        """Numbers and booleans."""
        return self.is_whole | self.is_boolean | self.kind.rlike("^(DECIMAL|DOUBLE|FLOAT)")

    @property
    def is_object(self) -> Column:
        return self.kind.startswith("OBJECT")

    @property
    def number(self) -> Column:
        """A number as DOUBLE, booleans as 1 and 0."""
        return F.when(self.is_boolean, (self.text == "true").cast("double")).otherwise(self.text.try_cast("double"))

    @property
    def bigint(self) -> Column:
        return self.text.try_cast("bigint")

    @property
    def whole(self) -> Column:
        """Integer reading: numbers are truncated, strings must be whole numbers."""
        cleaned = strip(self.text)
        from_text = F.when(
            cleaned.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(cleaned, F.lit("_"), F.lit("")).try_cast("bigint"))
        return (
            F.when(self.is_whole, self.bigint)
            .when(self.is_string, from_text)
            .when(self.is_number, self.number.try_cast("bigint"))
        )

    @property
    def type_name(self) -> Column:
        """Name used for a value's type in error texts."""
        return (
            F.when(self.is_string, F.lit("str"))
            .when(self.is_whole, F.lit("int"))
            .when(self.is_boolean, F.lit("bool"))
            .when(self.is_object, F.lit("dict"))
            .when(self.kind.startswith("ARRAY"), F.lit("list"))
            .when(self.kind == "VOID", F.lit("NoneType"))
            # A 64-bit integer never becomes a decimal, so wide decimals without fraction are integers.
            .when(self.kind.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$"), F.lit("int"))
            .when(self.kind.isNotNull(), F.lit("float"))
        )


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def as_variant(c: Column) -> Column:
    return c.cast("variant")


def literal_map(words: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def fence() -> Column:
    """Always true, but not to the optimizer's knowledge.

    A projection containing it keeps filters above itself.  Without it a filter
    on a derived column is rewritten in terms of the raw text, which repeats
    the parsing once per reference.
    """
    return F.monotonically_increasing_id() >= 0


def bind(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)``, where ``of`` refers to ``c`` several times and it should be computed once."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


JSON_NULL = "null"


def json_null() -> Column:
    return F.parse_json(F.lit(JSON_NULL))


def compact(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))
