"""Fast reading of raw events: a map of texts, with exact types on demand.

Most vendor rules only need the text of a member.  Parsing to a map of texts is
several times cheaper than building a VARIANT per member, and a lookup in it is
ten times cheaper than a path into a VARIANT.  The JSON type matters only for
texts that could also be a number, a boolean or a collection; only then is the
exact value taken from the parsed document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom.functions import values as V

# A text that could come from something else than a JSON string.
LOOKS_TYPED = r"^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|[{\[][\s\S]*)$"


def document(raw: Column) -> Column:
    """The whole payload as VARIANT; of repeated keys the last one counts."""
    repeated = F.to_variant_object(V.last_key_wins(F.from_json(raw, V.EVENT_MAP, V.JSON_OPTIONS)))
    return F.coalesce(F.try_parse_json(raw), repeated)


def read_texts(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Add ``m``, the top-level members as texts; NULL unless the payload is one JSON object."""
    wrapped = F.from_json(
        F.concat(F.lit("["), F.col(payload), F.lit("]")), "array<map<string,string>>", V.JSON_OPTIONS)
    df = df.withColumn("m", wrapped)
    df = df.withColumn("m", F.when((F.size("m") == 1) & V.fence(), F.get("m", F.lit(0))))
    return df.withColumn("m", F.when(V.fence(), V.last_key_wins(F.col("m"))))


def with_document(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Add ``_document``; projections that need exact types refer to this one parse."""
    return df.withColumn("_document", F.when(F.col("m").isNotNull(), document(F.col(payload))))


def with_kept(df: DataFrame, keys: Sequence[str], where: Column) -> DataFrame:
    """Add ``_texts``: these members by position, for rows that hold ``where``.

    A lookup in the map goes through its keys; rules that refer to many keys many times would do so each time.
    """
    members = [F.col("m")[k].alias(f"t{i}") for i, k in enumerate(keys)]
    return df.withColumn("_texts", F.when(where & V.fence(), F.struct(*members)))


@dataclass(frozen=True)
class Texts:
    """Access to the members of a raw event read by :func:`read_texts`.

    Exact types and nested members need :func:`with_document` as well.
    ``kept``: members that :func:`with_kept` has looked up already.
    """

    kept: tuple[str, ...] = ()

    @property
    def m(self) -> Column:
        return F.col("m")

    @property
    def keys(self) -> Column:
        return F.map_keys(self.m)

    def __getitem__(self, key: str) -> Column:
        """Text of a member; NULL when it is absent or JSON null."""
        return F.col("_texts")[f"t{self.kept.index(key)}"] if key in self.kept else self.m[key]

    def has(self, key: str) -> Column:
        return F.map_contains_key(self.m, key)

    def has_any(self, keys: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [self.has(k) for k in keys])

    def _path(self, *parts: str) -> Column:
        path = "$" + "".join(f'["{p}"]' for p in parts)
        return F.try_variant_get("_document", path, "variant")

    def walk(self, path: str) -> Column:
        """Value at the end of a dotted path of nested objects; NULL when it does not exist."""
        return F.when(self[path.split(".")[0]].startswith("{"), self._path(*path.split(".")))

    def variant(self, key: str) -> Column:
        """Exact value of a member."""
        typed = self[key].isNull() | self[key].rlike(LOOKS_TYPED)
        return F.when(~typed, V.as_variant(self[key])).when(self.has(key), self._path(key))

    def kind(self, key: str) -> Column:
        typed = self[key].rlike(LOOKS_TYPED)
        return F.when(~typed, F.lit("STRING")).when(typed, V.kind(self._path(key))).when(self.has(key), F.lit("VOID"))

    def value(self, key: str) -> V.Value:
        return V.Value(self.kind(key), self[key])

    def truthy(self, key: str) -> Column:
        t = self[key]
        return (t != "") & (~t.isin(V.EMPTY_TEXTS) | (V.kind(self._path(key)) == "STRING"))
