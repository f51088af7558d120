"""Registry of custom event classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import values as V
from siemloom.operators import lookup
from siemloom.sources import snapshots

INVALID = "INVALID_REGISTRATION"


def register(requests: DataFrame, existing: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Add ``outcome``: registered, taken, or invalid.

    ``(organization, class_uid)`` is unique; the first valid request wins.
    Texts must not be empty and the schema must be a JSON object.
    """
    df = _with_claim(requests)
    claims = lookup.first_claims(df.filter("_valid"), "_claim", order, [])
    if existing is not None:
        taken = existing.select(
            F.to_json(F.array("organization", F.col("class_uid").cast("string"))).alias("_claim")
        ).distinct().withColumn("_taken", F.lit(True))
        claims = claims.join(taken, "_claim", "left")
    else:
        claims = claims.withColumn("_taken", F.lit(None).cast("boolean"))
    df = lookup.spread_join(df, claims, "_claim", F.col(order))
    free = F.col("_taken").isNull() & (F.col(order) == F.col(f"first_{order}"))
    return df.withColumn("outcome", _outcome(free)).drop("_valid", "_claim", "_taken", f"first_{order}")


def _outcome(free: Column) -> Column:
    return F.when(~F.col("_valid"), F.lit(INVALID)).when(free, F.lit("registered")).otherwise(F.lit(X.CODE_CLASS_EXISTS))


def _with_claim(requests: DataFrame) -> DataFrame:
    """Add ``_valid`` and ``_claim``, the unique pair as one text."""
    filled = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("organization", "class_name", "version")]
    whole = [F.col(c).isNotNull() for c in ("class_uid", "category_uid")]
    document = V.any_json(F.col("schema"))
    is_object = F.coalesce(V.Value.of(document).is_object, F.lit(False))
    valid = is_object
    for check in [*filled, *whole]:
        valid = valid & check
    return requests.withColumn("_valid", valid).withColumn(
        "_claim", F.to_json(F.array(F.col("organization"), F.col("class_uid").cast("string"))))


def register_batch(requests: DataFrame, table: str, batch_id: int, order: str = "seq") -> DataFrame:
    """Registrations that arrive over time: adds ``outcome`` and keeps the winners in a class table."""
    df = _with_claim(requests)
    df = df.withColumn("_claim", F.when(F.col("_valid"), F.col("_claim")))
    out = snapshots.claim(df, table, ["_claim"], order, batch_id, [c for c in requests.columns if c != order])
    return out.withColumn("outcome", _outcome(F.col("claimed"))).drop("_valid", "_claim", "claimed")


def listed(classes: DataFrame, organization: str | None = None) -> DataFrame:
    """Classes, newest first; an empty organization does not filter."""
    if organization:
        classes = classes.filter(F.col("organization") == organization)
    return classes.orderBy(F.col("created_at").desc())


def find(wanted: DataFrame, classes: DataFrame, key: str = "id") -> DataFrame:
    """Look classes up by id; ``outcome`` says when there is none."""
    found = lookup.spread_join(wanted, classes.withColumn("_found", F.lit(True)), key, F.monotonically_increasing_id())
    return found.withColumn(
        "outcome", F.when(F.col("_found"), F.lit("found")).otherwise(F.lit(X.CODE_CLASS_NOT_FOUND))).drop("_found")
