"""Tables unique in a key that batches change: each batch rewrites only the buckets of keys it touches, and readers switch in one step.

A table is a folder. ``rows/<version>/bucket=<b>`` holds the rows of a bucket as some version wrote them, ``manifest/<version>.json``
says which version each bucket is at, and which batch came last. A version counts once its manifest is there; a crash before
leaves files that no manifest names. Batches come in the order of their ids: one that a manifest names already changes nothing, so
replays are safe. Of two writers of one version the first to publish wins; the other merges again with what that one wrote.

Cost follows the batch: rows that go into the shuffle are the batch's and those of its buckets. The manifest has at most BUCKETS entries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siemloom.sources import files

BUCKETS = 64
KEPT = 2  # versions whose files stay for readers that have begun
_EMPTY = {"version": 0, "batch": None, "buckets": {}, "schema": None}

Combine = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, path: str) -> dict:
    found = [n for n in files.names(spark, f"{path}/manifest") if n.endswith(".json")]
    return json.loads(files.content(spark, f"{path}/manifest/{found[-1]}")) if found else dict(_EMPTY)


def _rows(spark: SparkSession, path: str, state: dict, schema: StructType, buckets: list[str] | None = None) -> DataFrame:
    places = [f"{path}/rows/{v}/bucket={b}" for b, v in state["buckets"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last published version."""
    state = manifest(spark, path)
    if state["schema"] is None:
        raise FileNotFoundError(f"no version in {path}")
    return _rows(spark, path, state, StructType.fromJson(state["schema"]))


def merge(batch: DataFrame, path: str, keys: list[str], batch_id: int, combine: Combine) -> None:
    """Apply one batch: ``combine(old, new)`` gives the rows of the touched buckets, with the batch's columns."""
    spark = batch.sparkSession
    if _applied(manifest(spark, path), batch_id):
        return
    staged = f"{path}/staged/{batch_id}-{uuid.uuid4()}"
    batch.withColumn("bucket", bucket_of(*keys)).repartition("bucket").write.partitionBy("bucket").parquet(staged)
    touched = [n.split("=")[1] for n in files.names(spark, staged) if n.startswith("bucket=")]
    new = spark.read.schema(batch.schema).parquet(*[f"{staged}/bucket={b}" for b in touched]) if touched else spark.createDataFrame([], batch.schema)
    while not _applied(state := manifest(spark, path), batch_id):
        version = f"{state['version'] + 1}-{uuid.uuid4()}"
        if touched:
            merged = combine(_rows(spark, path, state, batch.schema, touched), new).select(*batch.columns)
            merged.withColumn("bucket", bucket_of(*keys)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows/{version}")
            filled = [n.split("=")[1] for n in files.names(spark, f"{path}/rows/{version}") if n.startswith("bucket=")]
        else:
            filled = []
        after = {"version": state["version"] + 1, "batch": batch_id, "schema": json.loads(batch.schema.json()),
                 "buckets": {b: v for b, v in state["buckets"].items() if b not in touched} | {b: version for b in filled}}
        if files.publish(spark, f"{path}/manifest/{after['version']:012}.json", json.dumps(after)):
            _forget(spark, path)
            break
        files.remove(spark, f"{path}/rows/{version}")
    files.remove(spark, staged)


def _applied(state: dict, batch_id: int) -> bool:
    return state["batch"] is not None and state["batch"] >= batch_id


def _forget(spark: SparkSession, path: str) -> None:
    """Remove manifests before the last few, and the files that only they name."""
    found = [n for n in files.names(spark, f"{path}/manifest") if n.endswith(".json")]
    states = {n: json.loads(files.content(spark, f"{path}/manifest/{n}")) for n in found}
    kept = {x for n in found[-KEPT:] for x in states[n]["buckets"].items()}
    for n in found[:-KEPT]:
        for b, v in set(states[n]["buckets"].items()) - kept:
            files.remove(spark, f"{path}/rows/{v}/bucket={b}")
        files.remove(spark, f"{path}/manifest/{n}")


def replaced(*keys: str) -> Combine:
    """New rows in place of old ones of the same key."""
    return lambda old, new: old.join(new.select(*keys), list(keys), "left_anti").select(*new.columns).unionByName(new)


def added_if_absent(*keys: str) -> Combine:
    """Old rows stay; new ones only where the key is free."""
    return lambda old, new: old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


# ------------------------------------------------------------------ registrations
def claim(requests: DataFrame, path: str, keys: list[str], order: str, batch_id: int, columns: list[str] | None = None) -> DataFrame:
    """Register a batch in a table unique in ``keys``; adds ``claimed``: whether the request's row is the one that holds its key.

    The first request of a batch in its order competes for a key; earlier batches win over later ones, and of batches that run at once the
    one that is published first. A replay gives what the first run gave. Requests with a null key claim nothing.
    """
    spark = requests.sparkSession
    columns = columns or []
    full = requests.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    first = full.groupBy(*keys).agg(F.min_by(F.struct(order, *columns), order).alias("_first"))
    rows = first.select(*keys, F.lit(batch_id).cast("bigint").alias("batch_id"), *[F.col(f"_first.{c}").alias(c) for c in [order, *columns]])
    merge(rows, path, keys, batch_id, added_if_absent(*keys))
    holders = read(spark, path).where(F.col("batch_id") == batch_id).select(*keys, F.col(order).alias("_holder"))
    if len(keys) > 1:  # one column, for heavy keys to be split by
        one = F.when(F.concat(*keys).isNotNull(), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))
        holders = holders.select(one.alias("_key"), "_holder")
        requests = requests.withColumn("_key", one)
    else:
        holders = holders.withColumnRenamed(keys[0], "_key")
        requests = requests.withColumn("_key", F.col(keys[0]))
    from siemloom.operators import lookup

    out = lookup.spread_join(requests, holders, "_key", F.col(order))
    return out.withColumn("claimed", F.coalesce(F.col("_holder") == F.col(order), F.lit(False))).drop("_key", "_holder")
