"""Tables of the service as DataFrames and partitioned parquet sinks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.operators import lookup
from siemloom.operators.normalize import event_json
from siemloom.sources import files


def read_batch(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Raw payloads from JSON lines (``text``) or parquet, with ``raw_payload``."""
    df = spark.read.format(fmt).load(path)
    return df.withColumnRenamed("value", "raw_payload") if fmt == "text" else df


def accept_batches(df: DataFrame, batch: str, seq: str, limit: int = X.MAX_BATCH) -> DataFrame:
    """Add ``accepted``: batches of more than ``limit`` rows are rejected whole."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("batch_size"))
    return lookup.spread_join(df, sizes, batch, F.col(seq)).withColumn("accepted", F.col("batch_size") <= limit)


def day_of(ms: Column) -> Column:
    """UTC calendar day of epoch milliseconds."""
    return F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int"))


def raw_log_table(detected: DataFrame) -> DataFrame:
    return detected.select(
        "raw_log_id", F.coalesce("vendor", F.lit("unknown")).alias("vendor_source"), "raw_payload",
        "received_at_ms", day_of(F.col("received_at_ms")).alias("received_date"))


def event_table(normalized: DataFrame) -> DataFrame:
    """Promoted columns and the whole event; only successes."""
    e = F.col("event")
    return normalized.filter("success").select(
        "raw_log_id", e["class_uid"].alias("class_uid"), e["category_uid"].alias("category_uid"),
        e["activity_id"].alias("activity_id"), e["severity_id"].alias("severity_id"),
        e["time"].alias("event_time_ms"), event_json(e).alias("payload"),
        day_of(e["time"]).alias("event_date"))


def audit_table(checked: DataFrame) -> DataFrame:
    """One status per raw log: SUCCESS, FAILED or VALIDATION_ERROR (needs ``errors`` of the event)."""
    bad = F.size("errors") > 0
    status = F.when(~F.col("success"), "FAILED").when(bad, "VALIDATION_ERROR").otherwise("SUCCESS")
    message = F.when(~F.col("success"), F.col("error")).when(bad, F.array_join("errors", "; "))
    return checked.select(
        "raw_log_id", F.coalesce("vendor", F.lit("unknown")).alias("vendor"), status.alias("status"),
        message.alias("error_message"))


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows and those new ones whose key is not taken."""
    fresh = new.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def vendor_seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.VENDOR_CONFIG_SEED, "vendor_name string, adapter_class string").withColumn(
        "is_active", F.lit(True))


def write(df: DataFrame, path: str, *partitions: str, cluster: str | None = None) -> None:
    """Write into partitions; those that the rows fall into are replaced, the others stay, so a batch written again is there once.

    Rows go to the tasks by partition, and a large partition to several of them, each sorted by ``cluster``, so that the statistics
    of row groups prune within a partition.
    """
    df = df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *([cluster] if cluster else []))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, mode: str = "error") -> None:
    """A catalog table with rows in buckets of a key, so that joins by it move none of them. Give buckets as many as the session has shuffle partitions."""
    df.repartition(buckets, key).write.mode(mode).option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def events_with_logs(events: DataFrame, raw_logs: DataFrame) -> DataFrame:
    """Events beside the raw log they were made from."""
    return events.join(raw_logs.hint("merge"), "raw_log_id")


def orphans(events: DataFrame, raw_logs: DataFrame) -> DataFrame:
    """Events whose raw log isn't stored: what a foreign key would have refused."""
    return events.join(raw_logs.hint("merge").select("raw_log_id"), "raw_log_id", "left_anti")


# --------------------------------------------------------------- dead-letter log
def append_dead_letters(dead: DataFrame, path: str, batch_id: int, at_ms: str = "dlq_timestamp") -> None:
    """Add a batch to the log; a batch appended again replaces itself."""
    rows = dead.withColumns({"dlq_day": day_of(F.col(at_ms)), "batch_id": F.lit(batch_id).cast("bigint")})
    write(rows, path, "dlq_day", "batch_id", cluster=at_ms)


def read_dead_letters(spark: SparkSession, path: str, *within: str, at_ms: str = "dlq_timestamp") -> DataFrame:
    """The log in the order of insertion, with ``position`` from 0: by batch, time, then by ``within``.

    Positions are counted within each minute of a batch, beside the rows of the minutes before; only the counts of minutes, not the rows, are summed
    up in one task. The rows themselves are sorted in ranges.
    """
    log = spark.read.parquet(path).withColumn("_slot", F.floor(F.col(at_ms) / 60_000))
    counts = log.groupBy("batch_id", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("batch_id", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("batch_id", "_slot").orderBy(at_ms, *within)) - 1
    rows = log.withColumn("_row", own).join(counts, ["batch_id", "_slot"])
    return rows.withColumn("position", F.col("_before") + F.col("_row")).drop("_slot", "_row", "_before").orderBy("position")


def purge_dead_letters(spark: SparkSession, path: str, before_ms: int) -> None:
    """Retention by whole days: folders of days that end before the time are removed, no other file is touched."""
    for name in files.names(spark, path):
        day = name.removeprefix("dlq_day=")
        if day != name and (datetime.date.fromisoformat(day) - datetime.date(1970, 1, 1)).days * 86_400_000 + 86_400_000 <= before_ms:
            files.remove(spark, f"{path}/{name}")


def dead_letters(failed: DataFrame, reason: Column, errors: Column, payload: Column,
                 at_ms: Column | None = None) -> DataFrame:
    """Dead-letter columns added to a frame of failures; missing errors are an empty list."""
    return failed.withColumns({
        "dlq_timestamp": F.unix_millis(F.current_timestamp()) if at_ms is None else at_ms,
        "failure_reason": reason,
        "validation_errors": F.coalesce(errors, F.array().cast("array<string>")),
        "dead_payload": payload,
    })


def purge(queue: DataFrame, keep: Column) -> DataFrame:
    """The queue without what retention drops; write it over the old one."""
    return queue.filter(keep)


