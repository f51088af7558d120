"""Batches of raw payloads as files, taken end to end: read, refused or normalized, written into the tables, summed up.

Logs are normalized once, into a staged table from which all sinks are filled. Each sink has the run among its partitions, so that a run that broke off
and is repeated replaces what it left; a run is committed in one step, and readers see committed runs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.operators import normalize, validate
from siemloom.sources import files, tables

#: Partitions of each sink beside the run, and what rows are sorted by within them.
SINKS = {
    "raw_logs": (["vendor_source", "received_date"], "received_at_ms"),
    "events": (["event_date"], "event_time_ms"),
    "audit": (["status"], "raw_log_id"),
    "dead_letters": (["dlq_day"], "dlq_timestamp"),
}


def _dead(checked: DataFrame) -> DataFrame:
    dead = tables.dead_letters(
        checked.where("NOT success"), F.lit("normalization_failed"), F.array("error"), F.col("raw_payload"), F.col("received_at_ms"))
    return dead.select("raw_log_id", "failure_reason", "validation_errors", F.col("dead_payload").alias("raw_payload"), "dlq_timestamp",
                       tables.day_of(F.col("dlq_timestamp")).alias("dlq_day"))


def run_batches(spark: SparkSession, source: str, out: str, run: int, fmt: str = "parquet", batch: str = "batch_id",
                limit: int = X.MAX_BATCH) -> DataFrame:
    """Take files with raw_log_id, raw_payload, received_at_ms and a batch; one summary row per batch.

    Batches of more than ``limit`` rows are refused whole: they appear in the summary and in no sink,
    as do rows without a batch. A batch may hold most of all rows.
    """
    columns = ["raw_log_id", batch, "raw_payload", "received_at_ms"]
    logs = tables.read_batch(spark, source, fmt).select(*columns)
    taken = tables.accept_batches(logs, batch, "raw_log_id", limit).where("accepted").select(*columns)
    checked = normalize.normalize(taken).withColumn(
        "errors", F.coalesce(validate.normalized_errors(F.col("event")), F.array().cast("array<string>")))
    checked = checked.select(*columns, "vendor", "event", "error", "success", "errors")
    staged = f"{out}/staged/run={run}"
    checked.write.mode("overwrite").parquet(staged)
    checked = spark.read.schema(checked.schema).parquet(staged)
    sinks = {"raw_logs": tables.raw_log_table(checked), "events": tables.event_table(checked), "audit": tables.audit_table(checked), "dead_letters": _dead(checked)}
    for name, rows in sinks.items():
        partitions, cluster = SINKS[name]
        tables.write(rows.withColumn("run", F.lit(run).cast("bigint")), f"{out}/{name}", *partitions, "run", cluster=cluster)
    sizes = logs.groupBy(batch).agg(F.count(F.lit(1)).alias("received"))
    counts = checked.groupBy(batch).agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))
    none = F.lit(0).cast("bigint")
    summary = sizes.join(counts, sizes[batch].eqNullSafe(counts[batch]), "left").select(
        sizes[batch], (sizes[batch].isNotNull() & (F.col("received") <= limit)).alias("accepted"), "received",
        F.coalesce("success_count", none).alias("success_count"), F.coalesce("failure_count", none).alias("failure_count"))
    summary.write.mode("overwrite").parquet(f"{out}/summaries/run={run}")
    files.publish(spark, f"{out}/commits/{run}", "")
    files.remove(spark, staged)
    return spark.read.parquet(f"{out}/summaries/run={run}")


def read_sink(spark: SparkSession, out: str, sink: str) -> DataFrame:
    """Rows of committed runs."""
    done = [int(n) for n in files.names(spark, f"{out}/commits") if n.isdigit()]
    if not done:
        raise FileNotFoundError(f"no committed run in {out}")
    return spark.read.parquet(f"{out}/{sink}").where(F.col("run").isin(done))
