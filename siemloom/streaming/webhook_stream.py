"""Webhook deliveries as streams: ingest into three sinks, and health per connector as state.

Ingest: deliveries seen before are dropped across triggers; each micro-batch runs the batch ingest once and writes events and dead letters
under its batch id, adds its counters to the health table, and is then committed in one step. Readers see committed batches only. A batch
that breaks off is run again under its id and overwrites what it left.

Health: a stateful aggregate with one row a connector, fed by deliveries that a state of seen ids lets through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siemloom import fixed_values as X
from siemloom.operators import webhook
from siemloom.operators.normalize import event_json
from siemloom.sources import files, snapshots

DELIVERY_SCHEMA = (
    "delivery_id bigint, connector_id string, secret_hdr string, signature_hdr string, raw_body string,"
    " arrived_at_ms bigint, latency_ms bigint")
#: How much later than the latest one a delivery may come, and for how long its id is remembered.
DELAY = "2 days"

Connectors = Callable[[SparkSession], DataFrame]


def read_deliveries(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None,
                    **options: str) -> DataFrame:
    """A stream of delivery files."""
    reader = spark.readStream.format(fmt).schema(DELIVERY_SCHEMA).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def once(deliveries: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each delivery once, by its id. Ids are forgotten, and later deliveries dropped, when the latest arrival is ``delay`` ahead."""
    arrived = deliveries.withColumn("_arrived", F.timestamp_millis("arrived_at_ms"))
    return arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["delivery_id"])


# --------------------------------------------------------------------- ingest
def _write_batch(out: str, connectors: Connectors):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Connectors are read for each batch, so that one registered or switched off meanwhile counts.
        done = webhook.ingest(batch.drop("_arrived"), connectors(spark)).withColumn("event_json", event_json(F.col("event"))).drop("event")
        staged = f"{out}/staged/batch={batch_id}"
        done.write.mode("overwrite").parquet(staged)
        # The sinks are filled from the written batch, so ingest runs once.
        done = spark.read.schema(done.schema).parquet(staged)
        done.filter(F.col("outcome") == X.OUTCOME_VALID).select("delivery_id", "connector_id", "vendor", "event_json") \
            .write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
        webhook.dead_letters(done).write.mode("overwrite").parquet(f"{out}/dead_letters/batch={batch_id}")
        webhook.upsert_health(done, f"{out}/health", batch_id)
        files.publish(spark, f"{out}/commits/{batch_id}", "")
        files.remove(spark, staged)

    return write


def start_ingest(deliveries: DataFrame, connectors: Connectors, out: str, checkpoint: str, available_now: bool = False,
                 delay: str = DELAY) -> StreamingQuery:
    writer = once(deliveries, delay).writeStream.foreachBatch(_write_batch(out, connectors)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_sink(spark: SparkSession, out: str, sink: str) -> DataFrame:
    """Events or dead letters of the committed batches."""
    done = [n for n in files.names(spark, f"{out}/commits") if n.isdigit()]
    if not done:
        raise FileNotFoundError(f"no committed batch in {out}")
    return spark.read.parquet(*[f"{out}/{sink}/batch={n}" for n in done])


def health_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Health over all batches merged so far."""
    return webhook.health_report(snapshots.read(spark, f"{out}/health"))


# --------------------------------------------------------------------- health
def running_health(statuses: DataFrame, delay: str = DELAY) -> DataFrame:
    """Health counters as a stateful aggregate over delivery statuses that may repeat; to be written in update mode."""
    return webhook.health_counters(once(statuses, delay))


def start_health(statuses: DataFrame, table: str, checkpoint: str, available_now: bool = False, delay: str = DELAY) -> StreamingQuery:
    """Keep a health table of the connectors up to date from a stream of delivery statuses."""

    def put(changed: DataFrame, batch_id: int) -> None:
        snapshots.merge(changed, table, ["connector_id"], batch_id, snapshots.replaced("connector_id"))

    writer = running_health(statuses, delay).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
