import tempfile

import pytest
from pyspark.sql import functions as F

from siemloom.operators import webhook
from siemloom.sources import derived, files, snapshots
from siemloom.streaming import webhook_stream

SF = "/root/testdata/sf0.001"


def key(r):
    return r.connector_id


def folder():
    return tempfile.mkdtemp(prefix="stream-", dir="/tmp")


def test_ingest_that_breaks_between_sinks_ends_as_the_batch(spark, monkeypatch):
    """Replayed deliveries, an abort after the first sink, a restart, a connector switched off before the last run."""
    base = folder()
    deliveries = derived.deliveries(spark, SF).where("delivery_id % 2 = 0")
    deliveries.repartition(2).write.json(f"{base}/in")
    deliveries.where("delivery_id % 5 = 0").repartition(1).write.mode("append").json(f"{base}/in")  # delivered again
    state = {"active": True}

    def connectors(s):
        c = derived.connectors(s)
        return c if state["active"] else c.withColumn("is_active", F.lit(False))

    def run():
        stream = webhook_stream.read_deliveries(spark, f"{base}/in", max_files=2)
        webhook_stream.start_ingest(stream, connectors, f"{base}/out", f"{base}/cp", available_now=True, delay="60 days").awaitTermination()

    real, calls = webhook.dead_letters, []

    def breaks_once(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("broken off")
        return real(df)

    monkeypatch.setattr(webhook, "dead_letters", breaks_once)
    with pytest.raises(Exception, match="broken off"):
        run()
    assert files.names(spark, f"{base}/out/events") == ["batch=0"] and files.names(spark, f"{base}/out/commits") == []
    with pytest.raises(FileNotFoundError):
        webhook_stream.read_sink(spark, f"{base}/out", "events")
    run()
    run()  # nothing new
    batch = webhook.ingest(deliveries, derived.connectors(spark))
    want = webhook.health_report(webhook.health_counters(webhook.delivery_status(batch)))
    assert sorted(webhook_stream.health_so_far(spark, f"{base}/out").collect(), key=key) == sorted(want.collect(), key=key)
    dead = webhook_stream.read_sink(spark, f"{base}/out", "dead_letters").count()
    assert dead == real(batch).count() > 0 and files.names(spark, f"{base}/out/staged") == []
    before = sum(r.valid_count for r in want.collect())
    state["active"] = False  # read anew by the next batch
    derived.deliveries(spark, SF).where("delivery_id % 2 = 1").repartition(1).write.mode("append").json(f"{base}/in")
    run()
    after = webhook_stream.health_so_far(spark, f"{base}/out").collect()
    assert sum(r.valid_count for r in after) == before and sum(r.auth_failures for r in after) > sum(r.auth_failures for r in want.collect())


def test_health_upsert_takes_each_batch_once(spark):
    table = folder()
    ingested = webhook.ingest(derived.deliveries(spark, SF), derived.connectors(spark)).select(
        "delivery_id", "connector_id", "outcome", "auth", "arrived_at_ms", "latency_ms").cache()
    parts = [ingested.where("delivery_id % 2 = 0"), ingested.where("delivery_id % 2 = 1 AND connector_id = 'c1'"), ingested.where("false")]
    for batch_id in (0, 0, 1, 1, 0, 2):
        webhook.upsert_health(parts[batch_id], table, batch_id)
    want = webhook.health_counters(webhook.delivery_status(parts[0].unionByName(parts[1])))
    assert sorted(snapshots.read(spark, table).collect(), key=key) == sorted(want.collect(), key=key)
    state = snapshots.manifest(spark, table)
    assert state["version"] == 3 and state["batch"] == 2
    rewritten = {b for b, v in state["buckets"].items() if v.startswith("2-")}
    assert len(rewritten) == 1 < len(state["buckets"])  # one connector, one bucket; the others are as batch 0 wrote them
    ingested.unpersist()


def test_the_first_to_publish_wins(spark):
    table = folder()
    make = lambda rows: spark.createDataFrame(rows, "seq int, id string")
    one = snapshots.claim(make([(1, "a"), (2, "a"), (3, None)]), table, ["id"], "seq", 0)
    assert {r.seq: r.claimed for r in one.collect()} == {1: True, 2: False, 3: False}
    real = files.publish

    def slower(s, path, text):
        """Another writer publishes the same version first."""
        files.publish = real
        snapshots.merge(make([(9, "b")]).select("id", F.lit(1).cast("bigint").alias("batch_id"), "seq"), table, ["id"], 1, snapshots.added_if_absent("id"))
        return real(s, path, text)

    files.publish = slower
    try:
        two = snapshots.claim(make([(4, "a"), (5, "b"), (6, "c")]), table, ["id"], "seq", 2)
        assert {r.seq: r.claimed for r in two.collect()} == {4: False, 5: False, 6: True}
    finally:
        files.publish = real
    again = snapshots.claim(make([(4, "a"), (5, "b"), (6, "c")]), table, ["id"], "seq", 2)  # a replay
    assert {r.seq: r.claimed for r in again.collect()} == {4: False, 5: False, 6: True}


def test_stateful_health_with_late_and_repeated_deliveries_and_a_restart(spark):
    base = folder()
    ingested = webhook.ingest(derived.deliveries(spark, SF), derived.connectors(spark))
    statuses = webhook.delivery_status(ingested).cache()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    part = lambda k: statuses.where(f"delivery_id % 3 = {k}")  # noqa: E731  arrivals of all parts span the whole month, so all but the first come late
    try:
        def run():
            stream = spark.readStream.schema(statuses.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            webhook_stream.start_health(stream, f"{base}/table", f"{base}/cp", available_now=True, delay="40 days").awaitTermination()

        part(0).coalesce(1).write.mode("append").parquet(f"{base}/in")
        part(1).unionByName(part(0).where("delivery_id % 2 = 0")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run()
        part(2).unionByName(part(1)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run()
        got = webhook.health_report(snapshots.read(spark, f"{base}/table"))
        want = webhook.health_report(webhook.health_counters(statuses))
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
        assert snapshots.manifest(spark, f"{base}/table")["version"] >= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        statuses.unpersist()
