from pyspark.sql import functions as F

from siemloom.operators import lookup, revalidate


def test_heavy_key_is_joined_whole(spark):
    left = spark.range(9000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))))
    right = left.groupBy("k").agg(F.min("id").alias("first"))
    out = lookup.spread_join(left, right, "k", F.col("id"))
    assert out.count() == 9000 and out.filter("first is null").count() == 0
    assert out.filter("k = 'hot' and first = 0").count() == 3000


def test_first_request_wins_and_stored_runs_count(spark):
    rows = [(2, "e", "k", "{}", '{"a":1}'), (1, "e", "k", "{}", '{"a": 1}'), (3, "e", "k", "{}", '{"a":2}'), (4, "e", " ", "{}", "{}")]
    requests = spark.createDataFrame(
        rows, "arrival_seq int, event_id string, idempotency_key string, original_event string, updated_event string")
    done = revalidate.resolve(requests)
    assert {r.arrival_seq: r.outcome for r in done.collect()} == {
        1: "completed", 2: "already_processed", 3: "IDEMPOTENCY_KEY_CONFLICT", 4: "INVALID_IDEMPOTENCY_KEY"}
    again = revalidate.resolve(requests, revalidate.new_runs(done))
    assert {r.arrival_seq: r.outcome for r in again.collect()}[1] == "already_processed"


def test_delta_ignores_key_order_and_number_form(spark):
    df = spark.createDataFrame(
        [('{"a":1,"b":{"x":1,"y":2},"c":null,"d":true,"z":1}', '{"a":1.0,"b":{"y":2,"x":1},"d":1,"e":"n"}')],
        "original_event string, updated_event string")
    changes = revalidate.changes(df).collect()[0].changes
    assert [(c.field, c.before, c.after) for c in changes] == [("e", None, '"n"'), ("z", "1", None)]
