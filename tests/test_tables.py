import hashlib
import io
import json
import random
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from siemloom.functions import canonical, crypto
from siemloom.operators import lookup, revalidate
from siemloom.sources import batches, derived, files, tables


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def folder():
    return tempfile.mkdtemp(prefix="tables-", dir="/tmp") + "/t"


def logs(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("raw_log_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("vendor_source"),
        (F.lit(1704067200000) + F.col("id") * 100_000).alias("received_at_ms"),
        tables.day_of(F.lit(1704067200000) + F.col("id") * 100_000).alias("received_date"))


def test_partitions_are_replaced_and_pruned(spark):
    path, rows = folder(), logs(spark)
    tables.write(rows, path, "vendor_source", "received_date", cluster="received_at_ms")
    tables.write(rows.where("vendor_source = 'a'"), path, "vendor_source", "received_date", cluster="received_at_ms")
    back = spark.read.parquet(path)
    assert back.count() == 4000
    day = back.where("vendor_source = 'a' AND received_date = DATE'2024-01-03' AND received_at_ms > 1704240000000")
    text = plan(day)
    assert "PartitionFilters: [isnotnull(vendor_source" in text and "GreaterThan(received_at_ms" in text
    assert 0 < len(day.select(F.input_file_name()).distinct().collect()) < len(back.select(F.input_file_name()).distinct().collect())
    assert day.count() == rows.where("vendor_source = 'a' AND received_date = DATE'2024-01-03' AND received_at_ms > 1704240000000").count()


def test_lineage_join_moves_nothing(spark):
    stored = []
    for name, df in (("events", logs(spark)), ("raw_logs", logs(spark).where("raw_log_id % 50 <> 0"))):
        table = f"{name}_{random.getrandbits(60):x}"
        tables.save_bucketed(df.select("raw_log_id", F.col("received_at_ms").alias(f"{name}_ms")), table, folder(), "raw_log_id", 4)
        stored.append(spark.table(table))
    for out, n in ((tables.events_with_logs(*stored), 3920), (tables.orphans(*stored), 80)):
        assert "Exchange" not in plan(out) and out.count() == n


def test_stored_runs_stay_in_their_buckets(spark):
    rows = [(i, f"e{i}", f"k{i % 40}" if i % 7 else None, "{}", f'{{"a":{i % 40}}}') for i in range(200)]
    requests = spark.createDataFrame(rows, "arrival_seq int, event_id string, idempotency_key string, original_event string, updated_event string")
    done = revalidate.resolve(requests.where("arrival_seq < 100"))
    table = f"runs_{random.getrandbits(60):x}"
    revalidate.store_runs(done, table, folder(), 4)
    again = revalidate.resolve(requests.where("arrival_seq >= 100"), spark.table(table))
    assert {r.outcome for r in again.collect()} == {"already_processed", "IDEMPOTENCY_KEY_CONFLICT", "INVALID_IDEMPOTENCY_KEY"} - {"IDEMPOTENCY_KEY_CONFLICT"} \
        or {r.outcome for r in again.where("idempotency_key IS NULL").collect()} == {"INVALID_IDEMPOTENCY_KEY"}
    text = plan(again, "simple")
    scan = next(i for i, line in enumerate(text.splitlines()) if "Bucketed: true" in line)
    above = text.splitlines()[max(0, scan - 4):scan]
    assert not any("Exchange" in line for line in above)


def test_dead_letter_positions_and_purge(spark):
    path = folder()
    dead = spark.range(3000).select(F.col("id").alias("raw_log_id"), (F.lit(1704067200000) + F.col("id") * 120_000 % 400_000_000).alias("dlq_timestamp"))
    for k in (0, 1, 0):
        tables.append_dead_letters(dead.where(F.col("raw_log_id") % 2 == k), path, k)
    got = tables.read_dead_letters(spark, path, "raw_log_id").select("position", "raw_log_id").collect()
    want = sorted(dead.collect(), key=lambda r: (r.raw_log_id % 2, r.dlq_timestamp, r.raw_log_id))
    assert [tuple(r) for r in got] == [(i, r.raw_log_id) for i, r in enumerate(want)]
    days = files.names(spark, path)
    tables.purge_dead_letters(spark, path, 1704067200000 + 2 * 86_400_000 + 5)
    assert [d for d in files.names(spark, path) if d.startswith("dlq")] == [d for d in days if d >= "dlq_day=2024-01-03" and d.startswith("dlq")]
    assert spark.read.parquet(path).agg(F.min("dlq_timestamp")).first()[0] >= 1704067200000 + 2 * 86_400_000


FLOATS = [0.0, -0.0, 1.0, 0.1, 1e16, 1e15, 123456789012345680.0, 9999999999999998.0, 1e-4, 1e-5, 1.5e-7, -2.5, 1e22, 1e23, 5e-324, 1.7976931348623157e308, 1e7, 12345678.9, 0.001, 100.0]


def test_request_hash_is_that_of_compact_sorted_json(spark):
    r = random.Random(2)

    def value(depth):
        kinds = ["x", "Żółć", "😀 b", 'q"\\/', "\n\t\x01\x1f\x7f", None, True, False, 7, -12, 2**53 + 1, 10**25, r.choice(FLOATS), r.random() * 10 ** r.randint(-20, 20)]
        if depth and r.random() < 0.5:
            return {r.choice(["a", "b", "é", "Z", "k 1", 'c"']): value(depth - 1) for _ in range(3)} if r.random() < 0.5 else [value(depth - 1) for _ in range(3)]
        return r.choice(kinds)

    rows = []
    for i in range(300):
        o, u = ({k: value(3) for k in "xyz"} for _ in range(2))
        rows.append((f'e"{i}ü', json.dumps(o, ensure_ascii=i % 2 == 0), json.dumps(u, indent=1 if i % 3 else None, ensure_ascii=False), o, u))
    for x in FLOATS:
        rows.append(("f", json.dumps({"x": x}), "{}", {"x": x}, {}))
    df = spark.createDataFrame([r[:3] for r in rows], "event_id string, o string, u string")
    got = [x.h for x in df.select(crypto.request_hash(F.col("event_id"), F.col("o"), F.col("u")).alias("h")).collect()]
    for h, (event_id, _, _, o, u) in zip(got, rows, strict=True):
        body = json.dumps({"event_id": event_id, "original_event": o, "event": u}, sort_keys=True, separators=(",", ":"))
        assert h == hashlib.sha256(body.encode()).hexdigest(), body


def test_comparable_follows_equality(spark):
    pairs = [("9007199254740993", "9007199254740992", False), ("9007199254740993", "9007199254740992.0", False), ("9007199254740992", "9007199254740992.0", True),
             ('{"a":[1,true,1.0]}', '{"a":[1.0,1,true]}', True), ('{"a":1,"b":false}', '{"b":0,"a":1e0}', True), ("[0.5]", "[5e-1]", True), ("[0.5]", "[0.25]", False),
             ('"1"', "1", False), ('"true"', "true", False), ("null", "0", False), ("-0", "0.0", True), ("1e30", "1000000000000000019884624838656", True), ("1e30", "10" + "0" * 29, False),
             ('"a,1.0"', '"a,1"', False), ("[[],{}]", "[{},[]]", False), ("9223372036854775808", "9223372036854775808.0", True)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    form = lambda c: canonical.comparable(F.to_json(F.try_parse_json(c)))
    for r in df.select("*", (form("a") == form("b")).alias("got")).collect():
        assert r.got == r.same, r


def test_batch_run_broken_off_is_not_seen_and_replaces_itself(spark, monkeypatch):
    path = folder()
    payload = F.concat(F.lit('{"event_type":"login","event_time":1704067200,"username":"u'), F.col("id"), F.lit('"}'))
    spark.range(60).select(
        F.col("id").alias("raw_log_id"), F.when(F.col("id") < 40, 1).when(F.col("id") < 55, 2).cast("bigint").alias("batch_id"),
        F.when(F.col("id") % 10 > 0, payload).alias("raw_payload"), F.lit(1704067200000).alias("received_at_ms")).write.parquet(f"{path}/in")

    def broken(*_):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr(files, "publish", broken)
        with pytest.raises(OSError):
            batches.run_batches(spark, f"{path}/in", f"{path}/out", 7, limit=20)
    with pytest.raises(FileNotFoundError):
        batches.read_sink(spark, f"{path}/out", "events")
    got = {r.batch_id: r[1:] for r in batches.run_batches(spark, f"{path}/in", f"{path}/out", 7, limit=20).collect()}
    assert got == {1: (False, 40, 0, 0), 2: (True, 15, 13, 2), None: (False, 5, 0, 0)}
    assert [batches.read_sink(spark, f"{path}/out", s).count() for s in batches.SINKS] == [15, 13, 15, 2]


def test_broadcast_only_of_few_bytes(spark):
    df = spark.range(50).select("id", F.expr("repeat('x', 1000)").alias("secret"), F.array("id").alias("ids"))
    assert lookup.fits_broadcast(df) and lookup.fits_broadcast(df.limit(0))
    assert not lookup.fits_broadcast(df, rows=49) and not lookup.fits_broadcast(df, size=40_000)


def test_request_hash_of_long_texts_and_of_invalid_ones(spark):
    long = json.dumps({"z": "é" * 200_000, "a": [0.5] * 3})
    cases = {long: json.loads(long), '{"a":5e-1,"b":2.0}': {"a": 0.5, "b": 2.0}, '{"a":1,"a":2}': None, '{"a":NaN}': None, "01.5": None, "1 2": None, "1" * 1001: None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.h for r in df.select("t", crypto.request_hash(F.lit("e"), F.col("t"), F.lit("{")).alias("h")).collect()}
    for t, v in cases.items():
        body = json.dumps({"event_id": "e", "original_event": v, "event": None}, sort_keys=True, separators=(",", ":"))
        assert got[t] == hashlib.sha256(body.encode()).hexdigest(), t


def test_events_are_dealt_out_and_requests_hashed_once(spark):
    events = derived.events(spark, "/root/testdata/sf0.001")
    assert events.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert events.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    resolved = revalidate.resolve(derived.revalidation_requests(spark, "/root/testdata/sf0.001"))
    assert "request_hash(" not in resolved._jdf.queryExecution().optimizedPlan().toString()
