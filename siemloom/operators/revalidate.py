"""Idempotent re-validation of edited events and the field delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import canonical, crypto
from siemloom.functions import values as V
from siemloom.operators import lookup, validate
from siemloom.sources import files, tables


def key_is_bad(key: Column) -> Column:
    """Empty, too long, or not there at all."""
    return F.coalesce((V.strip(key) == "") | (F.length(key) > X.MAX_KEY_LENGTH), F.lit(True))


def run_id(key: Column) -> Column:
    """Deterministic, so that retried tasks give the same id."""
    return F.concat(F.lit("rerun-"), F.substring(F.sha2(key, 256), 1, 32))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``valid`` and ``errors`` of the updated event."""
    df = V.parse_event(requests, "updated_event", X.MANDATORY_FIELDS)
    df = df.withColumn("errors", validate.event_errors(F.col("m"), "revalidation")).drop("m")
    return df.withColumn("valid", F.size("errors") == 0)


RUN_COLUMNS = ["event_id", "request_hash", "valid", "errors"]


def resolve(requests: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Decide every request: completed, already_processed, conflict or bad key.

    The first request of a key, in arrival order, makes the run unless ``runs``
    already holds it; later ones are compared with that run's hash.  Keys are
    reduced to their first request before anything is shuffled, and the way
    back splits heavy keys.  Requests are checked and hashed once, into a table
    in the shared folder, as three branches and every use of the result read them.
    """
    df = files.written(validate_requests(requests).withColumn(
        "request_hash",
        crypto.request_hash(F.col("event_id"), F.col("original_event"), F.col("updated_event"))), "requests")
    good = df.filter(~key_is_bad(F.col("idempotency_key")))
    claims = lookup.first_claims(good, "idempotency_key", "arrival_seq", RUN_COLUMNS)
    if runs is not None:
        stored = runs.select("idempotency_key", *[F.col(c).alias(f"_old_{c}") for c in RUN_COLUMNS])
        claims = claims.join(stored.hint("merge"), "idempotency_key", "left")
        known = F.col("_old_request_hash").isNotNull()
        claims = claims.withColumns({
            "first_arrival_seq": F.when(~known, F.col("first_arrival_seq")),
            **{f"first_{c}": F.when(known, F.col(f"_old_{c}")).otherwise(F.col(f"first_{c}")) for c in RUN_COLUMNS},
        }).drop(*[f"_old_{c}" for c in RUN_COLUMNS])
    df = lookup.spread_join(df, claims, "idempotency_key", F.col("arrival_seq"))
    bad = key_is_bad(F.col("idempotency_key"))
    same = F.col("request_hash") == F.col("first_request_hash")
    is_first = F.coalesce(F.col("arrival_seq") == F.col("first_arrival_seq"), F.lit(False))
    outcome = (
        F.when(bad, F.lit(X.CODE_BAD_KEY)).when(is_first, F.lit("completed"))
        .when(same, F.lit("already_processed")).otherwise(F.lit(X.CODE_KEY_CONFLICT))
    )
    answered = outcome.isin("completed", "already_processed")
    return df.withColumn("outcome", outcome).withColumns({
        "re_run_id": F.when(answered, run_id(F.col("idempotency_key"))),
        "run_event_id": F.when(answered, F.col("first_event_id")),
        "valid": F.when(answered, F.col("first_valid")),
        "errors": F.when(answered, F.col("first_errors")),
        "idempotent": F.col("outcome") == "already_processed",
    }).drop("first_arrival_seq", *[f"first_{c}" for c in RUN_COLUMNS])


def new_runs(resolved: DataFrame) -> DataFrame:
    """Rows to append to the run table."""
    return resolved.filter(F.col("outcome") == "completed").select(
        "re_run_id", "event_id", "idempotency_key", "request_hash", "original_event", "updated_event",
        "valid", "errors")


def store_runs(resolved: DataFrame, table: str, path: str, buckets: int, mode: str = "error") -> None:
    """Keep new runs in a table bucketed by key. A later batch's keys are moved to its buckets; the stored side stays where it is, and
    Spark filters its scan by a Bloom filter of the batch's keys where that side is large."""
    tables.save_bucketed(new_runs(resolved), table, path, "idempotency_key", buckets, mode)


def find_runs(wanted: DataFrame, runs: DataFrame, key: str = "re_run_id") -> DataFrame:
    """Look runs up by id or by key; ``outcome`` says when there is none."""
    found = lookup.spread_join(wanted, runs, key, F.monotonically_increasing_id())
    return found.withColumn(
        "outcome", F.when(F.col("request_hash").isNull(), F.lit(X.CODE_RUN_NOT_FOUND)).otherwise(F.lit("found")))


def changes(df: DataFrame, before: str = "original_event", after: str = "updated_event") -> DataFrame:
    """Add ``changes``: changed top-level fields with before and after as JSON, sorted by field.

    An array expression per run, without a shuffle.
    """
    df = V.parse_event(df, before).withColumn("_before", V.last_key_wins(F.col("m")))
    df = V.parse_event(df.drop("m"), after).withColumn("_after", V.last_key_wins(F.col("m"))).drop("m")
    fields = F.array_sort(F.array_union(F.map_keys("_before"), F.map_keys("_after")))

    def pair(k: Column) -> Column:
        return F.struct(
            k.alias("field"), F.to_json(V.set_or_null(F.col("_before")[k])).alias("before"),
            F.to_json(V.set_or_null(F.col("_after")[k])).alias("after"))

    def differs(c: Column) -> Column:
        # Only texts that differ are looked at closer.
        return F.when(c["before"].eqNullSafe(c["after"]), F.lit(False)).otherwise(
            ~canonical.comparable(c["before"]).eqNullSafe(canonical.comparable(c["after"])))

    found = F.filter(F.transform(fields, pair), differs)
    # The fence keeps a later explode from computing the array once more for its own filter.
    return df.withColumn("changes", F.when(V.fence(), found)).drop("_before", "_after")
