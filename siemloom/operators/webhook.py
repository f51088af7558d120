"""Webhook deliveries: connectors, authentication, ingest outcome, delivery health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom import fixed_values as X
from siemloom.functions import crypto
from siemloom.functions import values as V
from siemloom.functions.texts import Texts, read_texts, with_document
from siemloom.operators import lookup, normalize, validate
from siemloom.sources import snapshots

REASONS = {
    X.OUTCOME_INVALID_JSON: "invalid_json",
    X.OUTCOME_SCHEMA: "schema_validation_failed",
    X.OUTCOME_NORMALIZATION: "normalization_failed",
    X.OUTCOME_EVENT: "ocsf_validation_failed",
}


# ----------------------------------------------------------------- connectors
def register(requests: DataFrame, existing: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Add ``outcome`` to registrations: the first request for a free id wins."""
    claims = lookup.first_claims(requests, key, order, [])
    taken = existing.select(key).distinct().withColumn("_taken", F.lit(True))
    decided = claims.join(taken, key, "left")
    joined = lookup.spread_join(requests, decided, key, F.col(order))
    free = F.col("_taken").isNull() & (F.col(order) == F.col(f"first_{order}"))
    return joined.withColumn(
        "outcome", F.when(free, F.lit("registered")).otherwise(F.lit(X.CODE_CONNECTOR_EXISTS)),
    ).drop("_taken", f"first_{order}")


def register_batch(requests: DataFrame, table: str, batch_id: int, key: str = "id", order: str = "seq") -> DataFrame:
    """Registrations that arrive over time: adds ``outcome`` and keeps the winners in a connector table."""
    rest = [c for c in requests.columns if c not in (key, order)]
    out = snapshots.claim(requests, table, [key], order, batch_id, rest)
    return out.withColumn("outcome", F.when(F.col("claimed"), F.lit("registered")).otherwise(F.lit(X.CODE_CONNECTOR_EXISTS))).drop("claimed")


def listed(connectors: DataFrame, with_secret: bool = False) -> DataFrame:
    return connectors if with_secret else connectors.drop("secret")


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the deleted keys; use it for connectors and for their health."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


# ------------------------------------------------------------- authentication
def _keys(connectors: DataFrame) -> DataFrame:
    """Connector side of the lookup: secret and HMAC pads, computed once per connector."""
    inner, outer = crypto.key_pads(F.col("secret"))
    return connectors.select(
        F.col("id").alias("connector_id"), F.coalesce("is_active", F.lit(True)).alias("_active"),
        F.col("secret").alias("_secret"), inner.alias("_inner"), outer.alias("_outer"))


def _method() -> Column:
    secret = V.strip(F.col("secret_hdr"))
    given = F.lower(V.strip(F.col("signature_hdr")))
    digest = F.when(given.startswith("sha256="), given.substr(F.lit(8), F.length(given))).otherwise(given)
    signed = (digest != "") & (digest == crypto.hmac_sha256(F.col("_inner"), F.col("_outer"), F.col("raw_body")))
    return (
        F.when(F.col("_active").isNull(), F.lit("connector_not_found"))
        .when(~F.col("_active"), F.lit("connector_inactive"))
        .when((secret != "") & (secret == F.col("_secret")), F.lit("secret"))
        .when(signed, F.lit("hmac"))
        .otherwise(F.lit("unauthorized"))
    )


def authenticate(deliveries: DataFrame, connectors: DataFrame) -> DataFrame:
    """Add ``auth``: secret, hmac, or why the delivery is refused.  Secrets do not leave this function."""
    joined = lookup.dimension_join(deliveries, _keys(connectors), "connector_id", F.col("delivery_id"))
    return joined.withColumn("auth", _method()).drop("_active", "_secret", "_inner", "_outer")


# --------------------------------------------------------------------- ingest
def body_text(df: DataFrame) -> DataFrame:
    """Bodies as text; binary bodies that are not UTF-8 become NULL."""
    if dict(df.dtypes)["raw_body"] != "binary":
        return df
    return df.withColumn("raw_body", F.try_validate_utf8(F.col("raw_body").cast("string")))


def ingest(deliveries: DataFrame, connectors: DataFrame) -> DataFrame:
    """Run deliveries through lookup, authentication, parsing, checks and mapping.

    One row per delivery with ``outcome``, ``errors`` and, when valid, ``event``.
    Checks after authentication see only authenticated bodies.
    """
    df = body_text(authenticate(deliveries, connectors))
    trusted = F.col("auth").isin("secret", "hmac")
    df = df.withColumn("_body", F.when(trusted, F.col("raw_body")))
    df = with_document(read_texts(df, "_body"), "_body")
    e = Texts()
    df = df.withColumn("_whole", F.when(e.m.isNull() & F.col("_body").isNotNull(), V.any_json(F.col("_body"))))
    not_json = e.m.isNull() & F.col("_whole").isNull()
    df = df.withColumns({
        "_not_json": trusted & not_json,
        "_payload_errors": F.when(trusted & ~not_json, validate.payload_errors(e, F.col("_whole"))),
    }).drop("_document", "_whole")
    df = df.withColumn("_checked", F.struct("_body", "_not_json", "_payload_errors")).drop(
        "_not_json", "_payload_errors").withColumnRenamed("_body", "body").withColumnRenamed("_checked", "checked")
    df = normalize.normalize(df, "body", "arrived_at_ms")
    df = df.withColumn("event_errors", F.when(F.col("success"), validate.normalized_errors(F.col("event"))))
    payload_errors, event_errors = F.col("checked._payload_errors"), F.col("event_errors")
    outcome = (
        F.when(F.col("auth") == "connector_not_found", F.lit(X.OUTCOME_UNKNOWN_CONNECTOR))
        .when(~trusted, F.lit(X.OUTCOME_UNAUTHORIZED))
        .when(F.col("checked._not_json"), F.lit(X.OUTCOME_INVALID_JSON))
        .when(F.size(payload_errors) > 0, F.lit(X.OUTCOME_SCHEMA))
        .when(~F.col("success"), F.lit(X.OUTCOME_NORMALIZATION))
        .when(F.size(event_errors) > 0, F.lit(X.OUTCOME_EVENT))
        .otherwise(F.lit(X.OUTCOME_VALID))
    )
    df = df.withColumn("outcome", outcome)
    errors = (
        F.when(F.col("outcome") == X.OUTCOME_INVALID_JSON, F.array(F.lit("invalid JSON")))
        .when(F.col("outcome") == X.OUTCOME_SCHEMA, payload_errors)
        .when(F.col("outcome") == X.OUTCOME_NORMALIZATION, F.array("error"))
        .when(F.col("outcome") == X.OUTCOME_EVENT, event_errors)
    )
    return df.withColumns({
        "errors": errors,
        "event": F.when(F.col("outcome") == X.OUTCOME_VALID, F.col("event")),
    }).drop("checked", "body", "event_errors", "error", "success", "m", "secret_hdr", "signature_hdr")


def is_dead(outcome: Column) -> Column:
    """Failures after authentication go to the dead-letter table."""
    return outcome.isin(list(REASONS))


def reason_of(outcome: Column) -> Column:
    return V.literal_map(REASONS)[outcome]


def dead_letters(ingested: DataFrame) -> DataFrame:
    body = F.when(
        F.col("outcome") == X.OUTCOME_INVALID_JSON, F.to_json(F.struct("raw_body"))).otherwise(F.col("raw_body"))
    return ingested.filter(is_dead(F.col("outcome"))).select(
        "delivery_id", "connector_id", F.col("arrived_at_ms").alias("dlq_timestamp"),
        reason_of(F.col("outcome")).alias("failure_reason"), F.col("errors").alias("validation_errors"),
        body.alias("raw_payload"))


# --------------------------------------------------------------------- health
COUNTERS = ["delivered", "valid_count", "invalid_count", "auth_failures", "dlq_count", "total_latency_ms"]


def delivery_status(ingested: DataFrame) -> DataFrame:
    """Status and error per delivery; unknown connectors have no health."""
    outcome = F.col("outcome")
    status = F.when(outcome == X.OUTCOME_VALID, "valid").when(
        outcome == X.OUTCOME_UNAUTHORIZED, "auth_failed").otherwise("invalid")
    error = F.when(outcome == X.OUTCOME_UNAUTHORIZED, F.col("auth")).otherwise(reason_of(outcome))
    return ingested.filter(outcome != X.OUTCOME_UNKNOWN_CONNECTOR).select(
        "connector_id", "delivery_id", "arrived_at_ms", status.alias("status"), error.alias("error"),
        F.when(status == "valid", F.col("latency_ms")).otherwise(F.lit(0)).alias("latency_ms"))


def health_counters(statuses: DataFrame) -> DataFrame:
    """Counters per connector; partial aggregates keep a busy connector small before the shuffle."""
    status = F.col("status")
    last = F.max_by(
        F.struct("arrived_at_ms", "delivery_id", "status", "error"), F.struct("arrived_at_ms", "delivery_id"))
    return statuses.groupBy("connector_id").agg(
        F.count(F.lit(1)).alias("delivered"),
        F.count_if(status == "valid").alias("valid_count"),
        F.count_if(status == "invalid").alias("invalid_count"),
        F.count_if(status == "auth_failed").alias("auth_failures"),
        F.count_if(status == "invalid").alias("dlq_count"),
        F.sum("latency_ms").cast("bigint").alias("total_latency_ms"),
        last.alias("last"))


def merge_health(*parts: DataFrame) -> DataFrame:
    """Counters of several batches added up; the latest delivery gives the last status."""
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    return everything.groupBy("connector_id").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.max_by("last", F.struct("last.arrived_at_ms", "last.delivery_id")).alias("last"))


def upsert_health(ingested: DataFrame, table: str, batch_id: int) -> None:
    """Add one batch of deliveries to the health table; only buckets of connectors seen in the batch are read and written."""
    snapshots.merge(health_counters(delivery_status(ingested)), table, ["connector_id"], batch_id, merge_health)


def health_report(counters: DataFrame) -> DataFrame:
    """Readable health; the average divides by all deliveries."""
    return counters.select(
        "connector_id", *COUNTERS[:-1],
        F.floor(F.col("total_latency_ms") / F.col("delivered")).cast("bigint").alias("avg_latency_ms"),
        F.col("last.arrived_at_ms").alias("last_seen_ms"), F.col("last.status").alias("last_status"),
        F.col("last.error").alias("last_error"))
