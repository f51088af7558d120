"""Keyed signatures and canonical request hashes from built-in functions."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siemloom.functions.canonical import hashable

BLOCK = 64  # bytes per SHA-256 block


def _padded(secret_hex: Column, byte: int) -> Column:
    """The block-sized key, each byte XOR-ed with ``byte``, as BINARY."""
    block = F.rpad(secret_hex, 2 * BLOCK, "0")
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCK - 1)),
        lambda i: F.lpad(
            F.hex(F.conv(block.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseXOR(F.lit(byte).cast("bigint"))),
            2, "0"),
    )
    return F.when(secret_hex.isNotNull(), F.unhex(F.array_join(mixed, "")))


def key_pads(secret: Column) -> tuple[Column, Column]:
    """Inner and outer HMAC pads of a secret, NULL without one; compute them once per connector."""
    as_hex = F.when(
        F.octet_length(secret) > BLOCK, F.sha2(secret.cast("binary"), 256)).otherwise(F.hex(secret.cast("binary")))
    return _padded(as_hex, 0x36), _padded(as_hex, 0x5C)


def hmac_sha256(inner: Column, outer: Column, body: Column) -> Column:
    """Hex HMAC-SHA256 of a body from precomputed pads."""
    digest = F.sha2(F.concat(inner, body.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def sign(secret: Column, body: Column) -> Column:
    inner, outer = key_pads(secret)
    return hmac_sha256(inner, outer, body)


@F.arrow_udf(StringType())
def _request_hash(event_id: pa.Array, original: pa.Array, updated: pa.Array) -> pa.Array:
    out = []
    for i, o, u in zip(event_id.to_pylist(), original.to_pylist(), updated.to_pylist(), strict=True):
        body = f'{{"event":{hashable(u) or "null"},"event_id":{json.dumps(i)},"original_event":{hashable(o) or "null"}}}'
        out.append(None if i is None else hashlib.sha256(body.encode()).hexdigest())
    return pa.array(out, pa.string())


def request_hash(event_id: Column, original: Column, updated: Column) -> Column:
    """SHA-256 over the canonical request ``{event, event_id, original_event}``, invalid JSON standing as null; NULL without an id.

    Batches of texts go through the standard library's JSON: as expressions over VARIANTs and their tokens this took twenty times as long.
    """
    return _request_hash(event_id, original, updated)
