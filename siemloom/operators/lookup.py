"""Joins that hold when one key carries a third of the rows, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 64        # heavy hitters looked for, also the bound on the broadcast set
SALTS = 64           # pieces a heavy key is split into
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        else:
            complex_ = "<" in kind or kind == "variant"
            size = size + (F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if complex_ else 8)
    return size


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows, of about ``size`` bytes in all; reads no more than that many rows."""
    n, used = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    return n <= rows and (used or 0) <= size


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """At most ``HOT_KEYS`` frequent keys of a table (one row each).

    Only the work distribution depends on them, never the result, so an
    approximate set will do.
    """
    top = df.agg(F.expr(f"approx_top_k({key}, {HOT_KEYS}, {HOT_KEYS * 16})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key)).filter(F.col(key).isNotNull())


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join with a table unique in ``key``; heavy keys of ``left`` are split by ``spread``.

    Rows of a heavy key get one of ``SALTS`` salts; the one matching row of
    ``right`` is repeated per salt.  All other keys keep salt 0.  A null key
    matches nothing, so its rows are dealt out by a salt alone.
    """
    hot = F.broadcast(hot_keys(left, key).withColumn("_hot", F.lit(True)))
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"),
    ).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def dimension_join(left: DataFrame, dimension: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join with a dimension unique in ``key``: broadcast when small, spread otherwise."""
    if left.isStreaming or fits_broadcast(dimension):
        return left.join(dimension if left.isStreaming else F.broadcast(dimension), key, "left")
    return spread_join(left, dimension, key, spread)


def first_claims(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key the first row's ``columns`` and ``order``, prefixed with ``first_``.

    A partial aggregate, so a heavy key shrinks to one row per task before the
    shuffle; no window sorts the rows of a key.
    """
    picked = F.min_by(F.struct(*[F.col(c) for c in [order, *columns]]), F.col(order))
    claims = df.groupBy(key).agg(picked.alias("_first"))
    return claims.select(key, *[F.col(f"_first.{c}").alias(f"first_{c}") for c in [order, *columns]])
