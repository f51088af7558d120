"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulo: int, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulo)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """text and y of at most `most` labelled documents of each class that aren't held out, in the order of a hash of the id.

    An id with labels of both kinds, or a null id or label, is left out. Only the chosen ids (2 * most at most) are sent to all tasks.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    some = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
