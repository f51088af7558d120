"""Connected components, cut lineage and tables in the shared folder, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemloom.sources.files import shared_folder, written as written


#: Tasks a core that write a checkpoint of few rows.
TASKS = 3


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows, written to the shared checkpoint folder, a file a task.

    tasks: no more than so many, or TASKS a core; by the rows' size, so that few rows in many partitions aren't as many files, for each of which the
    folder's file system may start processes, and as many tasks wherever they are read.
    """
    spark = df.sparkSession
    if tasks is not None:
        df = df.coalesce(max(TASKS * spark.sparkContext.defaultParallelism, tasks))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """node and root (least node reachable) of every node of edges (a, b). tasks: as in `cut`.

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are tied to the least node of its neighbourhood, until nothing
    changes. The rounds grow with the logarithm of a component's size, whatever its shape and the order of its nodes.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), tasks)
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), tasks)
        after = _state(edges)
        if after == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = after
