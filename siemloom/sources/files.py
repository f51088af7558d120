"""Folders that driver and executors share, through Hadoop's file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a session of this machine alone, as in tests, gets a temporary one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="siemloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new table in the shared folder and read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows, written to a new table in the shared folder and read again; a file for each task and bucket of the key, so that a join by it doesn't move them."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", new_folder(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none where it doesn't exist."""
    place, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _at(spark, path)
    fs.delete(place, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole and under its name in one step; False if another writer was first."""
    place, fs = _at(spark, f"{path}.{uuid.uuid4()}.writing")
    out = fs.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(place, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as e:
        fs.delete(place, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def content(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
