"""Parquet tables by name; the path may be in any store that Spark reads."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(table: DataFrame, most: int | None = None) -> list[tuple[str, int, int]]:
    """Name, bytes and time of change of the files that a table is read from, `most` of them at most."""
    spark = table.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    told = (path(f).getFileSystem(conf).getFileStatus(path(f)) for f in table.inputFiles()[:most])
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in told]


def spread(df: DataFrame, key: str, split_mb: int = 64) -> DataFrame:
    """`df`, read from files, dealt out by `key` if its files are too small to give every core a split of its own; larger tables stay as they lie.

    A small table comes in one row group, which one task would read and work on alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = sum(n for _, n, _ in files_of(df, cores + 1))
    return df.repartition(2 * cores, key) if size < (cores * split_mb) << 20 else df


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder, for all of the session, where that is unset and the session is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that executors share; it is unset")
        at = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def workspace(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once in the shared folder and read from there."""
    path = workspace(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(*tables: DataFrame) -> str:
    """A digest of the files that the tables are read from: their names, sizes and times."""
    return hashlib.sha256(str([sorted(files_of(t)) for t in tables]).encode()).hexdigest()[:24]


def kept(spark: SparkSession, tag: str, of: str, make: Callable[[str], None]) -> str:
    """The folder that `make` fills for the version `of` of its inputs; made by the first that asks and found by all others.

    It is filled under another name first, so that a folder that is there is whole.
    """
    path, fs = f"{shared_folder(spark)}/{tag}-{of}", spark._jvm.org.apache.hadoop.fs.Path
    store = fs(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(fs(path)):
        new = f"{path}-{uuid.uuid4().hex}"
        make(new)
        if store.exists(fs(path)) or not store.rename(fs(new), fs(path)):  # another session was first
            store.delete(fs(new), True)
    return path
