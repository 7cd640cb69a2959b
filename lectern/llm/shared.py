"""Tables written to the folder that driver and executors share, and plain text splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; its own folder only where that is unset and the session is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that executors share; it is unset")
        at = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read from there, so that the lineage ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table that `written` made and nothing will read again."""
    spark = df.sparkSession
    at = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == at.rstrip("/").rsplit("/", 1)[-1]:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand texts to Python by `rows` at most, unless the session has less; both sides of a worker hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_HELD: dict = {}


def given_back() -> None:
    """Returns what the process has freed to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held_here(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between batches and tasks: the thing made for `key`, and nothing of an earlier operator."""
    if key not in _HELD:
        _HELD.clear()
        given_back()
        _HELD[key] = make()
    return _HELD[key]


def byte_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text as UTF-8, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []
