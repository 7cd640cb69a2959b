"""Structured Streaming jobs: ingest, rate counters, quota, exactly-once telemetry, joins, token accumulation."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions import text as T
from lectern.sources.files import MOST_BYTES, decoded, size_guard

LATE = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a job."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A table (a file or a folder) as a stream, with the table's schema and its times in the session's zone."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern, because a plain path must be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Runs over what is there now and gives what was written; a rerun goes on where this one ended."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_latest(stream: DataFrame, folder: str, *keys: str) -> DataFrame:
    """Update mode: every batch writes its changed rows under its number; the latest row of each key holds."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with settings(stream.sparkSession, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/rows")
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("n_ = 1").drop("n_", "batch")


def rate_stream(events: DataFrame, unit: str, limit: int) -> DataFrame:
    """(user_id, window_start, requests) of windows above the limit; events later than LATE are dropped."""
    n = events.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", unit).alias("w")).agg(F.count("*").alias("requests"))
    return n.where(F.col("requests") > limit).select("user_id", F.col("w.start").alias("window_start"), "requests")


class MonthTotals(StatefulProcessor):
    """Totals of one user's month; an event-time timer drops them once no event of the month is waited for any more."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.totals = handle, handle.getValueState("totals", "tokens long, requests long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.totals.exists()
        tokens, requests = self.totals.get() if known else (0, 0)
        for frame in rows:
            tokens, requests = tokens + int(frame["tokens"].sum()), requests + len(frame)
        self.totals.update((tokens, requests))
        if not known:
            closed = (pd.Timestamp(key[1]) + pd.DateOffset(months=1, days=self.days)).timestamp() * 1000
            self.handle.registerTimer(max(int(closed), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "month": [key[1]], "tokens": [tokens], "requests": [requests], "closed": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tokens, requests = self.totals.get()
        self.totals.clear()
        yield pd.DataFrame({"user_id": [key[0]], "month": [key[1]], "tokens": [tokens], "requests": [requests], "closed": [True]})

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, tokens: Column, days: int = 3) -> DataFrame:
    """(user_id, month, tokens, requests, closed): running totals by user and month.

    Events come up to `days` days of event time late. When the watermark has passed the month by so
    much, the totals are given once more as closed and leave the state, which so holds two months
    for each user at most; events of a closed month are dropped. Needs the state store of ROCKSDB.
    """
    rows = events.withWatermark("ts", f"{days} days").select("user_id", "ts", F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("month"), tokens.alias("tokens"))
    shape = f"user_id {dict(events.dtypes)['user_id']}, month string, tokens long, requests long, closed boolean"
    totals = rows.groupBy("user_id", "month").transformWithStateInPandas(MonthTotals(days), shape, "update", "eventTime")
    return totals.withColumn("month", F.to_timestamp("month"))


def dedup_stream(events: DataFrame, key: str) -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def join_usage_messages(usage: DataFrame, messages: DataFrame, within: str = "10 minutes") -> DataFrame:
    """usage (request_id, ts) with messages (request_id, sent_at) that follow within the bound."""
    u, m = usage.withWatermark("ts", LATE).alias("u"), messages.withWatermark("sent_at", LATE).alias("m")
    return u.join(m, F.expr(f"u.request_id = m.request_id and m.sent_at >= u.ts and m.sent_at <= u.ts + interval {within}")).select("u.request_id", "u.ts", "m.sent_at")


def accumulate_tokens(events: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """(job, n_tokens, finished) from (job, ts, token, last): state by job, forgotten ten minutes of event time after its last token.

    Event time rather than the clock, so that a run over what is there now comes to an end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, done = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "n_tokens": [n], "finished": [done]})
            return
        n, done = state.get if state.exists else (0, False)
        until = state.getCurrentWatermarkMs() + 1
        for frame in frames:
            n += len(frame)
            done = done or bool(frame["last"].any())
            until = max(until, int(frame["ts"].max().timestamp() * 1000) + idle_ms)
        state.update((n, done))
        state.setTimeoutTimestamp(until)
        yield pd.DataFrame({"job": [key[0]], "n_tokens": [n], "finished": [done]})

    shape = "n_tokens long, finished boolean"
    return events.withWatermark("ts", LATE).groupBy("job").applyInPandasWithState(step, f"job long, {shape}", shape, "update", GroupStateTimeout.EventTimeTimeout)


class FirstOfHash(StatefulProcessor):
    """Files (path, content_hash, content) of one hash to the same with an action; the state is the path that the content first came under."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "path string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, first, content, paths = self.stored.exists(), None, None, []
        for frame in rows:
            paths += frame["path"].tolist()
            if not known and (first is None or frame["path"].min() < first):
                first, content = frame["path"].min(), frame["content"].iloc[0]
        if not known:
            self.stored.update((first,))
        yield pd.DataFrame({"path": paths, "content_hash": key[0], "action": ["NEW" if p == first else "UNCHANGED" for p in paths], "content": [content if p == first else None for p in paths]})

    def close(self) -> None:
        pass


def ingest_stream(spark: SparkSession, folder: str, target: str, state: str, most: int = MOST_BYTES) -> None:
    """New files become rows of `target`/rows: path, content_hash (SHA-256 of the bytes), action, text (cleaned).

    action is NEW, or UNCHANGED for bytes that are stored already, under this or another path; an
    unchanged file has no text. Whether bytes are stored is the state of their hash, so that a batch
    costs what its own files cost, however many came before. Files of over `most` bytes, which are not
    read, empty and blank ones go to `target`/rejects with the reason. Each batch overwrites its own
    part, so that a batch that is run again leaves one result.
    """
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("recursiveFileLookup", "true").load(folder)
    why = size_guard(F.col("length"), most)
    read = files.where(why.isNull()).select("path", F.sha2("content", 256).alias("content_hash"), "content")
    acted = read.groupBy("content_hash").transformWithStateInPandas(FirstOfHash(), "path string, content_hash string, action string, content binary", "append", "none")
    refused = files.where(why.isNotNull()).select("path", F.lit(None).cast("string").alias("content_hash"), why.alias("action"), F.lit(None).cast("binary").alias("content"))

    def put(batch: DataFrame, number: int) -> None:
        known = F.col("action").isin("NEW", "UNCHANGED")
        texts = batch.withColumn("raw", decoded(F.col("content")).text).withColumn("blank", F.coalesce(F.regexp_replace("raw", r"(?U)\s", "") == "", F.lit(False))).persist()
        texts.where(known & ~F.col("blank")).select("path", T.clean_text(F.col("raw")).text.alias("text"), "content_hash", "action").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        texts.where(~known | F.col("blank")).select("path", F.when(known, "no text").otherwise(F.col("action")).alias("reason")).write.mode("overwrite").parquet(f"{target}/rejects/batch={number}")
        texts.unpersist()

    with settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):  # contents are large
        acted.unionByName(refused).writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
