"""Conversations: questions, histories, thread lists and their maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.files import parts_of

#: Bytes of a part of a conversation.
PART_BYTES = 1 << 20


def last_question(turns: DataFrame) -> DataFrame:
    """The last user turn of each conversation; conversations without one are left out."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("turn"))


def history(turns: DataFrame, most: int | None = 20) -> DataFrame:
    """User and assistant turns before the last of them, numbered from the latest."""
    talk = turns.where("role in ('user', 'assistant')")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    back = talk.withColumn("back", n - 1).where("back > 0")
    return (back if most is None else back.where(F.col("back") <= most)).select("conv_id", "turn", "role", "text", "back")


def assign_threads(turns: DataFrame, user: Column, known: DataFrame) -> DataFrame:
    """(conv_id, user_id, thread_key, is_new): conversations of a user that open alike share a thread."""
    first = turns.where("role = 'user'").withColumn("user_id", user).groupBy("conv_id", "user_id").agg(F.min_by("text", "turn").alias("q"))
    keyed = first.select("conv_id", "user_id", T.thread_key(F.lit(None).cast("string"), F.col("q")).alias("thread_key"))
    old = known.select("user_id", "thread_key").distinct().withColumn("seen", F.lit(True))
    return keyed.join(old, ["user_id", "thread_key"], "left").select("conv_id", "user_id", "thread_key", F.col("seen").isNull().alias("is_new"))


def list_threads(threads: DataFrame, turns: DataFrame) -> DataFrame:
    """Threads with message counts and times in epoch milliseconds, latest first; a default title where there is none."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("messages"))
    return threads.join(n, "conv_id", "left").select("conv_id", F.coalesce("title", F.lit("Nueva consulta")).alias("title"), F.coalesce("messages", F.lit(0)).alias("messages"), F.unix_millis("created_at").alias("created_ms"), F.unix_millis("updated_at").alias("updated_ms")).orderBy(F.desc_nulls_last("updated_ms"), "conv_id")


def in_parts(turns: DataFrame, line: Column, between: str, limit: int) -> DataFrame:
    """(conv_id, part, text, turns): each conversation's lines in order of turn, in parts of about `limit` bytes.

    A part holds the lines that begin in one stretch of `limit` bytes of the conversation, so a row
    is bounded however long a conversation is, and no task gathers one. turns has one row for each
    conv_id and turn.
    """
    rows = turns.select(F.col("conv_id").alias("slug"), F.col("turn").alias("document_id"), line.alias("line"))
    parts = parts_of(rows, F.octet_length("line") + len(between.encode()), limit)
    own = F.transform(F.sort_array(F.collect_list(F.struct("document_id", "line"))), lambda t: t.line)
    return rows.join(parts, ["slug", "document_id"]).groupBy(F.col("slug").alias("conv_id"), "part").agg(F.array_join(own, between).alias("text"), F.count("*").alias("turns"))


def thread_detail(turns: DataFrame, limit: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, transcript, turns): each conversation's turns in order, a long one in several parts."""
    return in_parts(turns, F.concat_ws(": ", "role", "text"), "\n", limit).withColumnRenamed("text", "transcript")


def export_threads(turns: DataFrame, limit: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, markdown): one Markdown document for each conversation, a long one in parts that follow each other."""
    heading = F.when(F.col("role") == "user", F.lit("## Pregunta")).when(F.col("role") == "assistant", F.lit("## Respuesta")).otherwise(F.lit("## Sistema"))
    parts = in_parts(turns, F.concat_ws("\n\n", heading, "text"), "\n\n", limit)
    title = F.when(F.col("part") == 0, F.concat(F.lit("# Conversación "), F.col("conv_id"), F.lit("\n\n"))).otherwise("")
    return parts.select("conv_id", "part", F.concat(title, "text").alias("markdown"))


def sync_threads(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by id: incoming titles win where present, the later update time holds."""
    s, i = stored.alias("s"), incoming.alias("i")
    return s.join(i, F.col("s.conv_id") == F.col("i.conv_id"), "full_outer").select(F.coalesce("s.conv_id", "i.conv_id").alias("conv_id"), F.coalesce("i.title", "s.title").alias("title"), F.coalesce("s.created_at", "i.created_at").alias("created_at"), F.greatest("s.updated_at", "i.updated_at").alias("updated_at"))


def delete_threads(threads: DataFrame, turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads and turns without the deleted ones."""
    gone = ids.select("conv_id").distinct()
    return threads.join(gone, "conv_id", "left_anti"), turns.join(gone, "conv_id", "left_anti")


def recency_bucket(ts: Column, now: Column) -> Column:
    day = F.date_trunc("day", now)
    days = lambda n: day - F.make_interval(days=F.lit(n))
    return F.when(ts >= day, "Hoy").when(ts >= days(1), "Ayer").when(ts >= days(7), "Últimos 7 días").when(ts >= days(30), "Últimos 30 días").otherwise("Meses anteriores")


def provision_users(events: DataFrame, known: DataFrame) -> DataFrame:
    """New users by (issuer, subject), with the first of their addresses in order, or a synthetic one where none is given."""
    seen = events.groupBy("issuer", "subject").agg(F.min("email").alias("email"))
    fresh = seen.join(known.select("issuer", "subject"), ["issuer", "subject"], "left_anti")
    return fresh.select("issuer", "subject", F.lower(F.coalesce("email", F.concat("subject", F.lit("@"), "issuer"))).alias("email"))


def merge_threads(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote titles and kinds win where present, the later time holds, what is only local stays."""
    a, b = local.alias("l"), remote.alias("r")
    return a.join(b, F.col("l.id") == F.col("r.id"), "full_outer").select(
        F.coalesce("r.id", "l.id").alias("id"), F.coalesce(F.nullif("r.title", F.lit("")), "l.title").alias("title"),
        F.coalesce("r.kind", "l.kind", F.lit("general")).alias("kind"), F.greatest("l.updated_at", "r.updated_at").alias("updated_at"),
        F.when(F.col("l.id").isNull(), "remote").when(F.col("r.id").isNull(), "local").otherwise("both").alias("side"),
    )
