"""Corpus maintenance: change detection, duplicates, upserts, legal force, listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import stored

#: Buckets of a stored table.
BUCKETS = 64
ACTIVE_MODEL = "hash/words-64"
#: Status derived from a relation, by strength.
STRENGTH = {"DEROGADO": 4, "INEXEQUIBLE": 3, "PARCIALMENTE_DEROGADO": 2, "MODIFICADO": 1}


def plan_ingest(incoming: DataFrame, current: DataFrame, cited: DataFrame, model: str = ACTIVE_MODEL, force: bool = False) -> DataFrame:
    """incoming with an action: NEW, UNCHANGED (content and model equal), REFUSED_CITED or REPLACE.

    Rows without an external id are always new; force overrides UNCHANGED, never the cited guard.
    """
    now = current.where("external_id is not null").select("source_name", "external_id", F.col("document_id").alias("current_id"), F.col("content_hash").alias("old_hash"), F.col("embedding_model").alias("old_model"))
    refs = cited.groupBy(F.col("document_id").alias("current_id")).agg(F.count("*").alias("citations"))
    both = incoming.join(now, ["source_name", "external_id"], "left").join(refs, "current_id", "left")
    same = (F.col("content_hash") == F.col("old_hash")) & (F.col("old_model") == model)
    action = F.when(F.col("current_id").isNull(), "NEW").when(F.lit(not force) & same, "UNCHANGED").when(F.col("citations") > 0, "REFUSED_CITED").otherwise("REPLACE")
    return both.select(*[F.col(c) for c in incoming.columns], "current_id", action.alias("action"))


def derive_status(docs: DataFrame, relations: DataFrame, as_of: str) -> DataFrame:
    """document_id, status as its relations in force on the day give it; the strongest wins, one section is partial."""
    kind = F.when(F.col("relation_type") == "DEROGA", F.when(F.col("affected_section").isNull(), "DEROGADO").otherwise("PARCIALMENTE_DEROGADO")).when(F.col("relation_type") == "DECLARA_INEXEQUIBLE", F.when(F.col("affected_section").isNull(), "INEXEQUIBLE").otherwise("PARCIALMENTE_DEROGADO")).when(F.col("relation_type") == "MODIFICA", "MODIFICADO")
    strength = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])
    live = relations.where(F.col("effective_date").isNull() | (F.col("effective_date") <= as_of)).select(F.col("target_id").alias("document_id"), kind.alias("derived")).where("derived is not null")
    best = live.groupBy("document_id").agg(F.max_by("derived", strength[F.col("derived")]).alias("derived"))
    return docs.join(best, "document_id", "left").select("document_id", F.coalesce("derived", F.when(F.col("status") == "DESCONOCIDO", "DESCONOCIDO").otherwise("VIGENTE")).alias("status"))


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming fields win; a curated status stays unless another than the default comes, an address unless one comes."""
    s, i = current.alias("s"), incoming.alias("i")
    given = F.when(F.col("i.status") != "DESCONOCIDO", F.col("i.status"))
    return s.join(i, F.col("s.document_id") == F.col("i.document_id"), "full_outer").select(
        F.coalesce("i.document_id", "s.document_id").alias("document_id"), F.coalesce("i.title", "s.title").alias("title"),
        F.coalesce(given, "s.status", "i.status").alias("status"), F.coalesce(F.nullif("i.source_url", F.lit("")), "s.source_url").alias("source_url"),
    )


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the documents that come anew replace all their old ones."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*new.columns).unionByName(new)


class BucketStore:
    """A table below a folder in buckets of a key's hash, of which a change rewrites those that it touches alone."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def write(self, df: DataFrame) -> None:
        self.bucketed(df).repartition("bucket").write.partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the touched buckets by combine(their rows, incoming), which must keep a row in each; their numbers, `buckets` at most, go through the driver.

        What replaces them is written aside first, since it is read from them; so a merge that is
        run again gives the same.
        """
        numbered = self.bucketed(incoming)
        touched = [r.bucket for r in numbered.select("bucket").distinct().collect()]
        table = self.spark.read.parquet(self.path)
        old = table.where(F.col("bucket").isin(touched)).drop("bucket")
        new = stored(self.bucketed(combine(old, incoming)).repartition("bucket"), "merged")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def find_duplicates(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """incoming that is there already, by external id within its source or else by content."""
    by_id = current.where("external_id is not null").groupBy("source_name", "external_id").agg(F.min("document_id").alias("by_id"))
    by_hash = current.groupBy("content_hash").agg(F.min("document_id").alias("by_hash"))
    j = incoming.join(by_id, ["source_name", "external_id"], "left").join(by_hash, "content_hash", "left")
    reason = F.when(F.col("by_id").isNotNull(), "external_id").when(F.col("by_hash").isNotNull(), "content_hash")
    return j.select(incoming["document_id"], F.coalesce("by_id", "by_hash").alias("existing_id"), reason.alias("reason")).where("reason is not null")


def dedup_hash(docs: DataFrame) -> DataFrame:
    """Of rows with equal content the smallest id is kept; counts come from a pre-aggregated group, not a window over it."""
    h = docs.select("document_id", "content_hash")
    g = h.groupBy("content_hash").agg(F.min("document_id").alias("kept_id"), F.count("*").alias("copies"))
    return h.join(g, "content_hash").select("document_id", "kept_id", "copies")


def delete_documents(docs: DataFrame, chunks: DataFrame, cited: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents left, chunks left, refused ids): cited documents are not deleted."""
    refused = ids.join(cited.select("document_id").distinct(), "document_id", "left_semi")
    gone = ids.join(cited.select("document_id").distinct(), "document_id", "left_anti")
    return docs.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti"), refused


def stale_vectors(docs: DataFrame, model: str = ACTIVE_MODEL) -> DataFrame:
    return docs.where(~F.col("embedding_model").eqNullSafe(F.lit(model))).select("document_id", "embedding_model")


def ingest_report(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: processed, stored, skipped, failed, chunks, labelled chunks, and whether the run failed."""
    p = plan.agg(F.count("*").alias("processed"), F.count_if(F.col("action").isin("NEW", "REPLACE")).alias("stored"), F.count_if(F.col("action") == "UNCHANGED").alias("skipped"), F.count_if(F.col("action") == "REFUSED_CITED").alias("failed"))
    kept = plan.where("action in ('NEW', 'REPLACE')").select("document_id")
    c = chunks.join(kept, "document_id", "left_semi").agg(F.count("*").alias("chunks"), F.count_if(F.length("content") > 200).alias("long_chunks"))
    return p.join(c).withColumn("exit_failed", F.col("failed") > 0)


def ingest_failures(plan: DataFrame) -> DataFrame:
    """The run's failures, one row each, by document."""
    return plan.where("action = 'REFUSED_CITED'").select("document_id", F.lit("cited chunks would be destroyed").alias("detail")).orderBy("document_id")


def list_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their numbers of chunks, newest first, those without a date last."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return docs.join(n, "document_id", "left").select("document_id", "title", "document_type", "status", "publication_date", F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy(F.desc_nulls_last("publication_date"), "document_id")


def alignment_check(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without chunks, or with chunks that have no vector."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"))
    j = docs.select("document_id").join(n, "document_id", "left").na.fill(0, ["chunks", "vectors"])
    return j.where("chunks = 0 or chunks <> vectors")


def catalog(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Wanted ids with their catalogue entry, or a generic one; the catalogue is a fixed short list."""
    return ids.join(F.broadcast(entries), "norm_id", "left").select("norm_id", F.coalesce("title", F.concat(F.lit("Norma "), "norm_id")).alias("title"), F.coalesce("category", F.lit("general")).alias("category"))
