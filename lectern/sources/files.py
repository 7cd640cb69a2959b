"""Text files: scans with size guard, decoding and rejects, and the corpus text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import stored

SUFFIXES = ("txt", "md", "html", "htm", "xhtml")
DOCUMENTATION = ("readme", "license", "licence", "changelog", "contributing", "notice")
MOST_BYTES = 50 * 1024 * 1024
#: Bytes 0x80 to 0x9F of the Western code page; five of them have no character in it.
_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
_C1 = [b for b in range(0x80, 0xA0) if chr(b) not in _UNDEFINED]


def size_guard(size: Column, most: int = MOST_BYTES) -> Column:
    """Why a file of this size is not read: it is empty, or larger than `most` bytes; null for others."""
    return F.when(size == 0, "empty").when(size > most, "too large")


def scan_corpus(spark: SparkSession, folder: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files to read, files skipped): path, size and why a file is left out; contents are not read.

    Documentation files, other suffixes and files beyond the size guard are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", F.col("length").alias("size"))
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    stem, suffix = F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1), F.regexp_extract(name, r"\.([^.]*)$", 1)
    why = F.coalesce(F.when(~suffix.isin(*SUFFIXES), "suffix").when(stem.isin(*DOCUMENTATION), "documentation"), size_guard(F.col("size")))
    marked = files.withColumn("reason", why)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def decoded(content: Column) -> Column:
    """struct(text, encoding): UTF-8 first, with or without its mark, then the Western code page, then Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    bom = utf8.startswith("\ufeff")
    latin = F.decode(content, "iso-8859-1")
    odd = latin.rlike(f"[{_UNDEFINED}]")
    western = F.translate(latin, "".join(map(chr, _C1)), bytes(_C1).decode("cp1252"))
    text = F.coalesce(F.when(bom, F.substring(utf8, 2, 1 << 30)).otherwise(utf8), F.when(odd, latin).otherwise(western))
    return F.struct(text.alias("text"), F.when(bom, "utf-8-sig").when(utf8.isNotNull(), "utf-8").when(odd, "latin-1").otherwise("cp1252").alias("encoding"))


def scan_text(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects): path, text, encoding, content_hash (SHA-256 of the bytes); blank texts and sizes beyond the guard are rejected."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    odd = raw.select("path", size_guard(F.col("length")).alias("reason")).where("reason is not null")
    read = raw.where(size_guard(F.col("length")).isNull()).select("path", decoded(F.col("content")).alias("d"), F.sha2("content", 256).alias("content_hash")).select("path", "d.*", "content_hash")
    blank = F.regexp_replace("text", r"(?U)\s", "") == ""
    return read.where(~blank), read.where(blank).select("path", F.lit("no text").alias("reason")).unionAll(odd)


def parts_of(docs: DataFrame, size: Column, limit: int) -> DataFrame:
    """(slug, document_id, part): the number of the stretch of `limit` bytes, of a slug's documents in order, that a document begins in.

    A running sum without a group in one task: sums run within ranges of (slug, document_id), and
    start from the totals of the ranges before, of which a slug has as many as there are tasks.
    """
    ranged = docs.select("slug", "document_id", size.cast("long").alias("size")).repartitionByRange("slug", "document_id").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "corpus-ranges")  # so that every use sees the same ranges
    before = F.sum("total").over(Window.partitionBy("slug").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("slug", "range").agg(F.sum("size").alias("total")).select("slug", "range", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.sum("size").over(Window.partitionBy("slug", "range").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(starts) if starts.count() <= 100_000 else starts, ["slug", "range"])
    return placed.select("slug", "document_id", F.floor((F.col("start") + F.col("within")) / limit).cast("long").alias("part"))


def write_corpus(docs: DataFrame, folder: str, most: int = MOST_BYTES) -> None:
    """Texts below a folder for each slug and part, documents in order of `document_id` under header blocks.

    docs (slug, document_id, name, number, issuer, status, url, text), one row for each slug and
    document_id. A text holds the documents that begin in one stretch of most / 2 bytes of their
    slug, so that none goes beyond `most` bytes, the guard of the scans, but for a document of over
    half as many; and a slug is written by as many tasks as it has parts.
    """
    rule = "=" * 80
    head = F.concat_ws("\n", F.upper("name"), F.lit(rule), F.lit(""), F.concat(F.lit("Identificador Oficial: "), "number"), F.concat(F.lit("Emisor: "), "issuer"), F.concat(F.lit("Estado de Vigencia: "), "status"), F.concat(F.lit("Fuente Oficial: "), "url"), F.lit(""), F.lit(rule), F.lit(""), "text")
    blocks = docs.select("slug", "document_id", head.alias("value"))
    parts = parts_of(blocks, F.octet_length("value") + 1, most // 2)
    placed = blocks.join(parts, ["slug", "document_id"]).repartition("slug", "part").sortWithinPartitions("slug", "part", "document_id")
    placed.select("slug", "part", "value").write.partitionBy("slug", "part").mode("overwrite").text(folder)
