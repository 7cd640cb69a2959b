"""Chunks of uploaded texts: articles and case-law parts, under a four-level state of structural headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import estimate_tokens_floor4, stripped

from .chunking import divide

# Lines that open a block; (level, pattern) of structural ones, then articles and case-law parts.
LEVELS = ((1, r"(?iu)^(?:LIBRO|PARTE)\s+[IVXLCDM0-9]+"), (2, r"(?iu)^T[IÍ]TULO\s+[IVXLCDM0-9]+"), (3, r"(?iu)^CAP[IÍ]TULO\s+[IVXLCDM0-9]+"), (4, r"(?iu)^SECCI[ÓO]N\s+[IVXLCDM0-9]+"))
ARTICLE = r"(?iu)^(?:ART[IÍ]CULO|Art\.)\s+[0-9]+[A-Za-z\-]*\.?"
ARTICLE_HEADING = r"(?iu)^((?:ART[IÍ]CULO|Art\.)\s+[0-9]+[A-Za-z\-]*\.?(?:\s+[^\n.]+)?(?:\.|\n))"
RULING = r"(?iu)^(?:I{1,3}|IV|V)\.?\s+(?:ANTECEDENTES|CONSIDERACIONES|DECISI[ÓO]N|RESUELVE|FUNDAMENTOS)"
NUMBER = r"(?iu)(?:art[ií]culo\s+|\bart\.\s*)([0-9]+[A-Za-z\-]*)"


def split_articles(docs: DataFrame, chunk_size: int = 1000) -> DataFrame:
    """(id, block, part, section, article_number, path, content, tokens) of (id, text).

    Structural lines set the state and give no chunk, and text before the first marker is dropped;
    a text without any marker is one block without section. Blocks of over four times `chunk_size`
    characters are divided at whole paragraphs and sentences, their parts numbered in the section.
    """
    lines = docs.where("trim(text) <> ''").select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    level = F.lit(None).cast("int")
    for k, pattern in LEVELS:
        level = F.when(F.col("line").rlike(pattern), k).otherwise(level)
    marker = F.when(level.isNotNull(), level).when(F.col("line").rlike(ARTICLE) | F.col("line").rlike(RULING), 9)
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("m", marker).withColumn("block", F.count("m").over(w))
    for k, _ in LEVELS:
        df = df.withColumn(f"t{k}", F.last(F.when(F.col("m") == k, F.struct("n", F.trim("line").alias("s"))), ignorenulls=True).over(w)).withColumn(f"r{k}", F.max(F.when(F.col("m") < k, F.col("n"))).over(w))
    state = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"r{k}"), F.lit(-1)) < F.col(f"t{k}.n"), F.col(f"t{k}.s")) for k, _ in LEVELS]))
    rows = df.select("id", "block", "n", "line", "m", state.alias("state"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n")
    blocks = rows.groupBy("id", "block").agg(stripped(body).alias("content"), F.min_by("m", "n").alias("m"), F.min_by("state", "n").alias("state"), F.max("block").alias("b"))
    most = blocks.groupBy("id").agg(F.max("block").alias("last"))
    kept = blocks.join(most, "id").where((F.col("m") == 9) | (F.col("last") == 0)).where("content <> ''")
    heading = F.when(F.col("content").rlike(ARTICLE_HEADING), F.regexp_extract("content", ARTICLE_HEADING, 1)).when(F.col("content").rlike(RULING), F.regexp_extract("content", r"^([^\n]*)", 1))
    section = F.substring(F.regexp_replace(F.trim(heading), r"[.:\n]+$", ""), 1, 120)
    named = kept.withColumn("section", section).withColumn("article_number", F.nullif(F.regexp_extract("section", NUMBER, 1), F.lit("")))
    named = named.withColumn("path", F.nullif(F.concat_ws(" > ", F.array_join("state", " > "), "section"), F.lit(""))).withColumn("path", F.regexp_replace("path", "^ > ", ""))
    long = F.length("content") > chunk_size * 4
    short = named.where(~long).select("id", "block", F.lit(1).alias("part"), "section", "article_number", "path", "content")
    key = F.struct("id", "block")
    parts = divide(named.where(long).select(key.alias("id"), F.col("content").alias("body")), int(chunk_size * 4 / 3.6), 0).select(F.col("id.id").alias("id"), F.col("id.block").alias("block"), "part", F.col("content").alias("piece"))
    divided = named.where(long).drop("part").join(parts, ["id", "block"]).select("id", "block", "part", F.when(F.col("section").isNotNull(), F.concat("section", F.lit(" (parte "), F.col("part").cast("string"), F.lit(")"))).alias("section"), "article_number", "path", F.col("piece").alias("content"))
    return short.unionByName(divided).withColumn("tokens", estimate_tokens_floor4(F.col("content")))
