"""Citations: sources of answers, excerpts, and what they can be held to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

LINK = r"\[([^\]]+)\]\((https?://[^\s\)]+)\)"
RAW = r"(https?://[^\s\)\],<]+)"
RULING = r"(?i)\b(Sentencia\s+(?:C|SU|T|SL|SC|SP|STC|STL)-[0-9]{2,4}\s*(?:/|\s*de\s*)[0-9]{2,4})\b"


def mine_sources(messages: DataFrame, most: int = 6, most_rulings: int = 4) -> DataFrame:
    """message_id, n, title, key, domain, class: Markdown links, then raw addresses; rulings where there is neither.

    The first mention of a lower-cased key counts.
    """
    t = F.col("text")
    links = F.arrays_zip(F.regexp_extract_all(t, F.lit(LINK), 1).alias("title"), F.regexp_extract_all(t, F.lit(LINK), 2).alias("url"))
    one = lambda kind, title, url: F.struct(F.lit(kind).alias("kind"), title.alias("title"), url.alias("url"))
    none = F.lit(None).cast("string")
    urls = F.concat(F.transform(links, lambda x: one(0, x.title, x.url)), F.transform(F.regexp_extract_all(t, F.lit(RAW), 1), lambda x: one(1, none, x)))
    rulings = F.transform(F.regexp_extract_all(t, F.lit(RULING), 1), lambda x: one(2, x, none))
    rows = messages.select("message_id", F.posexplode(F.when(F.size(urls) > 0, urls).otherwise(rulings)).alias("pos", "s")).select("message_id", "pos", "s.*")
    keyed = rows.withColumn("key", F.lower(F.coalesce("url", "title")))
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("message_id", "key").orderBy("pos"))).where("rn = 1")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("message_id").orderBy("pos"))).where(F.col("n") <= F.when(F.col("kind") == 2, most_rulings).otherwise(most))
    domain = F.when(F.col("kind") == 2, F.lit("corteconstitucional.gov.co")).otherwise(T.domain(F.col("url")))
    named = ((F.col("kind") == 0) & (F.length(F.trim("title")) > 5)) | (F.col("kind") == 2)
    court = (F.col("kind") == 2) | ((F.col("kind") == 0) & domain.rlike("corte|suin|ramajudicial"))
    return ranked.select("message_id", "n", F.when(named, F.trim("title")).otherwise(domain).alias("title"), "key", domain.alias("domain"), F.when(court, "court").otherwise("web").alias("class"))


def emit_citations(context: DataFrame) -> DataFrame:
    """One row for each context chunk, in order, with what it showed then."""
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return context.select("query_id", position.alias("position"), "chunk_id", "document_id", T.excerpt(F.col("content")).alias("excerpt"), F.coalesce("rerank_score", "fusion_score").alias("relevance_score"))


def verify_citations(quotes: DataFrame, context: DataFrame) -> DataFrame:
    """quotes (message_id, n, quote) against context (message_id, n, content)."""
    j = quotes.join(context, ["message_id", "n"], "left")
    verdict = F.when(F.col("content").isNull(), "NOT_IN_CONTEXT").when(F.col("content").contains(F.col("quote")), "VERIFIED").otherwise("EXCERPT_MISMATCH")
    return j.select("message_id", "n", verdict.alias("verdict"))


def verdict_rollup(verdicts: DataFrame, *by: str) -> DataFrame:
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("verification_status") == "SUPPORTED").alias("supported"), F.round(F.avg((F.col("verification_status") == "SUPPORTED").cast("int")), 6).alias("rate"))


def answer_support(answers: DataFrame, context: DataFrame, full: float = 0.8, part: float = 0.3, covered: float = 0.5) -> DataFrame:
    """(message_id, status): the share of an answer's sentences whose words its context covers."""
    held = context.groupBy("message_id").agg(F.array_distinct(F.flatten(F.collect_list(T.rank_terms(F.col("content"))))).alias("held"), F.lit(1).alias("has"))
    sentences = F.filter(F.transform(F.split(T.composed(F.col("answer")), r"[.!?]\s+"), lambda x: F.array_distinct(T.rank_terms_of(x))), lambda words: F.size(words) > 0)
    supported = F.size(F.filter("words", lambda words: F.size(F.array_intersect(words, F.col("held"))) >= covered * F.size(words)))
    j = answers.join(held, "message_id", "left").withColumn("words", sentences).withColumn("rate", F.try_divide(F.when(F.col("has").isNotNull(), supported), F.size("words")))
    status = F.when(F.trim("answer") == "", "NOT_VERIFIED").when(F.col("has").isNull(), "INSUFFICIENT_EVIDENCE").when(F.col("rate") >= full, "SUPPORTED").when(F.col("rate") >= part, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return j.select("message_id", status.alias("status"))


def parse_verdict(text: Column) -> Column:
    """The verdict that a checker's answer names, whole words, the negative one first."""
    t = F.upper(text)
    return F.when(t.rlike(r"\bUNSUPPORTED\b"), "UNSUPPORTED").when(t.rlike(r"\bPARTIALLY[_ ]SUPPORTED\b"), "PARTIALLY_SUPPORTED").when(t.rlike(r"\bSUPPORTED\b"), "SUPPORTED").otherwise("NOT_VERIFIED")


def stale_citations(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """Citations whose frozen status is no longer that of the document."""
    return citations.join(docs.select("document_id", F.col("status").alias("status_now")), "document_id").where("status <> status_now").select("message_id", "document_id", "position", "status", "status_now")


def citing_answers(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """Answers that cite a document that is repealed by now."""
    repealed = docs.where("status in ('DEROGADO', 'INEXEQUIBLE')").select("document_id")
    return citations.join(repealed, "document_id", "left_semi").select("message_id", "document_id", "position")


def grounded_answer(context: DataFrame, queries: DataFrame, limit: int = 160) -> DataFrame:
    """Extractive answers: the start of each source to a word's end, quoted with its number; a refusal without sources."""
    head = F.substring("content", 1, limit)
    cut = F.when(F.length("content") <= limit, F.col("content")).when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    rows = context.select("query_id", "n", F.concat(F.lit('"'), cut, F.lit('" ['), F.col("n"), F.lit("]")).alias("part"))
    parts = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x.part), "\n").alias("answer"))
    return queries.select("query_id").join(parts, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("No hay evidencia suficiente.")).alias("answer"))


def render_block(number, section, chunk_index, title, source, published, status, content):
    """A numbered source block with its date, its force and a caveat where it is not in force."""
    caveat = F.when(status == "DESCONOCIDO", " (no verificada: no debe presentarse como vigente)").when(status != "VIGENTE", " (ADVERTENCIA: no es norma plenamente vigente)").otherwise("")
    place = F.coalesce(F.nullif(section, F.lit("")), F.concat(F.lit("Fragmento "), (chunk_index + 1).cast("string")))
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "), place, F.lit(" — "), title, F.lit(" ("), source, F.lit(")"))
    return F.concat_ws("\n", head, F.concat(F.lit("Fecha de publicación: "), published.cast("string")), F.concat(F.lit("Vigencia: "), status, caveat), F.lit(""), content)
