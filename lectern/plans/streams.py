"""The streaming jobs over whole tables, run to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.sources.files import scan_corpus, scan_text, size_guard, write_corpus
from lectern.sources.tables import load, workspace
from lectern.streaming import jobs as S

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def events(spark, sf_dir):
    return S.read_events(spark, f"{sf_dir}/events.parquet")


@query("s2_rate_stream", "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def s2(spark, sf_dir):
    return S.run_append(S.rate_stream(events(spark, sf_dir), "1 hour", 1), workspace(spark, "rate"))


@query("s3_quota_stream", "SELECT user_id, date_trunc('month', ts)::timestamp AS month, sum(floor(abs(value))::bigint) AS tokens, count(*) AS requests FROM events GROUP BY 1, 2")
def s3(spark, sf_dir):
    return S.run_latest(S.quota_stream(events(spark, sf_dir), F.floor(F.abs("value")).cast("long")), workspace(spark, "quota"), "user_id", "month").drop("closed")


@query("s4_dedup_stream", "SELECT event_id FROM events")
def s4(spark, sf_dir):
    """Every fifth event comes twice."""
    e = events(spark, sf_dir)
    twice = e.select("ts", F.explode(F.when(F.col("event_id") % 5 == 0, F.array("event_id", "event_id")).otherwise(F.array("event_id"))).alias("event_id"))
    return S.run_append(S.dedup_stream(twice, "event_id").select("event_id"), workspace(spark, "dedup"))


@query("s5_join_stream", "SELECT event_id AS request_id, (event_id % 20)::int AS minutes FROM events WHERE event_id % 2 = 0 AND event_id % 20 <= 10")
def s5(spark, sf_dir):
    usage = events(spark, sf_dir).select(F.col("event_id").alias("request_id"), "ts")
    messages = events(spark, sf_dir).where("event_id % 2 = 0").select(F.col("event_id").alias("request_id"), (F.col("ts") + F.make_interval(mins=F.col("event_id") % 20)).alias("sent_at"))
    joined = S.join_usage_messages(usage, messages)
    return S.run_append(joined.select("request_id", ((F.unix_micros("sent_at") - F.unix_micros("ts")) / 60_000_000).cast("int").alias("minutes")), workspace(spark, "join"))


@query("s6_token_stream", "SELECT user_id AS job, count(*) AS n_tokens, bool_or(event_type = 'error') AS finished FROM events GROUP BY 1")
def s6(spark, sf_dir):
    tokens = events(spark, sf_dir).select(F.col("user_id").alias("job"), "ts", F.col("event_type").alias("token"), (F.col("event_type") == "error").alias("last"))
    return S.run_latest(S.accumulate_tokens(tokens), workspace(spark, "tokens"), "job")


#: The guard of the written texts; a small one, so that small tables have several parts too.
GUARD = 1 << 19


def texts(spark, sf_dir):
    """All documents under header blocks, in texts by source and part, in the shared folder."""
    d = load(spark, sf_dir, "documents")
    folder = workspace(spark, "corpus")
    write_corpus(d.select(F.col("source").alias("slug"), F.col("doc_id").alias("document_id"), F.concat(F.lit("Norma "), "source").alias("name"), F.col("doc_id").cast("string").alias("number"), F.lit("X").alias("issuer"), F.lit("VIGENTE").alias("status"), F.lit("http://x").alias("url"), "text"), folder, GUARD)
    return folder


def name_of(path):
    """slug-part of a written text."""
    return F.regexp_replace(F.regexp_extract(path, "slug=(.+)/part=[0-9]+/", 1), "$", F.concat(F.lit("-"), F.regexp_extract(path, "/part=([0-9]+)/", 1)))


_HEAD = "upper('Norma ' || source) || chr(10) || repeat('=', 80) || chr(10) || chr(10) || 'Identificador Oficial: ' || doc_id || chr(10) || 'Emisor: X' || chr(10) || 'Estado de Vigencia: VIGENTE' || chr(10) || 'Fuente Oficial: http://x' || chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) || text || chr(10)"
_FILES = f"b AS (SELECT source, doc_id, {_HEAD} AS v FROM documents), starts AS (SELECT *, sum(strlen(v)) OVER (PARTITION BY source ORDER BY doc_id) - strlen(v) AS start FROM b), p AS (SELECT source || '-' || (start // {GUARD // 2})::bigint AS slug, string_agg(v, '' ORDER BY doc_id) AS t, count(*) AS n FROM starts GROUP BY 1)"


@query("a1_scan_text", f"WITH {_FILES} SELECT slug, 'utf-8' AS encoding, sha256(t) AS content_hash, length(t) AS chars FROM p")
def a1(spark, sf_dir):
    """Every document, written by the sink and scanned again."""
    found, _ = scan_text(spark, texts(spark, sf_dir))
    return found.select(name_of(F.col("path")).alias("slug"), "encoding", "content_hash", F.length("text").alias("chars"))


@query("a2_scan_corpus", f"WITH {_FILES} SELECT slug, strlen(t) AS size, NULL::varchar AS reason FROM p")
def a2(spark, sf_dir):
    """The written folder holds the texts of all slugs, and nothing that is skipped."""
    kept, skipped = scan_corpus(spark, texts(spark, sf_dir))
    slug = name_of(F.col("path")).alias("slug")
    return kept.select(slug, "size", F.lit(None).cast("string").alias("reason")).unionAll(skipped.select(slug, "size", "reason"))


@query("a3_size_guard", "SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 4000 THEN 'too large' END AS reason FROM documents")
def a3(spark, sf_dir):
    """The guard at 4000 bytes."""
    return load(spark, sf_dir, "documents").select("doc_id", size_guard(F.octet_length("text"), 4000).alias("reason"))


@query("a13_write_corpus", f"WITH {_FILES} SELECT regexp_replace(slug, '-[0-9]+$', '') AS slug, count(*) AS files, sum(strlen(t))::bigint AS bytes, max(strlen(t)) <= greatest({GUARD}, {GUARD // 2} + 200000) AS guarded, sum(n)::bigint AS documents, sum(len(string_split(t, chr(10))) - 1)::bigint AS lines FROM p GROUP BY 1")
def a13(spark, sf_dir):
    """Files, bytes, header blocks and lines of each slug, and whether its files keep to the guard, for documents of up to 200,000 bytes."""
    folder = texts(spark, sf_dir)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", "slug=(.+)/part=", 1).alias("slug"), "length")
    files = files.groupBy("slug").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), (F.max("length") <= max(GUARD, GUARD // 2 + 200_000)).alias("guarded"))
    lines = spark.read.text(folder).groupBy("slug").agg(F.count_if(F.col("value").startswith("Identificador Oficial: ")).alias("documents"), F.count("*").alias("lines"))
    return files.join(lines, "slug")


@query("s1_ingest_stream", f"WITH {_FILES}, c AS (SELECT slug, sha256(t) AS content_hash, row_number() OVER (PARTITION BY sha256(t) ORDER BY slug) AS nth FROM p) SELECT slug, content_hash, CASE WHEN nth = 1 THEN 'NEW' ELSE 'UNCHANGED' END AS action FROM c UNION ALL SELECT slug || '_again', content_hash, 'UNCHANGED' FROM c")
def s1(spark, sf_dir):
    """The written texts, ingested; then the same bytes again under other names, by a second run that goes on from the first one's state."""
    folder, state = workspace(spark, "incoming"), workspace(spark, "ingest")
    d = spark.read.text(texts(spark, sf_dir), wholetext=True)
    d = d.withColumn("slug", F.concat_ws("-", "slug", "part"))
    d.select("slug", F.regexp_replace("value", "\n$", "").alias("value")).write.partitionBy("slug").text(f"{folder}/a")
    S.ingest_stream(spark, f"{folder}/*", f"{state}/rows", f"{state}/state")
    d.select(F.concat("slug", F.lit("_again")).alias("slug"), F.regexp_replace("value", "\n$", "").alias("value")).write.partitionBy("slug").text(f"{folder}/b")
    S.ingest_stream(spark, f"{folder}/*", f"{state}/rows", f"{state}/state")
    return spark.read.parquet(f"{state}/rows/rows").select(F.regexp_extract("path", "slug=([^/]+)", 1).alias("slug"), "content_hash", "action")
