"""Corpus maintenance, citations and quality checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import citations, corpus, quality
from lectern.sources.tables import load, stored, workspace

from . import search
from .views import STATUSES, TYPES, cte, view

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def hashed(spark, sf_dir):
    return view(spark, sf_dir, "corpus").withColumn("content_hash", F.sha2("text", 256)).drop("text")


_HASHED = cte("corpus") + ", h AS (SELECT * EXCLUDE (text), sha256(text) AS content_hash FROM corpus)"


def pieces(spark, sf_dir):
    return view(spark, sf_dir, "pieces")


def cited(spark, sf_dir):
    return view(spark, sf_dir, "cited")


@query("a4_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def a4(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("a14_table_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 5000")
def a14(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("n_chars > 5000").select("doc_id", "lang", "n_chars")


@query("a8_density_gate", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page FROM documents) SELECT doc_id, count(*) AS pages, round(avg(length(trim(page))), 6) AS density, CASE WHEN avg(length(trim(page))) < 50 THEN 'scan' END AS reason FROM p GROUP BY 1")
def a8(spark, sf_dir):
    """Lines stand for pages."""
    p = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("page"))
    g = p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.avg(F.length(F.trim("page"))).alias("d"))
    return g.select("doc_id", "pages", F.round("d", 6).alias("density"), F.when(F.col("d") < 50, "scan").alias("reason"))


NORMS = tuple((f"N{i}", f"Norma curada {i}", ("civil", "penal", "laboral")[i % 3]) for i in range(15))
_NORMS = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in NORMS) + ") n(norm_id, title, category)"


@query("a12_catalog", f"SELECT d.norm_id, coalesce(title, 'Norma ' || d.norm_id) AS title, coalesce(category, 'general') AS category FROM (SELECT DISTINCT 'N' || doc_id % 40 AS norm_id FROM documents) d LEFT JOIN {_NORMS} ON d.norm_id = n.norm_id")
def a12(spark, sf_dir):
    ids = load(spark, sf_dir, "documents").select(F.concat(F.lit("N"), F.col("doc_id") % 40).alias("norm_id")).distinct()
    return corpus.catalog(spark.createDataFrame(NORMS, "norm_id string, title string, category string"), ids)


@query("b15_title_choice", cte("corpus") + " SELECT document_id, substr(coalesce(nullif(trim(CASE WHEN document_id % 3 = 0 THEN title END), ''), nullif(trim(CASE WHEN document_id % 3 = 1 THEN '  ' ELSE external_id END), ''), 'doc-' || document_id), 1, 1000) AS title, CASE WHEN document_id % 3 = 0 THEN 'derived' WHEN document_id % 3 = 2 AND external_id IS NOT NULL THEN 'loader' ELSE 'fallback' END AS origin FROM corpus")
def b15(spark, sf_dir):
    c = view(spark, sf_dir, "corpus")
    derived = F.nullif(F.trim(F.when(F.col("document_id") % 3 == 0, F.col("title"))), F.lit(""))
    loader = F.nullif(F.trim(F.when(F.col("document_id") % 3 == 1, F.lit("  ")).otherwise(F.col("external_id"))), F.lit(""))
    title = F.substring(F.coalesce(derived, loader, F.concat(F.lit("doc-"), "document_id")), 1, 1000)
    return c.select("document_id", title.alias("title"), F.when(derived.isNotNull(), "derived").when(loader.isNotNull(), "loader").otherwise("fallback").alias("origin"))


INCOMING = "SELECT document_id + 1000000 AS document_id, source_name, external_id, CASE WHEN document_id % 4 = 0 THEN content_hash ELSE content_hash || 'x' END AS content_hash FROM {} WHERE document_id % 3 = 0"
_UNIQUE = ", now AS (SELECT source_name, external_id, min(document_id) AS document_id FROM h WHERE external_id IS NOT NULL GROUP BY ALL), current AS (SELECT h.* FROM h JOIN now USING (document_id))"


def current(spark, sf_dir):
    h = hashed(spark, sf_dir)
    now = h.where("external_id is not null").groupBy("source_name", "external_id").agg(F.min("document_id").alias("document_id"))
    return h.join(now.select("document_id"), "document_id", "left_semi")


def incoming(spark, sf_dir):
    return spark.sql(INCOMING.format("{h}"), h=hashed(spark, sf_dir))


@query("f1_plan_ingest", _HASHED.replace(cte("corpus"), cte("corpus", "cited")) + _UNIQUE + f", i AS ({INCOMING.format('h')}), r AS (SELECT document_id, count(*) AS n FROM cited GROUP BY 1) SELECT i.document_id, c.document_id AS current_id, CASE WHEN c.document_id IS NULL THEN 'NEW' WHEN i.content_hash = c.content_hash AND c.embedding_model = 'hash/words-64' THEN 'UNCHANGED' WHEN r.n > 0 THEN 'REFUSED_CITED' ELSE 'REPLACE' END AS action FROM i LEFT JOIN current c ON i.source_name = c.source_name AND i.external_id = c.external_id LEFT JOIN r ON r.document_id = c.document_id")
def f1(spark, sf_dir):
    return corpus.plan_ingest(incoming(spark, sf_dir), current(spark, sf_dir), cited(spark, sf_dir)).select("document_id", "current_id", "action")


@query("f2_derive_status", cte("corpus", "relations") + """, k AS (SELECT target_id AS document_id, CASE WHEN relation_type IN ('DEROGA', 'DECLARA_INEXEQUIBLE') AND affected_section IS NOT NULL THEN 'PARCIALMENTE_DEROGADO' WHEN relation_type = 'DEROGA' THEN 'DEROGADO' WHEN relation_type = 'DECLARA_INEXEQUIBLE' THEN 'INEXEQUIBLE' WHEN relation_type = 'MODIFICA' THEN 'MODIFICADO' END AS d FROM relations WHERE effective_date IS NULL OR effective_date <= DATE '2015-06-30'),
b AS (SELECT document_id, arg_max(d, CASE d WHEN 'DEROGADO' THEN 4 WHEN 'INEXEQUIBLE' THEN 3 WHEN 'PARCIALMENTE_DEROGADO' THEN 2 ELSE 1 END) AS d FROM k WHERE d IS NOT NULL GROUP BY 1)
SELECT c.document_id, coalesce(d, CASE WHEN status = 'DESCONOCIDO' THEN status ELSE 'VIGENTE' END) AS status FROM corpus c LEFT JOIN b USING (document_id)""")
def f2(spark, sf_dir):
    return corpus.derive_status(view(spark, sf_dir, "corpus"), view(spark, sf_dir, "relations"), "2015-06-30")


def merged(spark, current, incoming, combine):
    """The current rows stored in buckets, and these after a merge of the incoming ones."""
    store = corpus.BucketStore(spark, workspace(spark, "store"))
    store.write(current)
    store.merge(incoming, combine)
    return store.read()


@query("f3_upsert_documents", cte("corpus") + """ SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'Nuevo ' || title ELSE title END AS title, CASE WHEN document_id % 8 = 0 THEN 'MODIFICADO' ELSE status END AS status, CASE WHEN document_id % 12 = 0 THEN 'http://nuevo.example/' ELSE source_url END AS source_url FROM corpus
UNION ALL SELECT document_id + 5000000, 'Nuevo ' || title, CASE WHEN document_id % 8 = 0 THEN 'MODIFICADO' ELSE 'DESCONOCIDO' END, CASE WHEN document_id % 12 = 0 THEN 'http://nuevo.example/' END FROM corpus WHERE document_id % 4 = 0""")
def f3(spark, sf_dir):
    c = view(spark, sf_dir, "corpus").select("document_id", "title", "status", "source_url")
    new = c.where("document_id % 4 = 0").selectExpr("explode(array(document_id, document_id + 5000000)) as document_id", "'Nuevo ' || title as title", "case when document_id % 8 = 0 then 'MODIFICADO' else 'DESCONOCIDO' end as status", "case when document_id % 12 = 0 then 'http://nuevo.example/' else '' end as source_url")
    return merged(spark, c, new, corpus.upsert_documents)


@query("f4_replace_chunks", cte("pieces") + " SELECT document_id, chunk_index, content FROM pieces WHERE document_id % 3 > 0 OR document_id NOT IN (SELECT document_id FROM pieces WHERE document_id % 3 = 0 AND chunk_index = 0) UNION ALL SELECT document_id, chunk_index, content || ' (v2)' FROM pieces WHERE document_id % 3 = 0 AND chunk_index = 0")
def f4(spark, sf_dir):
    p = pieces(spark, sf_dir).select("document_id", "chunk_index", "content")
    new = p.where("document_id % 3 = 0 and chunk_index = 0").withColumn("content", F.concat("content", F.lit(" (v2)")))
    return merged(spark, p, new, corpus.replace_chunks)


@query("f5_find_duplicates", _HASHED + f", i AS ({INCOMING.format('h')}), a AS (SELECT source_name, external_id, min(document_id) AS x FROM h WHERE external_id IS NOT NULL GROUP BY ALL), b AS (SELECT content_hash, min(document_id) AS y FROM h GROUP BY 1) SELECT document_id, coalesce(x, y) AS existing_id, CASE WHEN x IS NOT NULL THEN 'external_id' ELSE 'content_hash' END AS reason FROM i LEFT JOIN a ON i.source_name = a.source_name AND i.external_id = a.external_id LEFT JOIN b ON i.content_hash = b.content_hash WHERE x IS NOT NULL OR y IS NOT NULL")
def f5(spark, sf_dir):
    return corpus.find_duplicates(incoming(spark, sf_dir), hashed(spark, sf_dir))


@query("f6_dedup_hash", "SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def f6(spark, sf_dir):
    return corpus.dedup_hash(hashed(spark, sf_dir))


@query("f7_delete_documents", cte("pieces", "cited") + " SELECT document_id, count(*) AS chunks FROM pieces WHERE document_id % 5 > 0 OR document_id IN (SELECT document_id FROM cited) GROUP BY 1")
def f7(spark, sf_dir):
    docs, chunks = view(spark, sf_dir, "corpus"), pieces(spark, sf_dir)
    ids = docs.where("document_id % 5 = 0").select("document_id")
    return corpus.delete_documents(docs, chunks, cited(spark, sf_dir), ids)[1].groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("f7_delete_refused", cte("corpus", "cited") + " SELECT document_id FROM corpus WHERE document_id % 5 = 0 AND document_id IN (SELECT document_id FROM cited)")
def f7_refused(spark, sf_dir):
    docs = view(spark, sf_dir, "corpus")
    return corpus.delete_documents(docs, pieces(spark, sf_dir), cited(spark, sf_dir), docs.where("document_id % 5 = 0").select("document_id"))[2]


@query("f8_stale_vectors", cte("corpus") + " SELECT document_id, embedding_model FROM corpus WHERE embedding_model IS DISTINCT FROM 'hash/words-64'")
def f8(spark, sf_dir):
    return corpus.stale_vectors(view(spark, sf_dir, "corpus"))


@query("f9_ingest_report", cte("corpus", "pieces") + ", p AS (SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'UNCHANGED' WHEN 2 THEN 'REPLACE' ELSE 'REFUSED_CITED' END AS action FROM corpus) SELECT count(*) AS processed, count_if(action IN ('NEW', 'REPLACE')) AS stored, count_if(action = 'UNCHANGED') AS skipped, count_if(action = 'REFUSED_CITED') AS failed, (SELECT count(*) FROM pieces WHERE document_id % 2 = 0) AS chunks, (SELECT count_if(length(content) > 200) FROM pieces WHERE document_id % 2 = 0) AS long_chunks, true AS exit_failed FROM p")
def f9(spark, sf_dir):
    plan = view(spark, sf_dir, "corpus").selectExpr("document_id", "CASE document_id % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'UNCHANGED' WHEN 2 THEN 'REPLACE' ELSE 'REFUSED_CITED' END AS action")
    return corpus.ingest_report(plan, pieces(spark, sf_dir))


@query("f9_ingest_failures", "SELECT doc_id AS document_id, 'cited chunks would be destroyed' AS detail FROM documents WHERE doc_id % 4 = 3")
def f9_failures(spark, sf_dir):
    plan = view(spark, sf_dir, "corpus").selectExpr("document_id", "CASE document_id % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'UNCHANGED' WHEN 2 THEN 'REPLACE' ELSE 'REFUSED_CITED' END AS action")
    return corpus.ingest_failures(plan)


@query("f10_list_documents", cte("corpus", "pieces") + " SELECT c.document_id, title, document_type, status, publication_date, count(p.document_id) AS chunks FROM corpus c LEFT JOIN pieces p ON p.document_id = c.document_id GROUP BY ALL")
def f10(spark, sf_dir):
    return corpus.list_documents(view(spark, sf_dir, "corpus"), pieces(spark, sf_dir))


@query("f11_alignment_check", cte("corpus", "pieces") + " SELECT c.document_id, count(chunk_id) AS chunks, count(CASE WHEN chunk_id % 13 > 0 THEN 1 END) AS vectors FROM corpus c LEFT JOIN pieces p ON p.document_id = c.document_id AND p.document_id % 7 > 0 GROUP BY 1 HAVING count(chunk_id) = 0 OR count(chunk_id) <> count(CASE WHEN chunk_id % 13 > 0 THEN 1 END)")
def f11(spark, sf_dir):
    chunks = pieces(spark, sf_dir).where("document_id % 7 > 0").withColumn("vector", F.when(F.col("chunk_id") % 13 > 0, F.lit(1)))
    return corpus.alignment_check(view(spark, sf_dir, "corpus"), chunks)


# ---- citations ------------------------------------------------------------------

#: The exact excerpt by Python's rules, in SQL.
_HEAD = "trim(substr(content, 1, 300), ' ' || chr(9) || chr(10) || chr(13))"
_LAST = f"length({_HEAD}) - instr(reverse({_HEAD}), ' .') - 1"
_EXCERPT = f"CASE WHEN length(content) <= 300 THEN trim(content, ' ' || chr(9) || chr(10) || chr(13)) WHEN contains({_HEAD}, '. ') THEN CASE WHEN {_LAST} > 150 THEN substr({_HEAD}, 1, ({_LAST} + 1)::int) ELSE {_HEAD} END ELSE {_HEAD} || '...' END"


@query("e1_emit_citations", search.ALL + f" SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position, chunk_id, document_id, {_EXCERPT} AS excerpt, round(coalesce(rerank_score, fusion_score), 9) AS relevance_score FROM fused JOIN pieces USING (chunk_id) LEFT JOIN reranked USING (query_id, chunk_id)")
def e1(spark, sf_dir):
    """The fused results as citations; those that were reranked carry that score."""
    f = stored(search.fused(spark, sf_dir), "fused")
    r = search.reranked(spark, sf_dir, f).select("query_id", "chunk_id", "rerank_score")
    c = f.join(pieces(spark, sf_dir).select("chunk_id", "document_id", "content"), "chunk_id").join(r, ["query_id", "chunk_id"], "left")
    return citations.emit_citations(c).withColumn("relevance_score", F.round("relevance_score", 9))


@query("e2_excerpt", f"SELECT doc_id, {_EXCERPT.replace('content', 'text')} AS excerpt FROM documents")
def e2(spark, sf_dir):
    from lectern.functions.text import excerpt

    return load(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))


@query("e3_score_choice", cte("cited") + " SELECT message_id, CASE WHEN message_id % 3 = 0 THEN 0.1 ELSE message_id % 10 / 10.0 END::double AS score FROM cited")
def e3(spark, sf_dir):
    return cited(spark, sf_dir).selectExpr("message_id", "coalesce(case when message_id % 3 = 0 then null else (message_id % 10) / 10.0d end, 0.1d) as score")


QUOTES = "SELECT message_id, CAST(message_id % 3 + 1 AS INT) AS n, CASE WHEN message_id % 3 = 1 THEN 'zz ' || substr(answer, 5, 30) ELSE substr(answer, 5, 30) END AS quote FROM {}"


@query("e4_verify_citations", cte("cited") + " SELECT message_id, CAST(message_id % 3 + 1 AS INT) AS n, CASE message_id % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'EXCERPT_MISMATCH' ELSE 'NOT_IN_CONTEXT' END AS verdict FROM cited")
def e4(spark, sf_dir):
    """Contexts hold two blocks, so that quotes from a third are out of range; the expected verdict comes from the ids."""
    a = cited(spark, sf_dir)
    context = a.select("message_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.col("answer").alias("content"))
    return citations.verify_citations(spark.sql(QUOTES.format("{a}"), a=a), context)


@query("e5_verdict_rollup", cte("usage") + " SELECT model, created_at::date AS day, count(*) AS n, count_if(verification_status = 'SUPPORTED') AS supported, round(avg((verification_status = 'SUPPORTED')::int), 6) AS rate FROM usage GROUP BY 1, 2")
def e5(spark, sf_dir):
    return citations.verdict_rollup(view(spark, sf_dir, "usage").withColumn("day", F.to_date("created_at")), "model", "day")


_TERMS = "list_filter(regexp_extract_all(translate(lower({}), 'áéíóúüñ', 'aeiouun'), '[\\pL\\pN_\\pM]+'), lambda t: length(t) > 1 AND t NOT IN ({}))"


def _terms(x):
    from lectern.functions.text import STOP_WORDS

    return _TERMS.format(x, ", ".join(f"'{w}'" for w in STOP_WORDS))


@query("e6_answer_support", cte("cited") + f""", ctx AS (SELECT message_id, substr(answer, 1, CAST(length(answer) * (message_id % 5) // 4 AS BIGINT)) AS content FROM cited WHERE message_id % 5 > 0),
s AS (SELECT message_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS sentence FROM (SELECT message_id, regexp_split_to_array(answer, '[.!?]\\s+') AS parts FROM cited)),
t AS (SELECT message_id, i, unnest(list_distinct({_terms('sentence')})) AS term FROM s), c AS (SELECT DISTINCT message_id, unnest({_terms('content')}) AS term FROM ctx),
per AS (SELECT t.message_id, i, count(c.term) / count(*)::double AS share FROM t LEFT JOIN c ON t.message_id = c.message_id AND t.term = c.term GROUP BY 1, 2),
r AS (SELECT message_id, avg((share >= 0.5)::int) AS rate FROM per GROUP BY 1)
SELECT message_id, CASE WHEN trim(answer) = '' THEN 'NOT_VERIFIED' WHEN x.message_id IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN rate >= 0.8 THEN 'SUPPORTED' WHEN rate >= 0.3 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM cited LEFT JOIN r USING (message_id) LEFT JOIN (SELECT DISTINCT message_id FROM ctx) x USING (message_id)""")
def e6(spark, sf_dir):
    a = cited(spark, sf_dir).select("message_id", "answer")
    context = a.where("message_id % 5 > 0").selectExpr("message_id", "substr(answer, 1, int(length(answer) * (message_id % 5) div 4)) as content")
    return citations.answer_support(a, context)


@query("e7_parse_verdict", cte("cited") + " SELECT message_id, CASE message_id % 4 WHEN 0 THEN 'UNSUPPORTED' WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_VERIFIED' END AS verdict FROM cited")
def e7(spark, sf_dir):
    said = F.expr("case message_id % 4 when 0 then 'Verdict: unsupported.' when 1 then 'It is Supported' when 2 then 'PARTIALLY SUPPORTED by [1]' else 'unclear' end")
    return cited(spark, sf_dir).select("message_id", citations.parse_verdict(said).alias("verdict"))


FROZEN = "SELECT message_id, document_id, position, CASE WHEN message_id % 2 = 0 THEN 'VIGENTE' ELSE 'DEROGADO' END AS status FROM {}"


@query("e8_stale_citations", cte("corpus", "cited") + f" SELECT z.message_id, z.document_id, position, z.status, c.status AS status_now FROM ({FROZEN.format('cited')}) z JOIN corpus c USING (document_id) WHERE z.status <> c.status")
def e8(spark, sf_dir):
    return citations.stale_citations(spark.sql(FROZEN.format("{c}"), c=cited(spark, sf_dir)), view(spark, sf_dir, "corpus"))


@query("e9_citing_answers", cte("corpus", "cited") + " SELECT message_id, document_id, position FROM cited WHERE document_id IN (SELECT document_id FROM corpus WHERE status IN ('DEROGADO', 'INEXEQUIBLE'))")
def e9(spark, sf_dir):
    return citations.citing_answers(cited(spark, sf_dir), view(spark, sf_dir, "corpus"))


@query("e10_grounded_answer", search.ALL + """, p AS (SELECT query_id, rerank_rank AS n, '"' || CASE WHEN length(content) <= 160 THEN content WHEN instr(substr(content, 1, 160), ' ') > 0 THEN substr(content, 1, 160 - instr(reverse(substr(content, 1, 160)), ' ')) ELSE substr(content, 1, 160) END || '" [' || rerank_rank || ']' AS part FROM reranked JOIN pieces USING (chunk_id))
SELECT a.query_id, coalesce(string_agg(part, chr(10) ORDER BY n), 'No hay evidencia suficiente.') AS answer FROM asked a LEFT JOIN p USING (query_id) GROUP BY 1""")
def e10(spark, sf_dir):
    """Answers from the reranked results."""
    context = search.reranked(spark, sf_dir).join(pieces(spark, sf_dir), "chunk_id").select("query_id", F.col("rerank_rank").alias("n"), "content")
    return citations.grounded_answer(context, search.asked(spark, sf_dir).select("query_id"))


@query("b30_render_block", cte("corpus") + """ SELECT document_id, '[' || (document_id % 9 + 1) || '] ' || CASE WHEN document_id % 4 = 0 THEN 'Fragmento ' || (document_id % 6 + 1) ELSE 'Artículo ' || document_id % 50 END || ' — ' || title || ' (' || source_name || ')' || chr(10) || coalesce('Fecha de publicación: ' || publication_date || chr(10), '') || 'Vigencia: ' || status || CASE WHEN status = 'DESCONOCIDO' THEN ' (no verificada: no debe presentarse como vigente)' WHEN status <> 'VIGENTE' THEN ' (ADVERTENCIA: no es norma plenamente vigente)' ELSE '' END || chr(10) || chr(10) || text AS block FROM corpus""")
def b30(spark, sf_dir):
    section = F.expr("case when document_id % 4 = 0 then '' else 'Artículo ' || cast(document_id % 50 as string) end")
    block = citations.render_block(F.col("document_id") % 9 + 1, section, F.col("document_id") % 6, F.col("title"), F.col("source_name"), F.col("publication_date"), F.col("status"), F.col("text"))
    return view(spark, sf_dir, "corpus").select("document_id", block.alias("block"))


# ---- quality --------------------------------------------------------------------

BROKEN = "SELECT *, CASE WHEN document_id % 50 = 1 THEN 'WRONG' ELSE document_type END AS kind, CASE WHEN document_id % 60 = 2 THEN -1 ELSE n_chars END AS tokens, document_id % 70 AS first, CASE WHEN document_id % 80 = 3 THEN 0 ELSE document_id % 70 + 5 END AS last FROM {}"


def broken(spark, sf_dir):
    return spark.sql(BROKEN.format("{c}"), c=view(spark, sf_dir, "corpus"))


@query("i1_allowed_values", cte("corpus") + f", b AS ({BROKEN.format('corpus')}) SELECT 'allowed:kind' AS rule, document_id::varchar AS key, kind AS detail FROM b WHERE kind NOT IN {TYPES} UNION ALL SELECT 'allowed:status', document_id::varchar, status FROM b WHERE status NOT IN {STATUSES[:4]}")
def i1(spark, sf_dir):
    return quality.allowed_values(broken(spark, sf_dir), "document_id", {"kind": TYPES, "status": STATUSES[:4]})


@query("i2_unique_keys", cte("corpus", "pieces") + " SELECT 'unique:source' AS rule, source_name || '|' || external_id AS key, count(*)::varchar AS detail FROM corpus WHERE external_id IS NOT NULL GROUP BY source_name, external_id HAVING count(*) > 1 UNION ALL SELECT 'unique:chunk', document_id || '|' || chunk_index, count(*)::varchar FROM pieces GROUP BY document_id, chunk_index HAVING count(*) > 1")
def i2(spark, sf_dir):
    return quality.union(quality.unique(view(spark, sf_dir, "corpus"), "source", "source_name", "external_id"), quality.unique(pieces(spark, sf_dir), "chunk", "document_id", "chunk_index"))


@query("i3_check_constraints", cte("corpus") + f", b AS ({BROKEN.format('corpus')}) SELECT 'check:tokens' AS rule, document_id::varchar AS key, NULL::varchar AS detail FROM b WHERE NOT tokens > 0 UNION ALL SELECT 'check:range', document_id::varchar, NULL FROM b WHERE NOT last >= first")
def i3(spark, sf_dir):
    return quality.checks(broken(spark, sf_dir), "document_id", {"tokens": "tokens > 0", "range": "last >= first"})


@query("i4_references", cte("cited", "relations") + " SELECT 'reference:citation' AS rule, message_id::varchar AS key, document_id::varchar AS detail FROM cited WHERE document_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'reference:relation', source_id::varchar, target_id::varchar FROM relations WHERE target_id NOT IN (SELECT doc_id FROM documents)")
def i4(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return quality.union(quality.orphans(cited(spark, sf_dir), "citation", "message_id", "document_id", docs, "doc_id"), quality.orphans(view(spark, sf_dir, "relations"), "relation", "source_id", "target_id", docs, "doc_id"))


CONFIGS = "SELECT event_id AS config_id, CASE WHEN event_id % 5 = 0 THEN 0.6 ELSE 0.7 END AS semantic_weight, 0.3 AS lexical_weight, CASE WHEN event_id % 7 = 0 THEN 30 ELSE 5 END AS rerank_k, 20 AS top_k, 1000 AS chunk_size, CASE WHEN event_id % 9 = 0 THEN 1000 ELSE 200 END AS chunk_overlap FROM {}"


@query("i5_config_rules", "SELECT rule, event_id::varchar AS key, NULL::varchar AS detail FROM events, (VALUES ('check:weights', 5), ('check:rerank_k', 7), ('check:overlap', 9)) r(rule, m) WHERE event_id % m = 0")
def i5(spark, sf_dir):
    return quality.config_rules(spark.sql(CONFIGS.format("{e}"), e=load(spark, sf_dir, "events")))
