"""Embedding, retrieval and evaluation over whole tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import embedding as E
from lectern.operators import evaluation as J
from lectern.operators import lexical as L
from lectern.operators import retrieval as R
from lectern.operators import vector_index as V
from lectern.operators.corpus import ACTIVE_MODEL
from lectern.sources.tables import kept, load, spread, stored, version

from . import views
from .views import cte, view

QUERIES, ORACLE = {}, {}
DIM, FLOOR = 64, 0.1


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def pieces(spark, sf_dir):
    return view(spark, sf_dir, "pieces")


def asked(spark, sf_dir):
    """Queries of benchmark items: two words, a phrase, alternatives, or an exclusion, by id."""
    w = F.regexp_extract_all("text", F.lit(r"([^\s.,]+)"), 1)
    at = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("the"))
    form = F.when(F.col("item_id") % 4 == 0, F.concat_ws(" ", at(1), at(2))).when(F.col("item_id") % 4 == 1, F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('"'))).when(F.col("item_id") % 4 == 2, F.concat(at(1), F.lit(" or "), at(3))).otherwise(F.concat(at(1), F.lit(" -"), at(4)))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), form.alias("query"), "text")


_W = "regexp_extract_all(text, '[^\\s.,]+')"
_AT = [f"coalesce({_W}[{i}], 'the')" for i in range(5)]
ASKED = f"""asked AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN {_AT[1]} || ' ' || {_AT[2]} WHEN 1 THEN '"' || {_AT[1]} || ' ' || {_AT[2]} || '"' WHEN 2 THEN {_AT[1]} || ' or ' || {_AT[3]} ELSE {_AT[1]} || ' -' || {_AT[4]} END AS query, text FROM benchmark)"""


def _embed(name, source, id_col, text):
    return f"""{name}_h AS (SELECT id, t, count(*) AS n, sha256(t) AS h FROM (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text}), '[\\pL\\pN\\pM\\p{{Pc}}]+')) AS t FROM {source}) GROUP BY 1, 2),
{name}_s AS (SELECT id, ('0x' || substr(h, 1 + 2 * o, 4))::int % {DIM} AS i, sum(CASE WHEN ('0x' || substr(h, 2 * o + 6, 1))::int % 2 = 1 THEN n ELSE -n END) AS w FROM {name}_h, (VALUES (0), (4), (8), (12)) v(o) GROUP BY 1, 2 HAVING sum(CASE WHEN ('0x' || substr(h, 2 * o + 6, 1))::int % 2 = 1 THEN n ELSE -n END) <> 0),
{name}_m AS (SELECT id, map_from_entries(list((i, w))) AS m, sqrt(sum(w * w)::double) AS norm FROM {name}_s GROUP BY 1),
{name} AS (SELECT b.{id_col} AS id, CASE WHEN m IS NULL THEN list_transform(generate_series(0, {DIM - 1}), lambda i: CASE WHEN i = 0 THEN 1.0::double ELSE 0.0::double END) ELSE list_transform(generate_series(0, {DIM - 1}), lambda i: coalesce(m[i::int], 0)::double / norm) END AS vector FROM {source} b LEFT JOIN {name}_m ON {name}_m.id = b.{id_col})"""


def _stop():
    return ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _words(x):
    return f"regexp_extract_all(translate(lower({x}), 'áéíóúüñ', 'aeiouun'), '[\\pL\\pN\\pM\\p{{Pc}}]+')"


_STEM = "CASE WHEN length(t) > 4 THEN regexp_replace(t, '(es|s)$', '') ELSE t END"
POSTINGS = f"""tokens AS (SELECT chunk_id, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS t FROM (SELECT chunk_id, {_words('content')} AS w FROM pieces)),
spots AS (SELECT chunk_id, pos, {_STEM} AS term FROM tokens WHERE length(t) > 1 AND t NOT IN ({_stop()}))"""
PARSED = f"""raws AS (SELECT query_id, unnest(generate_series(0, len(r) - 1)) AS part, unnest(r) AS raw FROM (SELECT query_id, regexp_extract_all(query, '-?"[^"]+"|\\S+') AS r FROM asked)),
grouped AS (SELECT *, sum((lower(raw) = 'or')::int) OVER (PARTITION BY query_id ORDER BY part) AS grp FROM raws),
words AS (SELECT query_id, grp, part, CASE WHEN raw LIKE '-%' THEN 'not' WHEN raw LIKE '"%' THEN 'phrase' ELSE 'word' END AS kind, unnest(generate_series(0, len(w) - 1)) AS i, unnest(w) AS t FROM (SELECT *, {_words('raw')} AS w FROM grouped WHERE lower(raw) <> 'or')),
parsed AS (SELECT query_id, grp, part, i, {_STEM} AS term, kind FROM words WHERE length(t) > 1 AND t NOT IN ({_stop()}))"""
LEXICAL = """wanted AS (SELECT DISTINCT query_id, grp, term FROM parsed WHERE kind <> 'not'), needs AS (SELECT query_id, grp, count(*) AS needed FROM wanted GROUP BY 1, 2),
hit AS (SELECT query_id, grp, chunk_id, term, pos FROM wanted JOIN spots USING (term)),
allin AS (SELECT query_id, grp, chunk_id, needed FROM hit JOIN needs USING (query_id, grp) GROUP BY ALL HAVING count(DISTINCT term) = needed),
barred AS (SELECT DISTINCT query_id, grp, chunk_id FROM parsed JOIN spots USING (term) WHERE kind = 'not'),
sizes AS (SELECT query_id, grp, part, count(*) AS size FROM parsed WHERE kind = 'phrase' GROUP BY ALL),
whole AS (SELECT DISTINCT query_id, grp, part, chunk_id FROM (SELECT query_id, grp, part, chunk_id, pos - i AS start, count(*) AS n FROM parsed JOIN spots USING (term) WHERE kind = 'phrase' GROUP BY ALL) JOIN sizes USING (query_id, grp, part) WHERE n = size),
kept AS (SELECT a.* FROM allin a WHERE NOT EXISTS (SELECT 1 FROM barred b WHERE b.query_id = a.query_id AND b.grp = a.grp AND b.chunk_id = a.chunk_id)
  AND (SELECT count(*) FROM sizes s WHERE s.query_id = a.query_id AND s.grp = a.grp) = (SELECT count(*) FROM whole w WHERE w.query_id = a.query_id AND w.grp = a.grp AND w.chunk_id = a.chunk_id)),
ks AS (SELECT hit.*, needed FROM hit JOIN kept USING (query_id, grp, chunk_id)),
lst AS (SELECT a.query_id, a.grp, a.chunk_id, a.needed, a.pos AS "end", b.term, max(b.pos) AS p FROM ks a JOIN ks b ON a.query_id = b.query_id AND a.grp = b.grp AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL),
win AS (SELECT query_id, grp, chunk_id, needed, "end", min(p) AS start FROM lst GROUP BY ALL HAVING count(*) = needed),
mini AS (SELECT *, lag(start) OVER (PARTITION BY query_id, grp, chunk_id ORDER BY "end") AS before FROM win),
sc AS (SELECT query_id, grp, chunk_id, sum(1.0::double / (1 + "end" - start + 1 - needed)) AS score FROM mini WHERE before IS NULL OR start > before GROUP BY ALL),
bestl AS (SELECT query_id, chunk_id, max(score) AS score FROM sc GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bestl) WHERE rank <= 20)"""
SEMANTIC = f"""sem AS (SELECT * FROM (SELECT q.id AS query_id, p.id AS chunk_id, list_dot_product(q.vector, p.vector) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.vector, p.vector), 9) DESC, p.id) AS rank FROM qv q, pv p WHERE list_dot_product(q.vector, p.vector) >= {FLOOR}) WHERE rank <= 20)"""
FUSED = """fj AS (SELECT coalesce(s.query_id, x.query_id) AS query_id, coalesce(s.chunk_id, x.chunk_id) AS chunk_id, s.score AS semantic_score, s.rank AS semantic_rank, x.score AS lexical_score, x.rank AS lexical_rank, coalesce(0.7::double / (60 + s.rank), 0) + coalesce(0.3::double / (60 + x.rank), 0) AS fusion_score,
  CASE WHEN s.rank IS NULL THEN 'LEXICAL' WHEN x.rank IS NULL THEN 'SEMANTIC' ELSE 'HYBRID' END AS retrieval_source FROM sem s FULL JOIN lex x ON s.query_id = x.query_id AND s.chunk_id = x.chunk_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 12) DESC, chunk_id) AS rank FROM fj) WHERE rank <= 20)"""


def _rt(x):
    return f"list_filter({_words(x)}, lambda t: length(t) > 1 AND t NOT IN ({_stop()}))"


RERANKED = f"""rq AS (SELECT query_id, {_rt('text')} AS q FROM asked), rd AS (SELECT f.query_id, f.chunk_id, f.rank, list_distinct({_rt('content')}) AS d FROM fused f JOIN pieces USING (chunk_id)),
rs AS (SELECT query_id, chunk_id, rank, round(CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0 ELSE least(1, len(list_filter(q, lambda t: list_contains(d, t))) / len(q)::double / (1 + ln(1 + len(d) / 60.0::double))) END, 6) AS rerank_score FROM rd JOIN rq USING (query_id)),
reranked AS (SELECT query_id, chunk_id, rerank_score, rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM rs) WHERE rerank_rank <= 5)"""
_BASE = cte("pieces") + ",\n" + ASKED
_LEX = ",\n".join([_BASE, POSTINGS, PARSED, LEXICAL])
ALL = ",\n".join([_LEX, _embed("pv", "pieces", "chunk_id", "content"), _embed("qv", "asked", "query_id", "text"), SEMANTIC, FUSED, RERANKED])


def of_code(*modules):
    """A digest of the modules that make what is stored, so that a change of theirs makes it anew."""
    return hashlib.sha256(b"".join(Path(m.__file__).read_bytes() for m in (T, views, *modules))).hexdigest()[:8]


def index(spark, sf_dir):
    """The pieces' lexical index, written once for each version of the documents."""
    path = kept(spark, "lexical-index", f"{version(load(spark, sf_dir, 'documents'))}-{of_code(L)}", lambda at: L.LexicalIndex.write(pieces(spark, sf_dir), at))
    return L.LexicalIndex(spark, path)


def piece_vectors(spark, sf_dir):
    """The pieces' vectors (id, document_id, vector), written once for each version of the documents."""
    made = lambda at: E.hash_embed(pieces(spark, sf_dir), "chunk_id", "content", DIM).withColumn("document_id", F.floor(F.col("id") / 100_000).cast("long")).write.parquet(at)
    return spark.read.schema("id long, vector array<double>, document_id long").parquet(kept(spark, "piece-vectors", f"{version(load(spark, sf_dir, 'documents'))}-{of_code(E)}", made))


def query_vectors(spark, sf_dir):
    return E.hash_embed(asked(spark, sf_dir), "query_id", "text", DIM).withColumnRenamed("id", "query_id")


def semantic(spark, sf_dir):
    return E.nearest(piece_vectors(spark, sf_dir), query_vectors(spark, sf_dir), R.TOP_K, FLOOR).withColumnRenamed("id", "chunk_id")


def lexical(spark, sf_dir):
    return L.lexical_search(L.parse_query(asked(spark, sf_dir)), index(spark, sf_dir), R.TOP_K)


def fused(spark, sf_dir):
    """The best of both arms; a few rows for each query, written so that both arms run once."""
    return stored(R.rrf_fuse(semantic(spark, sf_dir), lexical(spark, sf_dir)), "fused")


def reranked(spark, sf_dir, f=None):
    f = fused(spark, sf_dir) if f is None else f
    q = asked(spark, sf_dir).select("query_id", F.col("text").alias("query"))
    return R.rerank_overlap(q, with_content(spark, sf_dir, f))


def with_content(spark, sf_dir, f):
    """Results with their pieces' texts; `f` has TOP_K rows for a query, and the documents of these are cut into pieces, no others."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    few = L.few(f.select(F.floor(F.col("chunk_id") / 100_000).cast("long").alias("doc_id"), F.pmod("chunk_id", F.lit(100_000)).cast("int").alias("pos"), *f.columns))
    return d.join(few, "doc_id").withColumn("content", F.get(F.split("text", "\n"), F.col("pos"))).select(*f.columns, F.col("doc_id").alias("document_id"), "content")


@query("c10_hash_embed", ",\n".join([cte("pieces"), _embed("pv", "pieces", "chunk_id", "content")]) + " SELECT id, list_transform(vector, lambda x: round(x, 6)) AS vector FROM pv")
def c10(spark, sf_dir):
    """The stored vectors of all pieces; the first of all queries that need them writes them."""
    return piece_vectors(spark, sf_dir).select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("c11_embed_seam", ",\n".join([cte("pieces"), _embed("pv", "pieces", "chunk_id", "content")]) + " SELECT id AS chunk_id, list_transform(vector, lambda x: round(x::float::double, 5)) AS vector FROM pv")
def c11(spark, sf_dir):
    """The hashed words model through the seam."""
    made = E.embed(pieces(spark, sf_dir).withColumn("content", F.lower("content")), E.HashVectors(DIM), DIM)
    return made.select("chunk_id", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


@query("c12_truncate_vector", "SELECT vec_id, list_transform(h, lambda x: round(x / sqrt(list_dot_product(h, h)), 6)) AS vector FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::double) AS h FROM embeddings)")
def c12(spark, sf_dir):
    """A negative number that rounds to zero is -0.0, as in SQL; Spark's own rounding drops its sign."""
    signed = lambda x: F.signum(x) * F.round(F.abs(x), 6)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.transform(E.truncate_vector(F.col("embedding"), 16), signed).alias("vector"))


MODELS = "SELECT chunk_id, CASE WHEN chunk_id % 9 = 0 THEN NULL ELSE 1 END AS vector, CASE WHEN chunk_id % 4 = 0 THEN 'old' ELSE 'new' END AS embedding_model FROM {}"


@query("c13_model_isolation", cte("pieces") + f", m AS ({MODELS.format('pieces')}) SELECT count_if(vector IS NOT NULL AND embedding_model = 'new') AS active, count_if(vector IS NOT NULL AND embedding_model <> 'new') AS other, count_if(vector IS NULL) AS unembedded FROM m")
def c13(spark, sf_dir):
    return E.model_counts(spark.sql(MODELS.format("{p}"), p=pieces(spark, sf_dir)), "new")


@query("c13_searchable", cte("pieces") + f", m AS ({MODELS.format('pieces')}) SELECT chunk_id FROM m WHERE vector IS NOT NULL AND embedding_model = 'new'")
def c13_searchable(spark, sf_dir):
    return E.searchable(spark.sql(MODELS.format("{p}"), p=pieces(spark, sf_dir)), "new").select("chunk_id")


#: Filters of benchmark items by id; every list is used by some.
FILTERS = """SELECT item_id AS query_id, {areas} AS areas, {jurisdictions} AS jurisdictions, {courts} AS courts, {types} AS types, {statuses} AS statuses, {document_ids} AS document_ids,
  CASE WHEN item_id % 3 = 1 THEN DATE '2005-01-01' END AS published_after, CASE WHEN item_id % 3 = 2 THEN DATE '2010-01-01' END AS published_before FROM {b}"""
_IN = {"areas": ("item_id % 4 = 0", "'CIVIL', 'PENAL'"), "jurisdictions": ("item_id % 3 = 0", "'en', 'fr'"), "courts": ("item_id % 7 = 3", "'Corte 0', 'Corte 2'"), "types": ("item_id % 6 = 1", "'LEY', 'DECRETO'"), "statuses": ("item_id % 5 = 0", "'VIGENTE'"), "document_ids": ("item_id % 9 = 5", "item_id, item_id + 1, item_id + 2, 7, 8, 9")}
FILTERS_SQL = "f AS (" + FILTERS.format(b="benchmark", **{k: f"CASE WHEN {c} THEN [{v}] END" for k, (c, v) in _IN.items()}) + ")"
#: A chunk's document columns, whether it has a vector, and of which model.
META = "SELECT document_id, legal_area, jurisdiction, CASE WHEN document_id % 4 = 1 THEN NULL ELSE 'Corte ' || CAST(document_id % 3 AS VARCHAR(3)) END AS court, document_type, status, publication_date, embedding_model, document_id % 17 <> 4 AS has_vector FROM {}"
_PASS = " AND ".join([f"embedding_model = '{ACTIVE_MODEL}' AND has_vector", *[f"(coalesce(len({name}), 0) = 0 OR coalesce(list_contains({name}, {column}), false))" for column, name in R.LISTS.items()], "(published_after IS NULL OR publication_date IS NULL OR publication_date >= published_after) AND (published_before IS NULL OR publication_date IS NULL OR publication_date <= published_before)"])


def filters(spark, sf_dir):
    lists = {k: f"CASE WHEN {c} THEN array({v}) END" for k, (c, v) in _IN.items()}
    return spark.sql(FILTERS.format(b="{b}", **lists), b=load(spark, sf_dir, "benchmark"))


def meta(spark, sf_dir):
    return spark.sql(META.format("{c}"), c=view(spark, sf_dir, "corpus"))


@query("d1_apply_filters", ",\n".join([cte("corpus", "pieces"), ASKED, POSTINGS, PARSED, FILTERS_SQL, f"m AS ({META.format('corpus')})"]) + f" SELECT DISTINCT query_id, document_id FROM (SELECT DISTINCT query_id, document_id FROM parsed JOIN spots USING (term) JOIN pieces USING (chunk_id)) c JOIN f USING (query_id) JOIN m USING (document_id) WHERE {_PASS}")
def d1(spark, sf_dir):
    """The documents that share a term with a query, narrowed by the query's filters."""
    terms = stored(L.parse_query(asked(spark, sf_dir)).select("query_id", "term").distinct(), "query-terms")
    held = L.exploded(index(spark, sf_dir).of(terms).join(L.few(terms), "term"), "query_id")
    shared = held.select("query_id", F.floor(F.col("chunk_id") / 100_000).cast("long").alias("document_id")).distinct()
    return R.apply_filters(shared.join(meta(spark, sf_dir), "document_id"), filters(spark, sf_dir), ACTIVE_MODEL).select("query_id", "document_id")


@query("d2_lexical_index", ",\n".join([cte("pieces"), POSTINGS]) + " SELECT term, chunk_id, list_sort(list(pos::int)) AS positions FROM spots GROUP BY 1, 2")
def d2(spark, sf_dir):
    """The stored index as postings; the first of all queries that need it writes it."""
    return index(spark, sf_dir).postings()


@query("d3_parse_query", "WITH " + ",\n".join([ASKED, PARSED]) + " SELECT * FROM parsed")
def d3(spark, sf_dir):
    return L.parse_query(asked(spark, sf_dir))


@query("d4_lexical_search", _LEX + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex")
def d4(spark, sf_dir):
    return lexical(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("d5_semantic_search", "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::double) AS vector FROM embeddings), s AS (SELECT q.id AS query_id, p.id, round(list_cosine_similarity(q.vector, p.vector), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vector, p.vector), 9) DESC, p.id) AS rank FROM v q, v p WHERE q.id % 50 = 0 AND list_cosine_similarity(q.vector, p.vector) >= 0.1) SELECT * FROM s WHERE rank <= 20")
def d5(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return E.nearest(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 20, 0.1).withColumn("score", F.round("score", 6))


def vector_index(spark, sf_dir):
    """The index of all embeddings, written once for each version of the table."""
    table = load(spark, sf_dir, "embeddings")
    base = spread(table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    return V.VectorIndex(spark, kept(spark, "vector-index", f"{version(table)}-{of_code(E, V)}", lambda at: V.VectorIndex.write(base, at, 20)))


def approximate(spark, sf_dir, tally=False):
    q = load(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index(spark, sf_dir).search(q, 20, 0.1, tally)


@query("d6_vector_index", "SELECT vec_id AS id FROM embeddings WHERE embedding IS NOT NULL")
def d6_index(spark, sf_dir):
    """Every row that the stored index holds; the first query that needs the index writes it."""
    return vector_index(spark, sf_dir).blocks.select(F.explode("ids").alias("id"))


@query("d6_approximate_search")
def d6(spark, sf_dir):
    return approximate(spark, sf_dir)


@query("d6_recall", "SELECT count(*) AS queries, true AS enough, true AS fewer FROM embeddings WHERE vec_id % 50 = 0")
def d6_recall(spark, sf_dir):
    """Whether the approximate search finds 0.9 or more of what the exact one does, and scores fewer rows exactly than all of them."""
    true, got = d5(spark, sf_dir).select("query_id", "id"), approximate(spark, sf_dir).select("query_id", "id", F.lit(1).alias("hit"))
    share = true.join(got, ["query_id", "id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))
    scored = approximate(spark, sf_dir, tally=True).agg(F.sum("scored").alias("scored"))
    asked, rows = load(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").agg(F.count("*").alias("queries")), load(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows"))
    return asked.join(share).join(scored).join(rows).select("queries", (F.col("recall") >= 0.9).alias("enough"), (F.col("scored") < F.col("queries") * F.col("rows")).alias("fewer"))


@query("d7_rrf_fusion", ALL + " SELECT query_id, chunk_id, semantic_rank, lexical_rank, round(fusion_score, 9) AS fusion_score, retrieval_source, rank FROM fused")
def d7(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "chunk_id", "semantic_rank", "lexical_rank", F.round("fusion_score", 9).alias("fusion_score"), "retrieval_source", "rank")


@query("d8_rerank_overlap", ALL + " SELECT * FROM reranked")
def d8(spark, sf_dir):
    return reranked(spark, sf_dir)


@query("d8b_rerank_none", ALL + " SELECT query_id, chunk_id, 0.0::double AS rerank_score, rank AS rerank_rank FROM fused WHERE rank <= 5")
def d8b(spark, sf_dir):
    return R.rerank_none(fused(spark, sf_dir))


ANSWERS = "SELECT conv_id AS query_id, CASE WHEN turn % 7 = 3 THEN -1 WHEN turn % 5 = 4 THEN 1 ELSE turn END AS index, CASE WHEN turn % 6 = 5 THEN NULL ELSE 0.5 END AS score FROM {}"


@query("d8c_rerank_contract", f"""WITH a AS ({ANSWERS.format('conversations').replace('AS index', 'AS "index"')}), s AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 30 = 0 THEN 600 ELSE 4 END AS n FROM conversations GROUP BY 1)
SELECT query_id, 'range' AS rule FROM a JOIN s USING (query_id) WHERE "index" < 0 OR "index" >= n UNION ALL SELECT query_id, 'duplicate' FROM a GROUP BY query_id, "index" HAVING count(*) > 1 UNION ALL SELECT query_id, 'score' FROM a WHERE score IS NULL UNION ALL SELECT query_id, 'size' FROM s WHERE n > 500""")
def d8c(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return R.rerank_contract(spark.sql(ANSWERS.format("{c}"), c=c), c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("n", F.when(F.col("query_id") % 30 == 0, 600).otherwise(4)))


_GATE = """ctx AS (SELECT * FROM reranked WHERE query_id % 6 > 0), g AS (SELECT query_id, count(*) AS n, arg_min(rerank_score, rerank_rank) AS top FROM ctx GROUP BY 1),
gate AS (SELECT a.query_id, CASE WHEN n IS NULL THEN 'no_candidates' WHEN top < 0.35 THEN 'below_evidence_threshold' ELSE 'sufficient' END AS reason, top FROM asked a LEFT JOIN g USING (query_id))"""


@query("d9_evidence_gate", ALL + ",\n" + _GATE + " SELECT query_id, reason = 'sufficient' AS sufficient, reason, top AS top_score FROM gate")
def d9(spark, sf_dir):
    context = reranked(spark, sf_dir).where("query_id % 6 > 0").withColumnRenamed("rerank_rank", "rank")
    return R.evidence_gate(asked(spark, sf_dir), context)


_PACK = """costs AS (SELECT f.query_id, f.rank, f.chunk_id, greatest(1, round_even(length(content) / 3.6::double, 0))::bigint AS cost, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM fused f JOIN pieces USING (chunk_id)),
fold AS (SELECT query_id, n, chunk_id, cost, 400::bigint - cost AS left_, true AS took, 1 AS kept FROM costs WHERE n = 1 UNION ALL
 SELECT c.query_id, c.n, c.chunk_id, c.cost, CASE WHEN f.left_ > 0 AND c.cost <= f.left_ THEN f.left_ - c.cost ELSE f.left_ END, f.left_ > 0 AND c.cost <= f.left_, f.kept + (f.left_ > 0 AND c.cost <= f.left_)::int FROM fold f JOIN costs c ON c.query_id = f.query_id AND c.n = f.n + 1)"""


@query("d10_pack_context", ",\n".join([ALL, _PACK]) + " SELECT query_id, chunk_id, kept AS n FROM fold WHERE took")
def d10(spark, sf_dir):
    """The fused results packed into 400 tokens."""
    c = with_content(spark, sf_dir, fused(spark, sf_dir)).select("query_id", "rank", "chunk_id", T.estimate_tokens(F.col("content")).cast("long").alias("cost"))
    return R.pack_context(c, 400)


_SUMMARY = " SELECT a.query_id, coalesce(s.n, 0) AS semantic, coalesce(x.n, 0) AS lexical, coalesce(f.n, 0) AS fused, coalesce(r.n, 0) AS reranked, r.top AS top_score, {} AS lexical_degraded FROM asked a LEFT JOIN (SELECT query_id, count(*) AS n FROM sem GROUP BY 1) s USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM lex GROUP BY 1) x USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM fused GROUP BY 1) f USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n, max(rerank_score) AS top FROM reranked GROUP BY 1) r USING (query_id)"


@query("d11_retrieval_summary", ALL + _SUMMARY.format("false"))
def d11(spark, sf_dir):
    s, x = stored(semantic(spark, sf_dir), "semantic"), stored(lexical(spark, sf_dir), "lexical")
    f = stored(R.rrf_fuse(s, x), "fused")
    return R.retrieval_summary(asked(spark, sf_dir), s, x, f, stored(reranked(spark, sf_dir, f), "reranked"))


@query("d12_semantic_only", ALL.replace("lex AS (SELECT * FROM (SELECT *,", "lex AS (SELECT * FROM (SELECT * FROM (SELECT *,").replace("FROM bestl) WHERE rank <= 20)", "FROM bestl) WHERE rank <= 20) WHERE false)") + _SUMMARY.format("true"))
def d12(spark, sf_dir):
    s = stored(semantic(spark, sf_dir), "semantic")
    none = s.limit(0)
    f = stored(R.rrf_fuse(s, none), "fused")
    return R.retrieval_summary(asked(spark, sf_dir), s, none, f, stored(reranked(spark, sf_dir, f), "reranked"), degraded=True)


_NARROW = ",\n".join([FILTERS_SQL, f"m AS ({META.format('corpus')}), cm AS (SELECT chunk_id, m.* FROM pieces JOIN m USING (document_id))"])
_SEM_F = SEMANTIC.replace("FROM qv q, pv p WHERE", "FROM qv q JOIN f ON f.query_id = q.id, pv p JOIN cm ON cm.chunk_id = p.id WHERE " + _PASS + " AND")
_LEX_F = LEXICAL.replace("bestl AS (SELECT query_id, chunk_id, max(score) AS score FROM sc GROUP BY 1, 2)", f"bestl AS (SELECT query_id, chunk_id, max(score) AS score FROM sc JOIN f USING (query_id) JOIN cm USING (chunk_id) WHERE {_PASS} GROUP BY 1, 2)")
_FILTERED = ",\n".join([cte("pieces", "corpus"), ASKED, _NARROW, POSTINGS, PARSED, _LEX_F, _embed("pv", "pieces", "chunk_id", "content"), _embed("qv", "asked", "query_id", "text"), _SEM_F, FUSED, RERANKED])


@query("d13_retrieve", _FILTERED + ", gated AS (SELECT query_id FROM reranked GROUP BY 1 HAVING arg_min(rerank_score, rerank_rank) >= 0.35) SELECT query_id, chunk_id, document_id, rerank_rank AS n, rerank_score FROM reranked JOIN gated USING (query_id) JOIN pieces USING (chunk_id)")
def d13(spark, sf_dir):
    """Filters before both arms' limits, fusion, reranking, the evidence gate and packing; five pieces never exceed the default budget on these tables."""
    wanted = filters(spark, sf_dir)
    about = meta(spark, sf_dir)
    usable = about.where(F.col("has_vector") & (F.col("embedding_model") == ACTIVE_MODEL)).select("document_id", R.facts(F.col).alias("facts"))
    base = piece_vectors(spark, sf_dir).join(usable, "document_id")
    q = query_vectors(spark, sf_dir).join(wanted.select("query_id", R.demands(F.col).alias("demands")), "query_id")
    s = E.nearest(base, q, R.TOP_K, FLOOR, "facts", "demands", R.block_mask).withColumnRenamed("id", "chunk_id")
    narrowed = lambda df: R.apply_filters(df.withColumn("document_id", F.floor(F.col("chunk_id") / 100_000).cast("long")).join(about, "document_id"), wanted, ACTIVE_MODEL).select("query_id", "chunk_id", "score")
    x = L.lexical_search(L.parse_query(asked(spark, sf_dir)), index(spark, sf_dir), R.TOP_K, narrowed)
    r = stored(reranked(spark, sf_dir, stored(R.rrf_fuse(s, x), "fused")), "reranked")
    enough = R.evidence_gate(asked(spark, sf_dir), r.withColumnRenamed("rerank_rank", "rank")).where("sufficient").select("query_id")
    c = with_content(spark, sf_dir, r.join(enough, "query_id", "left_semi")).select("query_id", F.col("rerank_rank").alias("rank"), "chunk_id", "document_id", "rerank_score", T.estimate_tokens(F.col("content")).cast("long").alias("cost"))
    return R.pack_context(c).join(c, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "document_id", "n", "rerank_score")


_GRAMS = "list_distinct(flatten(list_transform(string_split(trim(regexp_replace(lower(title), '[^a-z0-9áéíóúüñ]+', ' ', 'g')), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("d14_fuzzy_title", f"""WITH t AS (SELECT p_partkey AS id, p_name AS title, {_GRAMS.replace('title', 'p_name')} AS g FROM part), q AS (SELECT id, g, len(g) AS nq FROM t WHERE id % 50 = 0), e AS (SELECT id, len(g) AS nt, unnest(g) AS g FROM t), qe AS (SELECT id AS query_id, nq, unnest(g) AS g FROM q),
s AS (SELECT query_id, id AS title_id, round(count(*) / (nq + nt - count(*))::double, 6) AS similarity FROM qe JOIN e USING (g) GROUP BY query_id, nq, id, nt)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, title_id) AS rank FROM s WHERE similarity >= 0.3) WHERE rank <= 5""")
def d14(spark, sf_dir):
    t = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"))
    return R.fuzzy_title(t.where("title_id % 50 = 0").withColumnRenamed("title_id", "query_id"), t)


@query("d15_search_titles", cte("corpus") + " SELECT document_id, title, publication_date FROM corpus WHERE contains(lower(title), 'documento 1') AND legal_area = 'CIVIL' ORDER BY publication_date DESC NULLS LAST, document_id")
def d15(spark, sf_dir):
    c = view(spark, sf_dir, "corpus")
    return c.where(F.lower("title").contains("documento 1") & (F.col("legal_area") == "CIVIL")).select("document_id", "title", "publication_date").orderBy(F.desc_nulls_last("publication_date"), "document_id")


WEB = "SELECT CAST(floor(page_id / 40) AS BIGINT) AS query_id, page_id AS pos, CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 50 = 7 THEN 'https://search.example' ELSE 'http://r.example/' || CAST(page_id % 50 AS VARCHAR(9)) END AS url, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS title, html AS snippet FROM {}"
SAID = "SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'twenty characters....' END AS answer FROM {}"


@query("d16_dedup_results", f"""WITH w AS ({WEB.format('pages').replace('ELSE url END AS title', 'ELSE pages.url END AS title')}), s AS ({SAID.format('benchmark')}), a AS (SELECT query_id, -1 AS pos, 'https://search.example' AS url, 'Síntesis de información actualizada' AS title, answer AS snippet FROM s WHERE length(answer) > 20 UNION ALL SELECT query_id, pos, url, coalesce(nullif(title, ''), 'Fuente Web'), snippet FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY pos) AS rn FROM a WHERE url <> '') SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n, url, title, md5(snippet) AS digest FROM o WHERE rn = 1""")
def d16(spark, sf_dir):
    results = spark.sql(WEB.format("{p}").replace("ELSE url END AS title", "ELSE p.url END AS title").replace("{p}", "{pages} p"), pages=load(spark, sf_dir, "pages"))
    answers = spark.sql(SAID.format("{b}"), b=load(spark, sf_dir, "benchmark"))
    return R.dedup_results(results, answers).select("query_id", "n", "url", "title", F.md5("snippet").alias("digest"))


@query("g9_arm_contribution", ALL + " SELECT query_id, count_if(retrieval_source = 'SEMANTIC') AS \"SEMANTIC\", count_if(retrieval_source = 'LEXICAL') AS \"LEXICAL\", count_if(retrieval_source = 'HYBRID') AS \"HYBRID\", round(count_if(retrieval_source = 'HYBRID') / count(*), 6) AS hybrid_share FROM fused GROUP BY 1")
def g9(spark, sf_dir):
    return R.arm_contribution(fused(spark, sf_dir))


# ---- evaluation -------------------------------------------------------------------

_JUDGE = """results AS (SELECT r.query_id, rerank_rank AS rank, CASE WHEN p.chunk_id % 10 = 0 THEN NULL ELSE ' D' || document_id || ' ' END AS item FROM reranked r JOIN pieces p USING (chunk_id)),
expected AS (SELECT item_id AS query_id, 'd' || doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
fl AS (SELECT query_id, min(rank) AS first FROM results JOIN (SELECT query_id, item AS e FROM expected) USING (query_id) WHERE lower(trim(item)) = e GROUP BY 1),
cnt AS (SELECT query_id, count(item) AS retrieved, count_if(lower(trim(item)) IN (SELECT e.item FROM expected e WHERE e.query_id = results.query_id)) AS hits FROM results GROUP BY 1),
rc AS (SELECT query_id, avg((item IN (SELECT lower(trim(r.item)) FROM results r WHERE r.query_id = expected.query_id AND r.item IS NOT NULL))::int) AS recall FROM expected GROUP BY 1),
cases AS (SELECT a.query_id, CASE WHEN recall IS NULL OR first <= 1 THEN 1.0 ELSE 0.0 END::double AS hit_at_1, CASE WHEN recall IS NULL OR first <= 3 THEN 1.0 ELSE 0.0 END::double AS hit_at_3, CASE WHEN recall IS NULL OR first <= 5 THEN 1.0 ELSE 0.0 END::double AS hit_at_5,
  round(CASE WHEN recall IS NULL THEN 1 ELSE coalesce(1.0::double / first, 0) END, 6) AS mrr, round(coalesce(recall, 1), 6) AS context_recall, round(CASE WHEN coalesce(retrieved, 0) = 0 THEN 0 ELSE hits / retrieved::double END, 6) AS context_precision
  FROM asked a LEFT JOIN fl USING (query_id) LEFT JOIN cnt USING (query_id) LEFT JOIN rc USING (query_id))"""


def cases(spark, sf_dir, rows=None):
    r = stored(reranked(spark, sf_dir), "reranked") if rows is None else rows
    item = F.when(F.col("chunk_id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit(" D"), "document_id", F.lit(" ")))
    results = r.withColumn("document_id", F.floor(F.col("chunk_id") / 100_000).cast("long")).select("query_id", F.col("rerank_rank").alias("rank"), item.alias("item"))
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("wanted"))
    expected = J.containing(load(spark, sf_dir, "documents"), b).select("query_id", F.concat(F.lit("d"), "doc_id").alias("item"))
    return J.evaluate_cases(asked(spark, sf_dir), results, expected)


_CASES = ALL + ",\n" + _JUDGE
for _name, _columns in (("j1_hit_rate", ("hit_at_1", "hit_at_3", "hit_at_5")), ("j2_mrr", ("mrr",)), ("j3_context_recall", ("context_recall",)), ("j4_context_precision", ("context_precision",))):

    @query(_name, f"{_CASES} SELECT query_id, {', '.join(_columns)} FROM cases")
    def _one(spark, sf_dir, columns=_columns):
        return cases(spark, sf_dir).select("query_id", *columns)


@query("j5_case_report", _CASES + " SELECT * FROM cases")
def j5(spark, sf_dir):
    return cases(spark, sf_dir)


@query("j6_corpus_means", _CASES + " SELECT CASE WHEN grouping(area) = 1 THEN NULL ELSE area END AS area, count(*) AS cases, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(mrr), 6) AS mrr, round(avg(context_recall), 6) AS context_recall, round(avg(context_precision), 6) AS context_precision FROM (SELECT *, 'area' || query_id % 3 AS area FROM cases) GROUP BY ROLLUP (area)")
def j6(spark, sf_dir):
    return J.evaluate_corpus(cases(spark, sf_dir).withColumn("area", F.concat(F.lit("area"), F.col("query_id") % 3)), "area")


@query("j7_ablation", _CASES.replace("reranked r JOIN", "reranked r JOIN") + """, plain AS (SELECT f.query_id, min(f.rank) AS first FROM fused f JOIN pieces p USING (chunk_id) JOIN expected e ON e.query_id = f.query_id AND e.item = 'd' || document_id WHERE f.rank <= 5 AND p.chunk_id % 10 <> 0 GROUP BY 1)
SELECT c.query_id, c.mrr AS reranked, round(CASE WHEN recall IS NULL THEN 1 ELSE coalesce(1.0::double / plain.first, 0) END, 6) AS plain FROM cases c LEFT JOIN rc USING (query_id) LEFT JOIN plain USING (query_id)""")
def j7(spark, sf_dir):
    f = fused(spark, sf_dir)
    return J.ablation({"reranked": cases(spark, sf_dir, reranked(spark, sf_dir, f)), "plain": cases(spark, sf_dir, R.rerank_none(f))}, "mrr")


