"""Structural chunking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import chunking as C
from lectern.sources.tables import load, spread

from .text import SPACE, strip_sql

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add




def legal(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents"), "doc_id").where("text <> ''").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("lines"))
    head = lambda line, i: F.concat(
        F.when(i % 12 == 0, F.concat(F.lit("TÍTULO "), i.cast("string"), F.lit("\n"))).otherwise(""), F.when(i % 4 == 0, F.concat(F.lit("CAPÍTULO "), i.cast("string"), F.lit("\n"))).otherwise(""),
        F.when(i % 5 == 4, F.lit("PARÁGRAFO. ")).otherwise(F.concat(F.lit("ARTÍCULO "), (i + 1).cast("string"), F.lit(". "))), line)
    return docs.select("id", F.array_join(F.transform("lines", head), "\n\n").alias("text"))


_LINES = "ll AS (SELECT doc_id AS id, unnest(generate_series(0, len(x) - 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''))"
_LEGAL = f"{_LINES}, lb AS (SELECT id, i, CASE WHEN i % 12 = 0 THEN length('TÍTULO ' || i) + 1 ELSE 0 END AS t, CASE WHEN i % 4 = 0 THEN length('CAPÍTULO ' || i) + 1 ELSE 0 END AS c, length(CASE WHEN i % 5 = 4 THEN 'PARÁGRAFO. ' ELSE 'ARTÍCULO ' || (i + 1) || '. ' END || line) AS b FROM ll), lo AS (SELECT *, coalesce(sum(t + c + b + 2) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM lb)"
#: Headings as the injection puts them: a block's first heading takes the blank line before it.
_SECTIONS = f"""{_LEGAL}, hd AS (SELECT id, i, 0 AS k, 'TITULO' AS kind, 2 AS depth, i::varchar AS number, 'Título ' || i AS label, CASE WHEN i = 0 THEN 0 ELSE o - 1 END AS start FROM lo WHERE i % 12 = 0
UNION ALL SELECT id, i, 1, 'CAPITULO', 3, i::varchar, 'Capítulo ' || i, CASE WHEN i % 12 = 0 THEN o + t WHEN i = 0 THEN 0 ELSE o - 1 END FROM lo WHERE i % 4 = 0
UNION ALL SELECT id, i, 2, CASE WHEN i % 5 = 4 THEN 'PARAGRAFO' ELSE 'ARTICULO' END, CASE WHEN i % 5 = 4 THEN 7 ELSE 6 END, CASE WHEN i % 5 = 4 THEN NULL ELSE (i + 1)::varchar END, CASE WHEN i % 5 = 4 THEN 'Parágrafo' ELSE 'Artículo ' || (i + 1) END, CASE WHEN t + c > 0 THEN o + t + c ELSE o - 1 END FROM lo)"""


@query("c1_find_sections", f"WITH {_SECTIONS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, k) - 1 AS i, kind, number, label, depth, start FROM hd")
def c1(spark, sf_dir):
    return C.find_sections(legal(spark, sf_dir)).withColumn("start", F.col("start").cast("long"))


@query("c2_section_paths", f"""WITH {_SECTIONS}, s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, k) - 1 AS n, i // 12 * 12 AS ti, i // 4 * 4 AS ch FROM hd)
SELECT id, n AS i, CASE WHEN kind = 'PARAGRAFO' AND i % 4 > 0 THEN 'Artículo ' || i || ' > Parágrafo' ELSE label END AS section, CASE WHEN kind = 'ARTICULO' THEN number WHEN kind = 'PARAGRAFO' AND i % 4 > 0 THEN i::varchar END AS article_number,
  'Título ' || ti || CASE WHEN kind = 'TITULO' THEN '' ELSE ' > Capítulo ' || ch || CASE kind WHEN 'CAPITULO' THEN '' WHEN 'ARTICULO' THEN ' > ' || label ELSE CASE WHEN i % 4 > 0 THEN ' > Artículo ' || i ELSE '' END || ' > Parágrafo' END END AS path FROM s""")
def c2(spark, sf_dir):
    return C.section_paths(C.find_sections(legal(spark, sf_dir))).select("id", "i", "section", "article_number", "path")


def spans(spark, sf_dir, docs):
    return C.merge_spans(docs, C.section_paths(C.find_sections(docs)), 300, 30)


_TOK = "greatest(1, round_even(({}) / 3.6::double, 0))"
_MERGED = f"""{_SECTIONS}, total AS (SELECT id, max(o + t + c + b) AS len FROM lo GROUP BY 1), sp AS (SELECT hd.id, row_number() OVER (PARTITION BY hd.id ORDER BY i, k) AS n, start, coalesce(lead(start) OVER (PARTITION BY hd.id ORDER BY i, k), len) AS "end", CASE kind WHEN 'TITULO' THEN 1 WHEN 'CAPITULO' THEN 2 WHEN 'ARTICULO' THEN 3 ELSE CASE WHEN i % 4 > 0 THEN 4 ELSE 3 END END AS levels FROM hd JOIN total USING (id)),
mg AS (SELECT id, n, start::bigint AS start, "end"::bigint AS "end", levels, 0 AS part FROM sp WHERE n = 1 UNION ALL
 SELECT s.id, s.n, CASE WHEN {_TOK.format('m."end" - m.start')} < 30 AND {_TOK.format('s."end" - m.start')} <= 300 THEN m.start ELSE s.start END::bigint, s."end"::bigint, s.levels, m.part + CASE WHEN {_TOK.format('m."end" - m.start')} < 30 AND {_TOK.format('s."end" - m.start')} <= 300 THEN 0 ELSE 1 END FROM mg m JOIN sp s ON s.id = m.id AND s.n = m.n + 1),
fin AS (SELECT id, part AS n, min(start) AS start, max("end") AS "end" FROM mg GROUP BY 1, 2)"""


@query("c3_merge_spans", f'WITH RECURSIVE {_MERGED} SELECT id, n, start, "end" FROM fin')
def c3(spark, sf_dir):
    return spans(spark, sf_dir, legal(spark, sf_dir)).select("id", "n", "start", "end")


_SECTION = """CASE WHEN kind = 'PARAGRAFO' AND i % 4 > 0 THEN 'Artículo ' || i || ' > Parágrafo' ELSE label END"""
_ARTICLE = """CASE WHEN kind = 'ARTICULO' THEN number WHEN kind = 'PARAGRAFO' AND i % 4 > 0 THEN i::varchar END"""
_PATH = """'Título ' || (i // 12 * 12) || CASE WHEN kind = 'TITULO' THEN '' ELSE ' > Capítulo ' || (i // 4 * 4) || CASE kind WHEN 'CAPITULO' THEN '' WHEN 'ARTICULO' THEN ' > ' || label ELSE CASE WHEN i % 4 > 0 THEN ' > Artículo ' || i ELSE '' END || ' > Parágrafo' END END"""
#: The injected text again, the owners of merged spans, and what lies between their places.
_CHUNKS = f"""{_MERGED}, whole AS (SELECT id, string_agg(CASE WHEN i % 12 = 0 THEN 'TÍTULO ' || i || chr(10) ELSE '' END || CASE WHEN i % 4 = 0 THEN 'CAPÍTULO ' || i || chr(10) ELSE '' END || CASE WHEN i % 5 = 4 THEN 'PARÁGRAFO. ' ELSE 'ARTÍCULO ' || (i + 1) || '. ' END || line, chr(10) || chr(10) ORDER BY i) AS text FROM ll GROUP BY 1),
named AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, k) AS n, {_SECTION} AS section, {_ARTICLE} AS article_number, {_PATH} AS path FROM hd),
owner AS (SELECT id, part, arg_min(n, levels * 10000000 + n) AS n FROM mg GROUP BY 1, 2),
cut AS (SELECT f.id, f.n, f.start, substr(text, f.start::int + 1, (f."end" - f.start)::int) AS raw, section, article_number, path FROM fin f JOIN whole USING (id) JOIN owner o ON o.id = f.id AND o.part = f.n JOIN named m ON m.id = f.id AND m.n = o.n),
chunk AS (SELECT *, {strip_sql('raw')} AS content, length(raw) - length(regexp_replace(raw, '^{SPACE}+', '')) AS lead FROM cut)"""


@query("c4_emit_chunks", f"""WITH RECURSIVE {_CHUNKS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS chunk_index, section, article_number, path, md5(content) AS digest, start + lead AS char_start, start + lead + length(content) AS char_end, {_TOK.format('length(content)')}::int AS tokens FROM chunk WHERE content <> ''""")
def c4(spark, sf_dir):
    docs = legal(spark, sf_dir)
    return C.emit_chunks(docs, spans(spark, sf_dir, docs)).withColumn("digest", F.md5("content")).drop("content")


def bodies(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).alias("body")).where("body <> ''")


_BODIES = "SELECT doc_id AS id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"


def _units(size, overlap, bodies=_BODIES):
    """Units and greedy parts of (id, body), as the operator makes them."""
    again = f"greatest(f.first + 1, coalesce((SELECT max(j) FROM unnest(generate_series(f.first, u.i - 1)) t(j) WHERE list_sum(u.prior[j + 1:]) >= {overlap}), f.first))" if overlap > 0 else "u.i"
    return """bd AS MATERIALIZED (BODIES),
mk AS (SELECT id, string_split(regexp_replace(regexp_replace(body, '(\\n\\s*\\n)', chr(1) || '\\1' || chr(2), 'g'), '([.;:])(\\s+)([A-ZÁÉÍÓÚÑ0-9¿«"])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(2)) AS ps FROM bd),
us AS (SELECT id, unnest(generate_series(1, len(ps))) AS i, unnest(ps) AS p FROM mk),
uo AS (SELECT *, string_split(p, chr(1))[1] AS u, coalesce(sum(length(p) - contains(p, chr(1))::int) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM us),
un AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i, off, length(u) AS len, greatest(1, round_even(length(u) / 3.6::double, 0)) AS tok FROM uo WHERE regexp_replace(u, '\\s', '', 'g') <> ''),
uc AS (SELECT *, sum(tok) OVER (PARTITION BY id ORDER BY i) AS upto, list(tok) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM un),
fo AS (SELECT id, i, 0::bigint AS first, -1::bigint AS closed FROM uc WHERE i = 0 UNION ALL
 SELECT f.id, u.i, CASE WHEN list_sum(u.prior[f.first + 1:]) + u.tok > SIZE THEN AGAIN ELSE f.first END::bigint,
  CASE WHEN list_sum(u.prior[f.first + 1:]) + u.tok > SIZE THEN f.first ELSE -1 END::bigint FROM fo f JOIN uc u ON u.id = f.id AND u.i = f.i + 1),
pr AS MATERIALIZED (SELECT id, closed AS a, i - 1 AS b FROM fo WHERE closed >= 0 UNION ALL SELECT id, first, i FROM fo JOIN (SELECT id, max(i) AS i FROM uc GROUP BY 1) USING (id, i))""".replace("AGAIN", again).replace("SIZE", str(size)).replace("BODIES", bodies)


@query("c5_divide_sections", f"WITH RECURSIVE {_units(120, 25)} SELECT pr.id, row_number() OVER (PARTITION BY pr.id ORDER BY a, b) AS part, count(*) OVER (PARTITION BY pr.id) AS total, x.off AS char_start, y.off + y.len AS char_end FROM pr JOIN un x ON x.id = pr.id AND x.i = a JOIN un y ON y.id = pr.id AND y.i = b")
def c5(spark, sf_dir):
    return C.divide(bodies(spark, sf_dir), 120, 25).select("id", "part", "total", "char_start", "char_end")


@query("c6_unstructured", f"WITH RECURSIVE {_units(100, 0)} SELECT pr.id, row_number() OVER (PARTITION BY pr.id ORDER BY a, b) - 1 AS chunk_index, x.off AS char_start, y.off + y.len AS char_end FROM pr JOIN un x ON x.id = pr.id AND x.i = a JOIN un y ON y.id = pr.id AND y.i = b")
def c6(spark, sf_dir):
    return C.divide(bodies(spark, sf_dir), 100, 0).select("id", (F.col("part") - 1).alias("chunk_index"), "char_start", "char_end")


@query("c7_chunk_invariants", "SELECT doc_id AS id, 0 AS chunk_index, '' AS rule FROM documents WHERE false")
def c7(spark, sf_dir):
    docs = legal(spark, sf_dir)
    return C.chunk_invariants(docs, C.emit_chunks(docs, spans(spark, sf_dir, docs)))


@query("c9_article_number", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id::varchar WHEN doc_id % 4 < 3 THEN (doc_id % 50) || 'A' END AS article_number FROM documents")
def c9(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents"), "doc_id")
    section = F.expr("case doc_id % 4 when 1 then 'Capítulo 2 > ARTÍCULO ' || cast(doc_id % 50 as string) || 'A' when 2 then 'articulo  ' || cast(doc_id % 50 as string) || 'A. x' else 'Título 4' end")
    return d.select("doc_id", C.article_number(section, F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("string")).otherwise("")).alias("article_number"))


_HEADING = r"(?i)^((?:ART[IÍ]CULO|Art\.)\s+[0-9]+[A-Za-z\-]*\.?(?:\s+[^\n.]+)?(?:\.|\n))"
_ARTICLES = f"""art AS (SELECT id, i, id * 1000000 + i AS key, {strip_sql("'Artículo ' || (i + 1) || '.' || chr(10) || line")} AS content FROM ll),
sec AS (SELECT *, substr(regexp_replace(trim(regexp_extract(content, '{_HEADING}', 1)), '[.:\n]+$', ''), 1, 120) AS section FROM art)"""
_LONG = "SELECT key AS id, content AS body FROM art WHERE length(content) > 4000"


@query("c8_split_articles", f"""WITH RECURSIVE {_LINES}, {_ARTICLES}, {_units(1111, 0, _LONG)},
piece AS (SELECT pr.id AS key, row_number() OVER (PARTITION BY pr.id ORDER BY a, b) AS part, {strip_sql('substr(body, x.off::int + 1, (y.off + y.len - x.off)::int)')} AS piece FROM pr JOIN un x ON x.id = pr.id AND x.i = a JOIN un y ON y.id = pr.id AND y.i = b JOIN bd ON bd.id = pr.id)
SELECT s.id, coalesce(part, 1) AS part, section || CASE WHEN part IS NULL THEN '' ELSE ' (parte ' || part || ')' END AS section, (i + 1)::varchar AS article_number, 'TÍTULO ' || (i // 6 + 1) || CASE WHEN i % 6 >= 3 THEN ' > CAPÍTULO ' || (i // 3 + 1) ELSE '' END || ' > ' || section AS path, md5(coalesce(piece, content)) AS digest FROM sec s LEFT JOIN piece USING (key)""")
def c8(spark, sf_dir):
    """Every line as an article, under a title every sixth and a chapter every other third."""
    from lectern.operators.upload_chunking import split_articles

    docs = spread(load(spark, sf_dir, "documents"), "doc_id").where("text <> ''").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("lines"))
    head = lambda line, i: F.concat(
        F.when(i % 6 == 0, F.concat(F.lit("TÍTULO "), F.floor(i / 6 + 1).cast("string"), F.lit("\n"))).otherwise(""), F.when(i % 6 == 3, F.concat(F.lit("CAPÍTULO "), F.floor(i / 3 + 1).cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("Artículo "), (i + 1).cast("string"), F.lit(".\n"), line)
    text = F.concat(F.lit("preámbulo\n"), F.array_join(F.transform("lines", head), "\n"))
    return split_articles(docs.select("id", text.alias("text"))).select("id", "part", "section", "article_number", "path", F.md5("content").alias("digest"))
