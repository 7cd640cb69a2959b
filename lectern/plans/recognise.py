"""Pages and document recognition over whole tables; expected values come from the ids that made the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import recognition as G
from lectern.sources import html as H
from lectern.sources.tables import load

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: A header that names a law, decree, ruling, constitution, code or nothing, with date, issuer and court by id.
HEADER = """CASE doc_id % 6 WHEN 0 THEN 'LEY ' || n || ' DE ' || y WHEN 1 THEN 'DECRETO N° ' || n || ' DE ' || y WHEN 2 THEN 'SENTENCIA C-' || n || '/' || yy WHEN 3 THEN 'CONSTITUCIÓN POLÍTICA DE COLOMBIA' WHEN 4 THEN 'CÓDIGO CIVIL COLOMBIANO.' ELSE 'Notas varias' END
 || {nl} || CASE doc_id % 3 WHEN 0 THEN '5 de Marzo de ' || y WHEN 1 THEN CASE WHEN doc_id % 9 = 1 THEN '31/02/' ELSE '07/11/' END || y ELSE 'sin fecha' END
 || {nl} || CASE doc_id % 4 WHEN 0 THEN 'EL CONGRESO DE COLOMBIA' WHEN 1 THEN 'EL PRESIDENTE DE LA REPÚBLICA' WHEN 2 THEN 'MINISTERIO DE SALUD.' ELSE 'nadie' END
 || {nl} || CASE doc_id % 5 WHEN 0 THEN 'Corte Constitucional' WHEN 1 THEN 'CONSEJO DE ESTADO' WHEN 2 THEN 'tribunal superior' ELSE '' END"""
_PARTS = "doc_id, text, CAST(doc_id % 900 + 1 AS VARCHAR(9)) AS n, CAST(1990 + doc_id % 30 AS VARCHAR(9)) AS y, lpad(CAST(doc_id % 100 AS VARCHAR(9)), 2, '0') AS yy"
_P = f"p AS (SELECT {_PARTS} FROM documents)"


def headers(spark, sf_dir):
    return spark.sql(f"SELECT doc_id, n, y, yy, {HEADER.format(nl='chr(10)')} || chr(10) || 'x ' || coalesce(text, '') AS text FROM (SELECT {_PARTS} FROM {{d}}) p", d=load(spark, sf_dir, "documents"))


_YEAR = "CASE WHEN yy::int >= 92 THEN '19' ELSE '20' END || yy"


@query("b9_identify", f"WITH {_P} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'LEY' WHEN 1 THEN 'DECRETO' WHEN 2 THEN 'SENTENCIA' WHEN 3 THEN 'CONSTITUCION' WHEN 4 THEN 'CODIGO' ELSE 'OTRO' END AS type, CASE doc_id % 6 WHEN 0 THEN 'LEY_' || n || '_' || y WHEN 1 THEN 'DECRETO_' || n || '_' || y WHEN 2 THEN 'C-' || n || '-' || {_YEAR} WHEN 3 THEN 'CONSTITUCION_POLITICA_1991' END AS external_id, CASE doc_id % 6 WHEN 0 THEN 'Ley ' || n || ' de ' || y WHEN 1 THEN 'Decreto ' || n || ' de ' || y WHEN 2 THEN 'Sentencia C-' || n || ' de ' || {_YEAR} WHEN 3 THEN 'Constitución Política de Colombia' WHEN 4 THEN 'Código Civil Colombiano' END AS title FROM p")
def b9(spark, sf_dir):
    return headers(spark, sf_dir).select("doc_id", G.identify(F.col("text")).alias("i")).select("doc_id", "i.type", "i.external_id", "i.title")


@query("b10_full_year", f"WITH {_P} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN y ELSE {_YEAR} END AS year FROM p")
def b10(spark, sf_dir):
    return headers(spark, sf_dir).select("doc_id", G.full_year(F.when(F.col("doc_id") % 2 == 0, F.col("y")), F.col("yy")).alias("year"))


@query("b11_publication_date", f"WITH {_P} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN make_date(y::int, 3, 5) WHEN doc_id % 3 = 1 AND doc_id % 9 <> 1 THEN make_date(y::int, 11, 7) END AS published FROM p")
def b11(spark, sf_dir):
    return headers(spark, sf_dir).select("doc_id", G.publication_date(F.col("text")).alias("published"))


@query("b12_issuer", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Congreso de Colombia' WHEN 1 THEN 'Presidencia de la República' WHEN 2 THEN 'Ministerio De Salud' END AS issuer FROM documents")
def b12(spark, sf_dir):
    return headers(spark, sf_dir).select("doc_id", G.issuer(F.col("text")).alias("issuer"))


@query("b13_court", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CORTE_CONSTITUCIONAL' WHEN 1 THEN 'CONSEJO_ESTADO' WHEN 2 THEN 'TRIBUNAL_SUPERIOR' END AS court FROM documents")
def b13(spark, sf_dir):
    return headers(spark, sf_dir).select("doc_id", G.court(F.col("text")).alias("court"))


_AREA_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'el trabajador y su Salario por despido ' WHEN 1 THEN 'delito y salario ' WHEN 2 THEN 'pensión de invalidez del afiliado, divorcio ' ELSE '' END || coalesce(text, '')"
_AREA_SCORES = ", ".join("{'n': " + " + ".join(f"contains(low, '{t}')::int" for t in terms) + f", 'area': '{area}'}}" for area, terms in G.AREAS.items())


@query("b14_legal_area", f"WITH t AS (SELECT doc_id, lower(substr({_AREA_TEXT}, 1, 20000)) AS low FROM documents), s AS (SELECT doc_id, list_reverse_sort([{_AREA_SCORES}]) AS s FROM t) SELECT doc_id, CASE WHEN s[1].n >= 2 AND s[1].n > s[2].n THEN s[1].area END AS area FROM s")
def b14(spark, sf_dir):
    """The whole texts behind a sentence that names terms of one area, of two, or of none."""
    return load(spark, sf_dir, "documents").select("doc_id", G.legal_area(F.expr(_AREA_TEXT)).alias("area"))


_CLASS_TEXT = "coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' ACCIÓN DE TUTELA' WHEN 1 THEN ' un contrato civil' WHEN 2 THEN ' la sentencia penal' WHEN 3 THEN ' recurso de queja laboral' ELSE '' END"


@query("b16_document_class", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Acción de Tutela' WHEN 1 THEN 'Contrato / Minuta' WHEN 2 THEN 'Providencia / Sentencia Judicial' WHEN 3 THEN 'Recurso Procesal' ELSE 'Documento Jurídico General' END AS class FROM documents")
def b16(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", G.doc_class(F.expr(_CLASS_TEXT)).alias("class"))


@query("b17_jurisdiction_class", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Jurisdicción Constitucional' WHEN 1 THEN 'Jurisdicción Civil y Comercial' WHEN 2 THEN 'Jurisdicción Penal' WHEN 3 THEN 'Jurisdicción Laboral y Seguridad Social' ELSE 'Jurisdicción Ordinaria (Colombia)' END AS class FROM documents")
def b17(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", G.jurisdiction_class(F.expr(_CLASS_TEXT)).alias("class"))


_CASE_TEXT = "'Radicado No. 2024-' || lpad(CAST(doc_id AS VARCHAR(9)), 6, '0') || chr(10) || 'Demandante: Ana ' || CASE doc_id % 2 WHEN 0 THEN 'Ruiz' ELSE 'Pardo' END || ', ' || CASE WHEN doc_id % 3 = 0 THEN 'Demandada: Empresa Uno;' ELSE '' END || chr(10) || CAST(doc_id AS VARCHAR(9)) || chr(10) || coalesce(text, '')"


@query("b18_case_fields", "SELECT doc_id, '2024-' || lpad(doc_id::varchar, 6, '0') AS case_number, CASE doc_id % 2 WHEN 0 THEN 'Ana Ruiz' ELSE 'Ana Pardo' END AS claimant, CASE WHEN doc_id % 3 = 0 THEN 'Empresa Uno' END AS defendant FROM documents")
def b18(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", G.case_fields(F.expr(_CASE_TEXT)).alias("c")).select("doc_id", "c.*")


_CLAUSE_TEXT = "'Cláusula primera: ' || coalesce(text, '') || chr(10) || 'HECHO dos. corto' || chr(10) || 'artículo tercero- el pago será puntual' || chr(10) || coalesce(text, '') || chr(10) || 'Pretensión CUARTA parte: ' || coalesce(text, '')"
_CLAUSE = "(?im)^\\s*(?:cl[aá]usula|art[ií]culo|hecho|pretensi[oó]n)\\s+([^\\n:.]{1,40})[:.\\-]\\s*([^\\n]+)"
_TITLE = "list_aggregate(list_transform(string_split(trim({x}.t), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')".format(x="x")


@query("b19_key_clauses", f"""WITH d AS (SELECT doc_id, {_CLAUSE_TEXT} AS t FROM documents), z AS (SELECT doc_id, list_transform(list_zip(regexp_extract_all(t, '{_CLAUSE}', 1), regexp_extract_all(t, '{_CLAUSE}', 2))[1:5], lambda x: {{'t': x[1], 's': x[2]}}) AS z FROM d)
SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(z, lambda x: length(trim(x.s)) > 10), lambda x: {_TITLE} || '=' || substr(trim(x.s), 1, 140) || CASE WHEN length(x.s) > 140 THEN '...' ELSE '' END), ';'), '') AS clauses FROM z""")
def b19(spark, sf_dir):
    """The whole texts under, between and behind clauses."""
    c = F.array_join(F.transform(G.key_clauses(F.expr(_CLAUSE_TEXT)), lambda x: F.concat(x.title, F.lit("="), x.summary)), ";")
    return load(spark, sf_dir, "documents").select("doc_id", c.alias("clauses"))


# ---- pages ------------------------------------------------------------------------


def _lines(x):
    for a, b in H.ENTITIES:
        b = {" ": "chr(160)", "'": "chr(39)"}.get(b, f"'{b}'")
        x = f"replace({x}, '{a}', {b})" if a != "&nbsp;" else f"replace({x}, '{a}', ' ')"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda l: l <> ''), chr(10))"


_DROP = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in H.DROPPED:
    _DROP = f"regexp_replace({_DROP}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_ARTICLE = _lines("regexp_replace(regexp_extract(h, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1), '(?s)<[^>]*>', chr(10), 'g')")
_WHOLE = _lines("regexp_replace(h, '(?s)<[^>]*>', chr(10), 'g')")
_BODY = _lines("regexp_replace(regexp_extract(h, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1), '(?s)<[^>]*>', chr(10), 'g')")


@query("a5_extract_html", f"WITH d AS (SELECT page_id, {_DROP} AS h FROM pages), t AS (SELECT page_id, coalesce({_ARTICLE}, '') AS a, CASE WHEN regexp_extract(h, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1) <> '' THEN coalesce({_BODY}, '') ELSE coalesce({_WHOLE}, '') END AS b, CASE WHEN regexp_extract(h, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1) <> '' THEN 'body' ELSE 'document' END AS rest FROM d) SELECT page_id, CASE WHEN length(replace(a, chr(10), '')) > 200 THEN a ELSE b END AS text, CASE WHEN length(replace(a, chr(10), '')) > 200 THEN 'article' ELSE rest END AS selector FROM t")
def a5(spark, sf_dir):
    return H.extract_html(load(spark, sf_dir, "pages"))


@query("a6_html_title", "WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS b FROM pages), u AS (SELECT page_id, replace(replace(a, '&quot;', '\"'), '&amp;', '&') AS a, replace(replace(b, '&quot;', '\"'), '&amp;', '&') AS b FROM t) SELECT page_id, CASE WHEN length(a) BETWEEN 10 AND 512 THEN a WHEN length(b) BETWEEN 10 AND 512 THEN b END AS title FROM u")
def a6(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", H.html_title(F.col("html")).alias("title"))


@query("a7_canonical", "SELECT page_id, CASE WHEN page_id % 6 IN (0, 2, 3) THEN 'http://canon.example/' || page_id WHEN page_id % 6 = 1 THEN 'http://og.example/' || page_id WHEN page_id % 6 = 4 THEN 'https://og.example/' || page_id END AS canonical FROM pages")
def a7(spark, sf_dir):
    """Attributes in either order, bare and in either quotes, addresses that are no http ones, and a later link that doesn't count."""
    shapes = (
        '<link rel="canonical" href="http://canon.example/@">', '<meta property="og:url" content="http://og.example/@">', "<link href='http://canon.example/@' class=x rel='canonical'>",
        '<LINK REL=canonical HREF=http://canon.example/@><meta content="http://og.example/1" property="og:url">',
        '<link rel="canonical" href="/local"><link rel="canonical" href="http://second.example/"><meta content="https://og.example/@" property="og:url">', '<link rel="alternate" href="http://no.example/"><link rel="canonical">',
    )
    shape = F.get(F.array(*map(F.lit, shapes)), (F.col("page_id") % 6).cast("int"))
    tag = F.replace(shape, F.lit("@"), F.col("page_id").cast("string"))
    marked = F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), tag))
    return load(spark, sf_dir, "pages").select("page_id", H.html_canonical(marked).alias("canonical"))


_RECORD = "'<main><div>Fecha de Expedición: 0' || (page_id % 9 + 1) || '/03/2001<br>' || CASE WHEN page_id % 2 = 0 THEN 'Fecha de Entrada en Vigencia: 01/01/2002<br>' ELSE '' END || 'Medio de Publicación: Diario ' || page_id || '</div><ul><li>Tema <b>' || page_id || '</b></li><li>Concepto x</li><li>abc</li></ul><div>' || CASE WHEN page_id % 5 = 3 THEN '' ELSE '" + H.DISCLAIMER + "' END || ' Nota<br>Texto ' || page_id || '</div></main>' || coalesce(html, '')"
_FIELD = "nullif(trim(regexp_extract(t, '(?m)^{}(.*)$', 1)), '')"
_TOPICS = "list_filter(list_transform(regexp_extract_all(h, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: length(x) > 3 AND NOT regexp_matches(lower(x), '" + "|".join(H.NO_TOPIC) + "'))"


@query("a10_portal_fields", f"WITH h AS (SELECT page_id, {_RECORD} AS h FROM pages), t AS (SELECT page_id, h, {_WHOLE} AS t FROM h), i AS (SELECT *, instr(t, '{H.DISCLAIMER}') AS i FROM t) SELECT page_id, {', '.join(_FIELD.format(label) + ' AS ' + name for name, label in H.LABELS.items())}, {_TOPICS} AS topics, CASE WHEN i > 0 THEN regexp_replace(substr(t, i + {len(H.DISCLAIMER)}), '^[^\n]*\n', '') ELSE t END AS text FROM i")
def a10(spark, sf_dir):
    """Whole pages behind a record, some of them without its disclaimer."""
    return H.portal_fields(load(spark, sf_dir, "pages").select("page_id", F.expr(_RECORD).alias("html")))


@query("a11_article_rows", "SELECT page_id, page_id % 13 + 1 AS title, k AS position, 'Artículo ' || k AS number, 'Texto ' || k || ' de ' || page_id AS text FROM (SELECT page_id, unnest(generate_series(0, page_id % 4)) AS k FROM pages)")
def a11(spark, sf_dir):
    """Articles after the page's own markup, then headings that are none."""
    one = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int")), lambda k: F.concat(F.lit("<h3 class='t'><a href='#'>Artículo "), k.cast("string"), F.lit("</a></h3>\n<div class='texto'><p>Texto "), k.cast("string"), F.lit(" de "), F.col("page_id").cast("string"), F.lit("</p></div>")))
    decoys = F.lit("<h3><a>Norma 1</a></h3><div class='texto'>x</div><h3>Artículo 9</h3><div class='texto'>y</div>")
    return H.article_rows(load(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 13 + 1).alias("title"), F.concat("html", F.array_join(one, "\n"), decoys).alias("html")))


@query("a11_uploaded_articles", "SELECT page_id, k AS position, 'Artículo ' || k AS number, 'Texto ' || k || ' de ' || page_id AS text FROM (SELECT page_id, unnest(generate_series(0, least(page_id % 60, 49))) AS k FROM pages) WHERE k % 7 <> 5")
def a11_uploaded(spark, sf_dir):
    """Pages of up to 60 blocks, every seventh without a number."""
    block = lambda k: F.concat(F.lit("<div class='articulo'>"), F.when(k % 7 != 5, F.concat(F.lit("<span class='numero'>Artículo "), k.cast("string"), F.lit("</span>"))).otherwise(""), F.lit("<div class='texto'>Texto "), k.cast("string"), F.lit(" de "), F.col("page_id").cast("string"), F.lit("</div></div>"))
    blocks = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 60).cast("int")), block), "\n")
    return H.uploaded_articles(load(spark, sf_dir, "pages").select("page_id", F.concat("html", blocks).alias("html")))
