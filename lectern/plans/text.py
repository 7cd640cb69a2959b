"""Text preparation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.tables import load, spread

from .views import cte, view

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: Texts with the noise that scans and word processors leave, at places fixed by the id.
NOISY = """noisy AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(replace(text, ' of ', '\u00a0' || 'of' || '\u202f'), '. ', '\u2026' || ' ')
 WHEN 1 THEN replace(replace(text, 'th', 't' || '\u00ad' || 'h'), ', ', ' ' || '\u2014' || ' ') WHEN 2 THEN replace(replace(replace(text, ' the ', '-' || chr(10) || 'the '), ' de ', chr(13) || chr(10) || 'de '), ' der ', chr(10) || 'Página 3 de 47' || chr(10) || chr(10) || chr(10) || '---' || chr(10))
 WHEN 3 THEN replace(replace(text, 'e ', 'e' || '\u0301' || ' '), ' la ', ' ' || '\u201c' || 'la' || '\u201d' || chr(9)) ELSE text || chr(10) || '12' || chr(10) || 'Diario Oficial No. 40.123' || chr(10) || chr(10) || chr(10) || 'Imprimir' END AS text FROM documents)"""


def noisy(spark, sf_dir):
    return spark.sql(f"WITH {NOISY.replace('FROM documents', 'FROM {documents}')} SELECT * FROM noisy", documents=spread(load(spark, sf_dir, "documents"), "doc_id"))




def _fold(x):
    three = "   " + "''" * 3 + '""' + "---" + " "
    return f"replace(translate(nfc_normalize({x}), chr(160)||chr(8201)||chr(8239)||chr(8216)||chr(8217)||chr(8218)||chr(8220)||chr(8221)||chr(8211)||chr(8212)||chr(8213)||chr(9)||chr(8203)||chr(8204)||chr(8205)||chr(65279)||chr(173), '{three}'), chr(8230), '...')"


#: Unicode white space as the functions strip it.
SPACE = "[\\s\\x{85}\\x{1c}-\\x{1f}\\pZ]"


def strip_sql(x):
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


@query("b1_fold_confusables", f"WITH {NOISY} SELECT doc_id, md5({_fold('text')}) AS digest, length({_fold('text')}) AS n FROM noisy")
def b1(spark, sf_dir):
    folded = T.fold_confusables(F.col("text"))
    return noisy(spark, sf_dir).select("doc_id", F.md5(folded).alias("digest"), F.length(folded).alias("n"))


@query("b2_normalize_query", f"WITH {NOISY} SELECT doc_id, md5({strip_sql('regexp_replace(replace(' + _fold('text') + ', chr(10), chr(32)), chr(32) || chr(123) || chr(50) || chr(44) || chr(125), chr(32), chr(103))')}) AS digest FROM noisy")
def b2(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(T.normalize_query(F.col("text"))).alias("digest"))


_LOW = "a-záéíóúñü"
_FURNITURE = r"(?i)^(p[áa]g(?:ina|\.)?\s*\d+(?:\s*(?:de|/)\s*\d+)?|-+\s*\d+\s*-+|\d{1,4}|diario\s+oficial(?:\s+n[oº°.]?\s*[\d.]+)?.*|gaceta\s+(?:oficial|del\s+congreso).*|imprimir|compartir|descargar|volver|inicio|[^\pL\pN]{3,})$"
CLEANED = f"""{NOISY}, folded AS (SELECT doc_id, text, replace(replace({_fold('text')}, chr(13)||chr(10), chr(10)), chr(13), chr(10)) AS f FROM noisy),
h AS (SELECT *, regexp_replace(regexp_replace(f, '([{_LOW}])-\\n([{_LOW}])', '\\1\\2', 'g'), '([{_LOW}])-\\n([{_LOW}])', '\\1\\2', 'g') AS j FROM folded),
w AS (SELECT *, regexp_replace(regexp_replace(j, '([{_LOW},;])\\n([{_LOW}])', '\\1 \\2', 'g'), '([{_LOW},;])\\n([{_LOW}])', '\\1 \\2', 'g') AS k FROM h),
l AS (SELECT *, list_transform(string_split(k, chr(10)), lambda x: {strip_sql('x')}) AS lines FROM w),
c AS (SELECT *, list_filter(lines, lambda x: NOT regexp_matches(x, '{_FURNITURE}')) AS kept FROM l),
cleaned AS (SELECT doc_id, {strip_sql("regexp_replace(regexp_replace(coalesce(array_to_string(kept, chr(10)), ''), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10)||chr(10), 'g')")} AS text,
  length(text) AS original_length, len(lines) - len(kept) AS dropped, length(f) - length(j) AS two_each FROM c)"""


@query("b3_clean_text", f"WITH {CLEANED} SELECT doc_id, md5(text) AS digest, original_length, length(text) AS cleaned_length, dropped, two_each // 2 AS rejoined FROM cleaned")
def b3(spark, sf_dir):
    c = noisy(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("c"))
    return c.select("doc_id", F.md5("c.text").alias("digest"), "c.original_length", "c.cleaned_length", "c.dropped", "c.rejoined")


@query("b4_removal_warning", f"WITH {CLEANED} SELECT doc_id, round(CASE WHEN original_length = 0 THEN 0 ELSE 1 - length(text)::double / original_length END, 6) AS removed_ratio FROM cleaned WHERE CASE WHEN original_length = 0 THEN 0 ELSE 1 - length(text)::double / original_length END > 0.02")
def b4(spark, sf_dir):
    c = noisy(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("c"))
    ratio = T.removed_ratio(F.col("c.original_length"), F.col("c.cleaned_length"))
    return c.withColumn("removed_ratio", ratio).where("removed_ratio > 0.02").select("doc_id", F.round("removed_ratio", 6).alias("removed_ratio"))


@query("b5_clean_markdown", f"WITH {NOISY} SELECT doc_id, md5({strip_sql('''regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10)||chr(10), 'g'), '(?im)^\\s*p[aá]gina\\s+\\d+\\s+(?:de\\s+\\d+)?\\s*$', '', 'g'), '(?im)^\\s*folio\\s+\\d+\\s*$', '', 'g')''')}) AS digest FROM noisy")
def b5(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(T.clean_markdown(F.col("text"))).alias("digest"))


@query("b6_estimate_tokens", "SELECT doc_id, CAST(greatest(1, round_even(length(text) / 3.6::double, 0)) AS INT) AS tokens FROM documents")
def b6(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("b7_other_estimates", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 3.8::double) AS INT)) END AS upload, greatest(1, length(text) // 4) AS by_four, CAST(ceil(length(text) / 4) AS INT) AS client FROM documents")
def b7(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens_upload(t).alias("upload"), T.estimate_tokens_floor4(t).alias("by_four"), T.estimate_tokens_ceil4(t).alias("client"))


@query("b8_parse_statistics", "WITH t AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 3.8::double) AS INT)) END AS est, strlen(text) AS size, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM documents) SELECT doc_id, est + greatest(50, size // 20) AS raw_tokens, est AS tokens, round((greatest(50, size // 20)) / (est + greatest(50, size // 20))::double * 100, 1) AS reduction, words, chars FROM t")
def b8(spark, sf_dir):
    est = T.estimate_tokens_upload(F.col("text"))
    extra = F.greatest(F.lit(50), F.floor(F.octet_length("text") / 20).cast("int"))
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    return load(spark, sf_dir, "documents").select("doc_id", (est + extra).alias("raw_tokens"), est.alias("tokens"), F.round(extra / (est + extra) * 100, 1).alias("reduction"), words.alias("words"), F.length("text").alias("chars"))


@query("b20_conversational", """WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Hola, ' || text WHEN 1 THEN '¿Quién eres? ' || text WHEN 2 THEN 'BUENAS noches!' ELSE text END AS q FROM conversations),
n AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(q)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM t)
SELECT conv_id, turn, s = '' OR s IN ('hola','buenas','buenos dias','buenas tardes','buenas noches','saludos','hey','hi','hello','gracias','ayuda','quien eres','que tal') OR (len(string_split(s, ' ')) <= 5 AND regexp_matches(s, '^(hola|buenas|saludos|buenos dias|hey|hi|hello)')) OR (len(string_split(s, ' ')) <= 6 AND (contains(s, 'quien eres') OR contains(s, 'que puedes hacer') OR contains(s, 'como funcionas') OR contains(s, 'como me ayudas') OR contains(s, 'en que me puedes ayudar'))) AS conversational FROM n""")
def b20(spark, sf_dir):
    q = F.expr("CASE turn % 4 WHEN 0 THEN 'Hola, ' || text WHEN 1 THEN '¿Quién eres? ' || text WHEN 2 THEN 'BUENAS noches!' ELSE text END")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_conversational(q).alias("conversational"))


#: Whole turns, some after the mode's mark or its lower-case double, some with a phrase in mixed case or cut in two.
ASKING = """CASE turn % 7 WHEN 0 THEN '[MODO: BÚSQUEDA WEB] ' || text WHEN 1 THEN '[modo: búsqueda web] ' || text WHEN 2 THEN text || ' Buscar en INTERNET?' WHEN 3 THEN text || ' buscar  en internet' WHEN 4 THEN 'NOTICIAS: ' || text WHEN 5 THEN text || ' internet' ELSE text END"""


@query("b21_web_search_intent", f"WITH t AS (SELECT conv_id, turn, {ASKING} AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, contains(q, '[MODO: BÚSQUEDA WEB') OR contains(lower(q), 'buscar en internet') OR contains(lower(q), 'noticias') AS wants_web FROM t")
def b21(spark, sf_dir):
    return load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.wants_web(F.expr(ASKING)).alias("wants_web"))


@query("b22_clean_search_query", """WITH t AS (SELECT conv_id, turn, '[MODO: x]  Consulta del litigante: ' || CASE WHEN turn % 3 = 0 AND length(text) < 40 THEN 'ab' ELSE text END AS q FROM conversations),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '\\[[^\\]]+\\]', '', 'g'), '(?i)Consulta del litigante:\\s*', '', 'g'), '(?i)Analiza este documento[^\\n]*', '', 'g'), '\\s+', ' ', 'g')) AS d FROM t)
SELECT conv_id, turn, md5(CASE WHEN length(d) >= 3 THEN d ELSE trim(q, ' ' || chr(10)) END) AS digest FROM c""")
def b22(spark, sf_dir):
    q = F.expr("'[MODO: x]  Consulta del litigante: ' || CASE WHEN turn % 3 = 0 AND length(text) < 40 THEN 'ab' ELSE text END")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.clean_search_query(q)).alias("digest"))


@query("b23_domain", "SELECT page_id, CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = '' THEN 'web' ELSE replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') END AS domain FROM pages")
def b23(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query("b24_citation_markers", "SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(replace(replace(text, ' th', ' [1] th'), ' de', ' [12][3] de'), '\\[(\\d{1,9})\\]', 1), lambda x: x::int))) AS markers FROM documents")
def b24(spark, sf_dir):
    t = F.expr("replace(replace(text, ' th', ' [1] th'), ' de', ' [12][3] de')")
    return load(spark, sf_dir, "documents").select("doc_id", T.citation_markers(t).alias("markers"))


MINED = """CASE message_id % 4 WHEN 0 THEN answer || ' see [Ruling of the court](https://www.corte.gov.co/r/' || CAST(message_id % 5 AS VARCHAR(3)) || ') and https://x.org/a, https://X.org/a'
 WHEN 1 THEN answer || ' per Sentencia C-355/06, sentencia T-760 de 2008 and Sentencia C-355/06' WHEN 2 THEN '[abc](http://blog.io/p) [Other title](http://blog.io/p)' ELSE answer END"""


@query("b25_mine_sources", cte("cited") + f""", m AS (SELECT message_id, {MINED} AS t FROM cited),
links AS (SELECT message_id, 0 AS kind, unnest(generate_series(1, len(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^\\s\\)]+)\\)')))) AS pos, unnest(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^\\s\\)]+)\\)', 1)) AS title, unnest(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^\\s\\)]+)\\)', 2)) AS url FROM m),
raws AS (SELECT message_id, 1 AS kind, unnest(generate_series(1, len(regexp_extract_all(t, 'https?://[^\\s\\)\\],<]+')))) AS pos, NULL AS title, unnest(regexp_extract_all(t, 'https?://[^\\s\\)\\],<]+')) AS url FROM m),
rulings AS (SELECT message_id, 2 AS kind, unnest(generate_series(1, len(regexp_extract_all(t, '(?i)\\bSentencia\\s+(?:C|SU|T|SL|SC|SP|STC|STL)-[0-9]{{2,4}}\\s*(?:/|\\s*de\\s*)[0-9]{{2,4}}\\b')))) AS pos, unnest(regexp_extract_all(t, '(?i)\\bSentencia\\s+(?:C|SU|T|SL|SC|SP|STC|STL)-[0-9]{{2,4}}\\s*(?:/|\\s*de\\s*)[0-9]{{2,4}}\\b')) AS title, NULL AS url FROM m WHERE NOT regexp_matches(t, 'https?://[^\\s\\)\\],<]')),
u AS (SELECT * FROM links UNION ALL SELECT * FROM raws UNION ALL SELECT * FROM rulings),
k AS (SELECT *, lower(coalesce(url, title)) AS key, row_number() OVER (PARTITION BY message_id, lower(coalesce(url, title)) ORDER BY kind, pos) AS rn FROM u),
d AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY kind, pos) AS n FROM k WHERE rn = 1),
f AS (SELECT *, CASE WHEN kind = 2 THEN 'corteconstitucional.gov.co' ELSE replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', '') END AS dom FROM d WHERE n <= CASE WHEN kind = 2 THEN 4 ELSE 6 END)
SELECT message_id, n, CASE WHEN kind = 0 AND length(trim(title)) > 5 OR kind = 2 THEN trim(title) ELSE dom END AS title, key, dom AS domain, CASE WHEN kind = 2 OR kind = 0 AND (contains(dom, 'corte') OR contains(dom, 'suin') OR contains(dom, 'ramajudicial')) THEN 'court' ELSE 'web' END AS class FROM f""")
def b25(spark, sf_dir):
    from lectern.operators.citations import mine_sources

    return mine_sources(view(spark, sf_dir, "cited").select("message_id", F.expr(MINED).alias("text")))


@query("b29_redact", "SELECT event_id, 'k=' || (props::json->>'k') || ';TOKEN=[redacted];Query=[redacted]' AS flat FROM events")
def b29(spark, sf_dir):
    js = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "TOKEN": "abc", "Query": "q"}'))
    m = T.redact(js)
    flat = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return load(spark, sf_dir, "events").select("event_id", flat.alias("flat"))


@query("b32_thread_key", "SELECT conv_id, coalesce(CASE WHEN conv_id % 3 = 0 THEN 'ext-' || conv_id END, 'q:' || substr(sha256(trim(arg_min(text, turn), ' ' || chr(10))), 1, 32)) AS thread_key FROM conversations WHERE role = 'user' GROUP BY conv_id")
def b32(spark, sf_dir):
    first = load(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    external = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("ext-"), F.col("conv_id")))
    return first.select("conv_id", T.thread_key(external, F.col("q")).alias("thread_key"))
