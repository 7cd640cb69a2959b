"""Derived tables: the same definition for Spark and, as a common table expression, for DuckDB.

They give the driver's tables the columns that corpus, retrieval and telemetry operators read, from ids alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.tables import load, spread

TYPES = ("LEY", "DECRETO", "SENTENCIA", "AUTO", "CODIGO", "OTRO")
STATUSES = ("VIGENTE", "DEROGADO", "MODIFICADO", "INEXEQUIBLE", "DESCONOCIDO", "VIGENTE")


def _case(expr: str, values: tuple[str, ...]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: name -> (base tables, SQL that both engines run).
SQL = {
    "corpus": f"""SELECT doc_id AS document_id, 'Documento ' || CAST(doc_id % 97 AS VARCHAR(10)) || ' ' || lang AS title, {_case('doc_id % 6', TYPES)} AS document_type,
  CASE WHEN doc_id % 11 = 3 THEN NULL ELSE 'ext-' || CAST(doc_id % 400 AS VARCHAR(10)) END AS external_id, lang AS jurisdiction, source AS source_name,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {_case('doc_id % 5', ('CIVIL', 'PENAL', 'LABORAL', 'TRIBUTARIO', 'CIVIL'))} END AS legal_area,
  {_case('doc_id % 6', STATUSES)} AS status, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE DATE '2001-01-01' + CAST(doc_id % 7000 AS INT) END AS publication_date,
  CASE WHEN doc_id % 8 = 5 THEN 'old/model-64' ELSE 'hash/words-64' END AS embedding_model, CASE WHEN doc_id % 10 = 0 THEN 'http://norma.example/' || CAST(doc_id AS VARCHAR(12)) END AS source_url, text, n_chars FROM documents""",
    "pieces": """SELECT doc_id * 100000 + CAST(pos AS BIGINT) AS chunk_id, doc_id AS document_id, CAST(pos AS INT) AS chunk_index, content FROM (SELECT doc_id, pos, content FROM piece_lines) x WHERE trim(content) <> ''""",
    "usage": f"""SELECT 'r' || CAST(event_id AS VARCHAR(12)) AS request_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE user_id END AS user_id, event_type AS endpoint,
  CASE WHEN event_id % 3 = 0 THEN 'large' ELSE 'small' END AS model, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(abs(value) * 100) AS BIGINT) END AS input_tokens,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 700 END AS output_tokens, CASE WHEN event_id % 2 = 0 THEN 'checker' END AS verifier_model,
  CASE WHEN event_id % 2 = 0 THEN event_id % 90 END AS verifier_input_tokens, CASE WHEN event_id % 2 = 0 THEN event_id % 9 END AS verifier_output_tokens,
  event_type = 'error' AS refused, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 1 THEN 429 ELSE 200 END AS status_code,
  CASE WHEN event_type = 'error' THEN {_case('event_id % 3', ('Timeout', 'Provider', 'Parse'))} END AS error_type, event_id % 900 AS latency_ms,
  event_id % 40 AS embedding_latency_ms, event_id % 120 AS retrieval_latency_ms, event_id % 60 AS rerank_latency_ms, event_id % 600 AS llm_latency_ms, event_id % 80 AS verification_latency_ms,
  ts AS created_at, {_case('event_id % 4', ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'NOT_VERIFIED'))} AS verification_status FROM events""",
    "relations": f"""SELECT doc_id AS source_id, doc_id + 7 AS target_id, {_case('doc_id % 6', ('DEROGA', 'MODIFICA', 'DECLARA_INEXEQUIBLE', 'CITA', 'REGLAMENTA', 'DEROGA'))} AS relation_type,
  CASE WHEN doc_id % 4 = 0 THEN 'Artículo ' || CAST(doc_id % 30 AS VARCHAR(10)) END AS affected_section, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE DATE '2010-01-01' + CAST(doc_id % 5000 AS INT) END AS effective_date FROM documents""",
    "cited": """SELECT conv_id * 1000 + turn AS message_id, (conv_id * 37 + turn * 11) % 1000 AS document_id, CAST(turn % 4 + 1 AS INT) AS position, text AS answer, role FROM conversations WHERE role = 'assistant'""",
    "employment": f"""SELECT o_orderkey AS emp_id, CAST(o_orderdate AS DATE) AS start_date, CAST(max(l_shipdate) AS DATE) AS end_date, CAST(max(o_totalprice) * 10 AS DECIMAL(18,2)) AS base_salary,
  {_case('o_orderkey % 4', ('SIN_JUSTA_CAUSA', 'RENUNCIA', 'JUSTA_CAUSA', 'SIN_JUSTA_CAUSA'))} AS reason, {_case('o_orderkey % 3', ('INDEFINIDO', 'FIJO', 'OBRA'))} AS contract_type,
  CAST(o_orderkey % 20 AS INT) AS vacation_days_taken, o_orderkey % 2 = 0 AS transport FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""",
}
#: What differs between the engines: lines of a text with their places.
LINES = {
    "spark": "piece_lines AS (SELECT doc_id, pos, content FROM documents LATERAL VIEW posexplode(split(text, '\\n')) l AS pos, content)",
    "duckdb": "piece_lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos, unnest(string_split(text, chr(10))) AS content FROM documents)",
}
_TABLES = ("documents", "events", "conversations", "orders", "lineitem")


def cte(*names: str) -> str:
    """The views as the start of a DuckDB query."""
    parts = ([LINES["duckdb"]] if "pieces" in names else []) + [f"{n} AS ({SQL[n]})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame, planned over the tables it reads."""
    text = f"WITH {LINES['spark']} {SQL[name]}" if name == "pieces" else SQL[name]
    used = [t for t in _TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    tables = {t: load(spark, sf_dir, t) for t in used}
    if name == "pieces":
        tables["documents"] = spread(tables["documents"].select("doc_id", "text"), "doc_id")
    return spark.sql(text, **tables)
