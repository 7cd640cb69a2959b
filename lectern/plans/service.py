"""Telemetry, conversations and the settlement job over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import settlement, telemetry, threads
from lectern.sources.tables import load, stored

from .views import cte, view

QUERIES, ORACLE = {}, {}
NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def usage(spark, sf_dir):
    return view(spark, sf_dir, "usage")


_TOTAL = "coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(verifier_input_tokens, 0) + coalesce(verifier_output_tokens, 0)"


def _quota(where):
    return cte("usage") + f""", a AS (SELECT coalesce(sum(input_tokens), 0) + coalesce(sum(verifier_input_tokens), 0) AS prompt_tokens, coalesce(sum(output_tokens), 0) + coalesce(sum(verifier_output_tokens), 0) AS completion_tokens, count(*) AS request_count FROM usage WHERE created_at >= date_trunc('month', {NOW}) {where})
SELECT *, prompt_tokens + completion_tokens AS used_tokens, greatest(0, 15000000 - prompt_tokens - completion_tokens) AS remaining_tokens, round(greatest(0, 15000000 - prompt_tokens - completion_tokens) / 15000000.0::double * 100, 1) AS remaining_percent, 12 AS days_remaining, greatest(0, 1000 - request_count) AS requests_remaining FROM a"""


@query("g1_token_quota", _quota(""))
def g1(spark, sf_dir):
    return telemetry.token_quota(usage(spark, sf_dir), F.expr(NOW))


@query("g1_token_quota_user", _quota("AND user_id = 7"))
def g1_user(spark, sf_dir):
    return telemetry.token_quota(usage(spark, sf_dir), F.expr(NOW), user=7)


@query("g2_total_tokens", cte("usage") + f" SELECT request_id, {_TOTAL} AS total_tokens FROM usage")
def g2(spark, sf_dir):
    return usage(spark, sf_dir).select("request_id", telemetry.total_tokens().alias("total_tokens"))


@query("g3_user_usage", cte("usage") + f" SELECT user_id, created_at::date AS day, count(*) AS requests, sum({_TOTAL}) AS tokens FROM usage WHERE created_at >= '2024-01-05' AND created_at < '2024-01-15' GROUP BY 1, 2")
def g3(spark, sf_dir):
    return telemetry.user_usage(usage(spark, sf_dir), "2024-01-05", "2024-01-15")


@query("g4_refusal_rate", cte("usage") + " SELECT created_at::date AS day, count(*) AS requests, round(avg(refused::int), 6) AS refusal_rate FROM usage GROUP BY 1")
def g4(spark, sf_dir):
    return telemetry.refusal_rate(usage(spark, sf_dir))


@query("g5_latency_breakdown", cte("usage") + """, s AS (UNPIVOT (SELECT embedding_latency_ms AS embedding, retrieval_latency_ms AS retrieval, rerank_latency_ms AS rerank, llm_latency_ms AS llm, verification_latency_ms AS verification FROM usage) ON embedding, retrieval, rerank, llm, verification INTO NAME stage VALUE ms)
SELECT stage, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, round(sum(ms) / (SELECT sum(ms) FROM s), 6) AS share FROM s GROUP BY 1""")
def g5(spark, sf_dir):
    return telemetry.latency_breakdown(usage(spark, sf_dir))


_STAGE_ROWS = "s AS (UNPIVOT (SELECT embedding_latency_ms AS embedding, retrieval_latency_ms AS retrieval, rerank_latency_ms AS rerank, llm_latency_ms AS llm, verification_latency_ms AS verification FROM usage) ON embedding, retrieval, rerank, llm, verification INTO NAME stage VALUE ms)"


@query("g5_latency_sketches", cte("usage") + f", {_STAGE_ROWS} SELECT stage, count(*) AS n, round(avg(ms), 6) AS mean, round(sum(ms) / (SELECT sum(ms) FROM s), 6) AS share, true AS median_near, true AS p95_near FROM s GROUP BY 1")
def g5_sketches(spark, sf_dir):
    """Each day sketched and stored by itself, all days merged; and whether the exact ranks of the quantiles read lie within 0.02."""
    logs = usage(spark, sf_dir)
    days = stored(telemetry.latency_sketches(logs), "latency-days")
    got = telemetry.latency_from_sketches(days)
    below = telemetry.stage_rows(logs).join(F.broadcast(got.select("stage", "median", "p95")), "stage").groupBy("stage")  # five rows
    near = lambda c, rank: ((F.avg((F.col("ms") < F.col(c)).cast("int")) <= rank + 0.02) & (F.avg((F.col("ms") <= F.col(c)).cast("int")) >= rank - 0.02)).alias(f"{c}_near")
    return got.join(below.agg(near("median", 0.5), near("p95", 0.95)), "stage").select("stage", "n", "mean", "share", "median_near", "p95_near")


@query("g6_model_cost", cte("usage") + """, u AS (SELECT model, 'answer' AS role, endpoint, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens FROM usage UNION ALL SELECT verifier_model, 'verifier', endpoint, coalesce(verifier_input_tokens, 0) + coalesce(verifier_output_tokens, 0) FROM usage WHERE verifier_model IS NOT NULL)
SELECT role, model, endpoint, sum(tokens) AS tokens, count(*) AS requests, grouping_id(role, model, endpoint) AS level FROM u GROUP BY ROLLUP (role, model, endpoint) HAVING grouping_id(role, model, endpoint) IN (0, 1, 3)""")
def g6(spark, sf_dir):
    return telemetry.model_cost(usage(spark, sf_dir))


@query("g7_error_rollup", cte("usage") + " SELECT status_code, error_type, count(*) AS n FROM usage GROUP BY 1, 2")
def g7(spark, sf_dir):
    return telemetry.error_rollup(usage(spark, sf_dir))


@query("g8_rate_breaches", cte("usage") + " SELECT user_id, 'minute' AS unit, date_trunc('minute', created_at) AS window_start, count(*) AS requests FROM usage WHERE user_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1 UNION ALL SELECT user_id, 'hour', date_trunc('hour', created_at), count(*) FROM usage WHERE user_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 2")
def g8(spark, sf_dir):
    """Limits of 1 and 2, because the test events are spread thin; 60 and 1000 are the defaults."""
    return telemetry.rate_breaches(usage(spark, sf_dir), 1, 2)


def conversations(spark, sf_dir):
    return load(spark, sf_dir, "conversations")


#: Bytes of a part, few enough that the longer conversations have several.
PART = 600


def _parts(line, between):
    return f"l AS (SELECT conv_id, turn, {line} AS line FROM conversations), s AS (SELECT *, sum(strlen(line) + {between}) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(line) - {between} AS start FROM l), p AS (SELECT conv_id, turn, line, (start // {PART})::bigint AS part FROM s)"


_MARK = "CASE role WHEN 'user' THEN '## Pregunta' WHEN 'assistant' THEN '## Respuesta' ELSE '## Sistema' END || chr(10) || chr(10) || text"


@query("a15_export_threads", f"WITH {_parts(_MARK, 2)} SELECT conv_id, part, CASE WHEN part = 0 THEN '# Conversación ' || conv_id || chr(10) || chr(10) ELSE '' END || string_agg(line, chr(10) || chr(10) ORDER BY turn) AS markdown FROM p GROUP BY conv_id, part")
def a15(spark, sf_dir):
    return threads.export_threads(conversations(spark, sf_dir), PART)


@query("h1_last_question", "SELECT conv_id, arg_max(text, turn) AS question, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1")
def h1(spark, sf_dir):
    return threads.last_question(conversations(spark, sf_dir))


@query("h2_history", "SELECT conv_id, turn, role, text, n - 1 AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n BETWEEN 2 AND 21")
def h2(spark, sf_dir):
    return threads.history(conversations(spark, sf_dir))


@query("h3_assign_threads", """WITH f AS (SELECT conv_id, conv_id % 7 AS user_id, 'q:' || substr(sha256(trim(arg_min(text, turn), ' ' || chr(10))), 1, 32) AS thread_key FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT f.conv_id, f.user_id, f.thread_key, k.thread_key IS NULL AS is_new FROM f LEFT JOIN (SELECT DISTINCT user_id, thread_key FROM f WHERE conv_id % 2 = 0) k ON f.user_id = k.user_id AND f.thread_key = k.thread_key""")
def h3(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    none = turns.limit(0).selectExpr("conv_id % 7 as user_id", "cast(null as string) as thread_key")
    known = threads.assign_threads(turns.where("conv_id % 2 = 0"), F.col("conv_id") % 7, none)
    return threads.assign_threads(turns, F.col("conv_id") % 7, known)


THREADS = "SELECT conv_id, CASE WHEN conv_id % 3 > 0 THEN 'Hilo ' || CAST(conv_id AS VARCHAR(9)) END AS title, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(conv_id % 30 AS INT)) AS created_at, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(conv_id % 45 AS INT)) AS updated_at FROM (SELECT DISTINCT conv_id FROM {}) t"
_THREADS = THREADS.format("conversations").replace("make_interval(0, 0, 0, CAST(conv_id % 30 AS INT))", "to_days((conv_id % 30)::int)").replace("make_interval(0, 0, 0, CAST(conv_id % 45 AS INT))", "to_days((conv_id % 45)::int)")


def thread_table(spark, sf_dir):
    return spark.sql(THREADS.format("{conversations}"), conversations=conversations(spark, sf_dir))


@query("h4_list_threads", f"WITH t AS ({_THREADS}) SELECT conv_id, coalesce(title, 'Nueva consulta') AS title, n AS messages, epoch_ms(created_at) AS created_ms, epoch_ms(updated_at) AS updated_ms FROM t JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id)")
def h4(spark, sf_dir):
    return threads.list_threads(thread_table(spark, sf_dir), conversations(spark, sf_dir))


@query("h5_thread_detail", "WITH " + _parts("role || ': ' || text", 1) + " SELECT conv_id, part, string_agg(line, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM p GROUP BY conv_id, part")
def h5(spark, sf_dir):
    return threads.thread_detail(conversations(spark, sf_dir), PART)


@query("h6_sync_threads", f"WITH t AS ({_THREADS}) SELECT conv_id + (conv_id % 2) * 100000 AS conv_id, CASE WHEN conv_id % 2 = 1 THEN title WHEN conv_id % 4 = 0 THEN 'nuevo' ELSE title END AS title, created_at, CASE WHEN conv_id % 2 = 0 THEN updated_at + INTERVAL 1 HOUR ELSE updated_at END AS updated_at FROM t UNION ALL SELECT conv_id, title, created_at, updated_at FROM t WHERE conv_id % 2 = 1")
def h6(spark, sf_dir):
    t = thread_table(spark, sf_dir)
    later = t.where("conv_id % 2 = 0").selectExpr("conv_id", "case when conv_id % 4 = 0 then 'nuevo' end as title", "created_at", "updated_at + interval 1 hour as updated_at")
    fresh = t.where("conv_id % 2 = 1").selectExpr("conv_id + 100000 as conv_id", "title", "created_at", "updated_at")
    return threads.sync_threads(t, later.unionByName(fresh))


@query("h6_delete_threads", "SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def h6_delete(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    return threads.delete_threads(thread_table(spark, sf_dir), turns, turns.where("role = 'system'"))[1].select("conv_id", "turn", "role")


@query("h7_recency_bucket", f"WITH t AS ({_THREADS}) SELECT conv_id, CASE WHEN updated_at >= TIMESTAMP '2024-02-01' THEN 'Hoy' WHEN updated_at >= TIMESTAMP '2024-01-31' THEN 'Ayer' WHEN updated_at >= TIMESTAMP '2024-01-25' THEN 'Últimos 7 días' WHEN updated_at >= TIMESTAMP '2024-01-02' THEN 'Últimos 30 días' ELSE 'Meses anteriores' END AS bucket FROM t")
def h7(spark, sf_dir):
    return thread_table(spark, sf_dir).select("conv_id", threads.recency_bucket(F.col("updated_at"), F.expr("TIMESTAMP '2024-02-01 09:00:00'")).alias("bucket"))


@query("h8_audit_violations", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn % 5 = 4")
def h8(spark, sf_dir):
    marked = conversations(spark, sf_dir).withColumn("verification_status", F.when((F.col("role") == "assistant") | (F.col("turn") % 5 == 4), "SUPPORTED"))
    return marked.where("role = 'user' and verification_status is not null").select("conv_id", "turn")


@query("h9_provision_users", "SELECT 'Issuer' || user_id % 3 AS issuer, 'S' || user_id AS subject, lower(coalesce(min(CASE WHEN user_id % 2 = 0 AND event_id % 3 > 0 THEN event_type || '@mail.example' END), 'S' || user_id || '@' || 'Issuer' || user_id % 3)) AS email FROM events WHERE user_id % 5 <> 0 GROUP BY user_id")
def h9(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("'Issuer' || cast(user_id % 3 as string) as issuer", "'S' || cast(user_id as string) as subject", "case when user_id % 2 = 0 and event_id % 3 > 0 then event_type || '@mail.example' end as email", "user_id")
    return threads.provision_users(e, e.where("user_id % 5 = 0"))


@query("f12_merge_threads", f"WITH t AS ({_THREADS}) SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 AND conv_id % 4 > 0 THEN 'remoto' ELSE title END AS title, CASE WHEN conv_id % 2 = 0 THEN 'penal' ELSE 'general' END AS kind, CASE WHEN conv_id % 2 = 0 THEN greatest(updated_at, created_at) ELSE updated_at END AS updated_at, CASE WHEN conv_id % 2 = 0 THEN 'both' ELSE 'local' END AS side FROM t UNION ALL SELECT conv_id + 500000, CASE WHEN conv_id % 4 > 0 THEN 'remoto' END, 'penal', created_at, 'remote' FROM t WHERE conv_id % 2 = 0")
def f12(spark, sf_dir):
    t = thread_table(spark, sf_dir)
    local = t.selectExpr("conv_id as id", "title", "cast(null as string) as kind", "updated_at")
    remote = t.where("conv_id % 2 = 0").selectExpr("explode(array(conv_id, conv_id + 500000)) as id", "case when conv_id % 4 > 0 then 'remoto' else '' end as title", "'penal' as kind", "created_at as updated_at")
    return threads.merge_threads(local, remote)


_DAYS = "greatest(1, (year(end_date) - year(start_date)) * 360 + (month(end_date) - month(start_date)) * 30 + (day(end_date) - day(start_date)) + 1)"


#: In whole cents and millionths, halves up.
@query("k1_labour_settlement", cte("employment") + f""", a AS (SELECT *, (base_salary * 100)::hugeint AS s, {_DAYS}::hugeint AS days, CASE WHEN transport AND base_salary <= 3000000 THEN 18000000 ELSE 0 END::hugeint AS t, least(360, (month(end_date) - 1) * 30 + day(end_date))::hugeint AS yd, ((month(end_date) - 1) % 6 * 30 + day(end_date))::hugeint AS hd FROM employment),
b AS (SELECT *, ((s + t) * yd * 2 + 360) // 720 AS sev, ((s + t) * hd * 2 + 360) // 720 AS bon, greatest(0, (days * 30000000 + 360) // 720 - vacation_days_taken * 1000000) AS pending, (greatest(0, days - 360) * 2000000 + 360) // 720 AS more FROM a),
c AS (SELECT *, (sev * yd * 24 + 36000) // 72000 AS int, (s * pending * 2 + 30000000) // 60000000 AS vac,
  CASE WHEN reason <> 'SIN_JUSTA_CAUSA' THEN 0 WHEN contract_type = 'INDEFINIDO' THEN (s * CASE WHEN base_salary < 15000000 THEN 30000000 + more * 20 ELSE 20000000 + more * 15 END * 2 + 30000000) // 60000000 WHEN contract_type = 'FIJO' THEN s * 3 ELSE 0 END AS ind FROM b)
SELECT emp_id, days::int AS days, (t / 100)::double AS transport_allowance, (sev / 100)::double AS severance, (int / 100)::double AS interest, (bon / 100)::double AS bonus, (vac / 100)::double AS vacation, (ind / 100)::double AS indemnity, ((sev + int + bon + vac + ind) / 100)::double AS total FROM c""")
def k1(spark, sf_dir):
    """Amounts as doubles, so that both engines' decimals compare."""
    s = settlement.labour_settlement(view(spark, sf_dir, "employment"))
    return s.select("emp_id", "days", *[F.col(c).cast("double").alias(c) for c in s.columns[2:]])
