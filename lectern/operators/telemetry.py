"""Usage roll-ups: quota, cost, refusals, latency, errors, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHLY_TOKENS, PER_MINUTE, PER_HOUR = 15_000_000, 60, 1000
TOKENS = ("input_tokens", "output_tokens", "verifier_input_tokens", "verifier_output_tokens")
STAGES = ("embedding", "retrieval", "rerank", "llm", "verification")


def total_tokens() -> Column:
    out = F.lit(0)
    for c in TOKENS:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def token_quota(logs: DataFrame, now: Column, user: int | None = None, budget: int = MONTHLY_TOKENS) -> DataFrame:
    """One row: tokens used since the month began, what is left of the budget, days left (1 at least)."""
    since = logs.where(F.col("created_at") >= F.date_trunc("month", now))
    if user is not None:
        since = since.where(F.col("user_id") == user)
    s = lambda *cs: sum((F.coalesce(F.sum(c), F.lit(0)) for c in cs), F.lit(0))
    a = since.agg(s("input_tokens", "verifier_input_tokens").alias("prompt_tokens"), s("output_tokens", "verifier_output_tokens").alias("completion_tokens"), F.count("*").alias("request_count"))
    used = F.col("prompt_tokens") + F.col("completion_tokens")
    left = F.greatest(F.lit(0), F.lit(budget) - used)
    days = F.greatest(F.lit(1), F.datediff(F.last_day(now), F.to_date(now)) + 1)
    return a.select("prompt_tokens", "completion_tokens", "request_count", used.alias("used_tokens"), left.alias("remaining_tokens"), F.round(left / budget * 100, 1).alias("remaining_percent"), days.alias("days_remaining"), F.greatest(F.lit(0), 1000 - F.col("request_count")).alias("requests_remaining"))


def user_usage(logs: DataFrame, start: str, end: str) -> DataFrame:
    rows = logs.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    return rows.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("requests"), F.sum(total_tokens()).alias("tokens"))


def refusal_rate(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("requests"), F.round(F.avg(F.col("refused").cast("int")), 6).alias("refusal_rate"))


def latency_breakdown(logs: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile of each stage, and its share of all stages' time."""
    pairs = ", ".join(f"'{s}', {s}_latency_ms" for s in STAGES)
    rows = logs.select(F.expr(f"stack({len(STAGES)}, {pairs}) as (stage, ms)"))
    per = rows.groupBy("stage").agg(F.sum("ms").alias("total"), F.avg("ms").alias("mean"), F.percentile("ms", F.lit(0.5)).alias("median"), F.percentile("ms", F.lit(0.95)).alias("p95"))
    whole = per.agg(F.sum("total").alias("all"))  # one row
    return per.join(F.broadcast(whole)).select("stage", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), F.round(F.col("total") / F.col("all"), 6).alias("share"))


def stage_rows(logs: DataFrame, *keys: Column) -> DataFrame:
    pairs = ", ".join(f"'{s}', cast({s}_latency_ms as bigint)" for s in STAGES)
    return logs.select(*keys, F.expr(f"stack({len(STAGES)}, {pairs}) as (stage, ms)")).where("ms is not null")


def latency_sketches(logs: DataFrame, k: int = 400) -> DataFrame:
    """(day, stage, n, total, sketch): a mergeable quantile sketch (KLL) of each day's latencies, to be stored.

    A new day is sketched by itself. A rank read from merged sketches is off by about 2.3 / k^0.9 at
    most, about one in a hundred for 400, whatever the number of days.
    """
    rows = stage_rows(logs, F.to_date("created_at").alias("day"))
    return rows.groupBy("day", "stage").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.kll_sketch_agg_bigint("ms", k).alias("sketch"))


def latency_from_sketches(sketches: DataFrame, ranks: dict[str, float] | None = None) -> DataFrame:
    """(stage, n, mean, quantiles by name, share) over the stored days that are given, of which no latency is read again."""
    ranks = ranks or {"median": 0.5, "p95": 0.95}
    per = sketches.groupBy("stage").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    whole = per.agg(F.sum("total").alias("all"))  # one row
    quantiles = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias(name) for name, r in ranks.items()]
    return per.join(F.broadcast(whole)).select("stage", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), *quantiles, F.round(F.col("total") / F.col("all"), 6).alias("share"))


def model_cost(logs: DataFrame) -> DataFrame:
    """Tokens by model and role, with totals over all endpoints."""
    answer = logs.select(F.col("model"), F.lit("answer").alias("role"), "endpoint", (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))
    check = logs.where("verifier_model is not null").select(F.col("verifier_model").alias("model"), F.lit("verifier").alias("role"), "endpoint", (F.coalesce("verifier_input_tokens", F.lit(0)) + F.coalesce("verifier_output_tokens", F.lit(0))).alias("tokens"))
    cubed = answer.unionByName(check).cube("role", "model", "endpoint")
    return cubed.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"), F.grouping_id().alias("level")).where("level in (0, 1, 3)")


def error_rollup(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status_code", "error_type").agg(F.count("*").alias("n"))


def rate_breaches(logs: DataFrame, per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR) -> DataFrame:
    """(user, unit, window start, requests) of every minute or hour above its limit."""
    out = None
    for unit, limit in (("minute", per_minute), ("hour", per_hour)):
        n = logs.where("user_id is not null").groupBy("user_id", F.window("created_at", f"1 {unit}").start.alias("window_start")).agg(F.count("*").alias("requests")).where(F.col("requests") > limit)
        part = n.select("user_id", F.lit(unit).alias("unit"), "window_start", "requests")
        out = part if out is None else out.unionByName(part)
    return out
