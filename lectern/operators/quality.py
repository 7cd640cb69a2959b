"""Declared constraints as checks; each returns violations as (rule, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, rule: str, key: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def allowed_values(df: DataFrame, key: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside the set of a column; null is allowed. One pass over the table."""
    parts = [F.when(~F.col(c).isin(*v), F.struct(F.lit(f"allowed:{c}").alias("rule"), F.col(c).cast("string").alias("detail"))) for c, v in allowed.items()]
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*parts))).alias("v")).select("v.rule", "key", "v.detail")


def unique(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    """Keys that several rows share; rows with a null part are distinct."""
    some = df.na.drop(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return some.select(F.lit(f"unique:{rule}").alias("rule"), F.concat_ws("|", *columns).alias("key"), F.col("n").cast("string").alias("detail"))


def checks(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Rows for which a rule is false (not null), as one pass over the table."""
    parts = [F.when(~F.expr(e), F.lit(f"check:{name}")) for name, e in rules.items()]
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*parts))).alias("rule")).select("rule", "key", F.lit(None).cast("string").alias("detail"))


def orphans(df: DataFrame, rule: str, key: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return _rows(df.where(F.col(column).isNotNull()).join(known, column, "left_anti"), f"reference:{rule}", key, F.col(column))


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def config_rules(config: DataFrame) -> DataFrame:
    """Rules of a retrieval configuration table (config_id and its settings)."""
    return checks(config, "config_id", {
        "weights": "abs(semantic_weight + lexical_weight - 1) <= 1e-9", "rerank_k": "rerank_k <= top_k", "overlap": "chunk_overlap < chunk_size",
    })
