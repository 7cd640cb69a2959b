"""Retrieval quality against expected items."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results (query_id, rank, item) with whether the item is expected; items compare trimmed, without case."""
    norm = lambda c: F.lower(F.trim(c))
    e = expected.select("query_id", norm(F.col("item")).alias("key")).distinct().withColumn("right", F.lit(1))
    return results.withColumn("key", norm(F.nullif(F.col("item"), F.lit("")))).join(e, ["query_id", "key"], "left")


def containing(docs: DataFrame, items: DataFrame, broadcast_rows: int = 100_000, chars: int = 1 << 21) -> DataFrame:
    """(doc_id, query_id): documents (doc_id, text) that contain the text `wanted` of an item (query_id, wanted).

    Items of up to `chars` characters in all are found by an automaton, whose size they bound, in one
    pass over the texts. Of more, those under five words are; the second to fourth word of any other
    stand whole in a document that contains it, so documents are joined by runs of three words first
    and compared after that.
    """
    words = lambda c: F.split(c, r"\s+")
    run = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    own = items.where("wanted is not null").select("query_id", "wanted", words(F.col("wanted")).alias("w"))
    if (own.agg(F.sum(F.length("wanted") + 1)).first()[0] or 0) <= chars:
        return spotted(docs, own.drop("w"))
    long, short = own.where(F.size("w") >= 5).select("query_id", "wanted", run(F.col("w"), F.lit(1)).alias("h")), own.where(F.size("w") < 5).select("query_id", "wanted")
    few = F.broadcast if long.count() <= broadcast_rows else lambda df: df
    cut = docs.where("text is not null").select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") >= 3)
    runs = cut.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: run(F.col("w"), i))).alias("h"))
    met = runs.join(few(long.select("query_id", "h")), "h").select("doc_id", "query_id").distinct().join(few(long.select("query_id", "wanted")), "query_id")
    found = docs.join(met, "doc_id").where(F.contains("text", "wanted")).select("doc_id", "query_id")
    return found.unionAll(spotted(docs, short))


def spotted(docs: DataFrame, items: DataFrame, group: int = 50_000) -> DataFrame:
    """`containing` for any items, by an Aho-Corasick automaton in each task.

    Items travel with the plan, `group` of them at most; a larger set is cut by hash into as many
    passes over the documents as it needs.
    """
    spark, kinds = docs.sparkSession, (dict(docs.dtypes)["doc_id"], dict(items.dtypes)["query_id"])
    shape = f"doc_id {kinds[0]}, query_id {kinds[1]}"
    groups, out = -(-items.count() // group), spark.createDataFrame([], shape)
    for g in range(groups):
        own = items.where(F.pmod(F.xxhash64("query_id", "wanted"), F.lit(groups)) == g)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.select("query_id", "wanted").collect()])

        def found(batches: Iterator[pd.DataFrame], sent: Broadcast = sent) -> Iterator[pd.DataFrame]:
            automaton, everywhere, by_text = ahocorasick.Automaton(), [], {}
            for query_id, wanted in sent.value:
                by_text.setdefault(wanted, []).append(query_id)
            everywhere = by_text.pop("", [])  # every text contains the empty one
            for wanted, ids in by_text.items():
                automaton.add_word(wanted, (wanted, ids))
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    held = dict(hit for _, hit in automaton.iter(text)) if by_text else {}
                    rows += [(doc_id, i) for ids in (everywhere, *held.values()) for i in ids]
                yield pd.DataFrame(rows, columns=["doc_id", "query_id"])

        out = out.unionAll(docs.where("text is not null").select("doc_id", "text").mapInPandas(found, shape))
    return out


def evaluate_cases(queries: DataFrame, results: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Hit at k, reciprocal rank, recall and precision of every query.

    Without expectations hits, rank and recall are 1; nothing retrieved means precision 0; null
    results take up their rank.
    """
    j = judged(results, expected)
    first = F.min(F.when(F.col("right") == 1, F.col("rank")))
    per = j.groupBy("query_id").agg(first.alias("first"), F.count("key").alias("retrieved"), F.count("right").alias("hits"))
    found = expected.withColumn("key", F.lower(F.trim("item"))).join(j.select("query_id", "key").distinct().withColumn("got", F.lit(1)), ["query_id", "key"], "left").groupBy("query_id").agg((F.count("got") / F.count("*")).alias("recall"))
    all_ = queries.select("query_id").join(per, "query_id", "left").join(found, "query_id", "left")
    none = F.col("recall").isNull()
    hit = [F.when(none | (F.coalesce("first", F.lit(1 << 30)) <= k), 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in ks]
    return all_.select("query_id", *hit, F.round(F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.coalesce("recall", F.lit(1.0)), 6).alias("context_recall"), F.round(F.when(F.coalesce("retrieved", F.lit(0)) == 0, 0.0).otherwise(F.col("hits") / F.col("retrieved")), 6).alias("context_precision"))


def evaluate_corpus(cases: DataFrame, by: str) -> DataFrame:
    """Means by a column, and over all (null)."""
    metrics = [c for c in cases.columns if c not in ("query_id", by)]
    return cases.rollup(by).agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in metrics])


def ablation(runs: dict[str, DataFrame], metric: str) -> DataFrame:
    """One row for each query with the metric of every run side by side."""
    tagged = None
    for name, cases in runs.items():
        part = cases.select("query_id", F.lit(name).alias("run"), F.col(metric).alias("m"))
        tagged = part if tagged is None else tagged.unionAll(part)
    return tagged.groupBy("query_id").pivot("run", list(runs)).agg(F.first("m"))
