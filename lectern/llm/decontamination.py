"""Benchmark decontamination: which short test items lie inside which documents.

Items are partitioned by their number of distinct shingles. An item's MinHash sketch is its k
shingles of least hash, and k grows with the partition so that an item contained at the wanted
share must have at least one sketch shingle in the document: it misses fewer shingles than the
sketch holds. Documents are joined with sketch shingles first, which gives candidate pairs; only
their documents are read again, and only their pairs are verified by counting all of the item's
shingles. All steps are DataFrame functions; texts are never shuffled, only hashes that some item
also has are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHINGLE, CONTAINMENT = 5, 0.8
#: Item shingles, and keys of candidate documents, are broadcast up to so many rows (about 40 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+"), "")


def grams(array: Column, n: Column, size: int) -> Column:
    """Hash of every run of `size` words; none if there are fewer words. Words are reached by place, so long texts stay linear."""
    at = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(array, i + j) for j in range(size)]))
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), at)).otherwise(F.array().cast("array<long>"))


def worded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("n", F.size("w"))


def item_shingles(items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, gram, item_id, n_item, in_sketch): every distinct shingle of each item.

    An item of fewer words than `size` has one shingle, of all its words. The size partition is the
    number of distinct shingles up to the next power of two; the sketch is as the largest in it needs.
    """
    w = worded(items, id_col, text_col).where("n > 0")
    gram = F.least(F.col("n"), F.lit(size))
    hashes = F.when(F.col("n") >= size, grams(F.col("w"), F.col("n"), size))
    for short in range(1, size):
        hashes = F.when(F.col("n") == short, grams(F.col("w"), F.col("n"), short)).otherwise(hashes)
    own = w.select(F.col("id").alias("item_id"), gram.alias("gram"), F.explode(hashes).alias("h")).distinct()
    sized = own.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sketch = F.floor((1 - containment) * F.pow(F.lit(2.0), F.ceil(F.log2("n_item"))) + 1e-9) + 1
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("h"), "h")
    ranked = own.join(sized, "item_id").withColumn("rank", F.row_number().over(order))
    return ranked.select("h", "gram", "item_id", "n_item", (F.col("rank") <= sketch).alias("in_sketch"))


def row_key(id_: Column, text: Column) -> Column:
    """What tells documents apart: the id, or the text where there is none."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("\0"), F.xxhash64(text).cast("string")))


def shingled(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, gram, h) of every shingle of the sizes that items have."""
    tagged = lambda k: F.transform(grams(F.col("w"), F.col("n"), k), lambda h: F.struct(F.lit(k).alias("gram"), h.alias("h")))
    each = [tagged(k) for k in sizes]
    return texts.select("key", F.explode(each[0] if len(each) == 1 else F.concat(*each)).alias("g")).select("key", "g.gram", "g.h")


def candidates(texts: DataFrame, wanted: DataFrame, sizes: list[int], few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, item_id): documents that hold a sketch shingle of the item's size partition."""
    sketch = wanted.where("in_sketch").select("gram", "h", "item_id")
    return shingled(texts, sizes).join(few(sketch), ["gram", "h"]).select("key", "item_id").distinct()


def verified(texts: DataFrame, pairs: DataFrame, wanted: DataFrame, sizes: list[int], few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, item_id, n_item, n_found): shingles that the documents of the pairs share with their items."""
    held = shingled(texts, sizes).join(few(wanted.select("gram", "h").distinct()), ["gram", "h"], "left_semi").distinct()
    asked = pairs.join(few(wanted), "item_id").select("key", "item_id", "n_item", "gram", "h")
    return asked.join(held, ["key", "gram", "h"]).groupBy("key", "item_id", "n_item").agg(F.count("*").alias("n_found"))


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment of each pair with at least that containment.

    Items without a word (null, empty) are contained nowhere; null and empty documents contain
    nothing. Rows of one doc_id count as one document of all their shingles; rows without an id are
    a document each, equal ones together. Rows of one item_id are one item; null item ids are left
    out. Equal items are found together, pairs at exactly the containment belong to the result, and
    a long text is one row until its shingles are dealt out. An empty table gives an empty result;
    other columns are not read.
    """
    return found_items(docs, items, containment, size, id_col, text_col, item_col, item_text_col, broadcast_rows).drop("key")


def found_items(docs: DataFrame, items: DataFrame, containment: float, size: int, id_col: str, text_col: str, item_col: str, item_text_col: str, broadcast_rows: int) -> DataFrame:
    """`contained_items` with the documents' keys."""
    wanted = written(item_shingles(items.where(F.col(item_col).isNotNull()), containment, size, item_col, item_text_col), "item-shingles")
    counts = wanted.groupBy("gram").count().collect()  # at most `size` rows
    sizes = sorted(r.gram for r in counts) or [size]
    few = F.broadcast if sum(r["count"] for r in counts) <= broadcast_rows else lambda df: df
    texts = worded(docs.select(row_key(F.col(id_col), F.col(text_col)).alias("id"), F.col(text_col).alias("text")), "id", "text").withColumnRenamed("id", "key")
    pairs = written(candidates(texts, wanted, sizes, few), "item-candidates")
    if pairs.count() <= broadcast_rows:  # else every document's item shingles are found again, but texts are not moved
        texts = texts.join(F.broadcast(pairs.select("key").distinct()), "key", "left_semi")
    share = F.col("n_found") / F.col("n_item")
    found = verified(texts, pairs, wanted, sizes, few).where(share >= containment)
    doc_id = F.when(~F.startswith("key", F.lit("\0")), F.col("key")).cast(docs.schema[id_col].dataType)
    return found.select("key", doc_id.alias("doc_id"), "item_id", "n_item", "n_found", share.alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `docs` whose document holds no item, with all their columns; documents are those of `contained_items`."""
    bad = written(found_items(docs, items, containment, size, id_col, text_col, item_col, item_text_col, broadcast_rows).select(F.col("key").alias("_lectern_held")).distinct(), "item-documents")
    small = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(small, row_key(docs[id_col], docs[text_col]) == bad["_lectern_held"], "left_anti")


ORACLE = """
WITH item_words AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_grams AS (SELECT DISTINCT item_id, least(len(w), 5) AS gram, list_aggregate(w[i:i + least(len(w), 5) - 1], 'string_agg', ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM item_words WHERE len(w) > 0)),
sized AS (SELECT item_id, count(*) AS n_item FROM item_grams GROUP BY 1),
doc_words AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN text END AS own, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT gram FROM item_grams),
doc_grams AS (SELECT DISTINCT doc_id, own, gram, list_aggregate(w[i:i + gram - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, own, w, gram, unnest(generate_series(1, len(w) - gram + 1)) AS i FROM doc_words, grams WHERE len(w) >= gram)),
found AS (SELECT doc_id, own, item_id, count(*) AS n_found FROM doc_grams JOIN item_grams USING (gram, s) GROUP BY 1, 2, 3)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM found JOIN sized USING (item_id) WHERE n_found / n_item >= 0.8
"""
