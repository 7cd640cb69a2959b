"""SimHash near-dedup for the corpus pipeline: texts alike in five-word shingles.

Two texts are linked where the Jaccard likeness of their sets of five-word shingles is LIKENESS or
more. Texts of equal sets are one node. 64-bit SimHash has no radius that finds such pairs in shards
of bits (texts of likeness 0.8 differ in up to 11 bits and more), so the shards are bands of MinHash
values: a pair of likeness 0.8 shares none of BANDS bands of ROWS values with a chance of
(1 - 0.8^ROWS)^BANDS, 6 in a billion. In a shard the SimHash fingerprints form a BK-tree, and each
member is paired with its nearest earlier one within RADIUS bits. Every link is confirmed by the
exact sets. Members of a shard that stay apart are then held against one of them, and what that
leaves apart against all that share one of their rarest shingles, so that no link is lost, a large
group of copies costs about one pair for each member, and a passage that many unlike texts share
pairs none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import held_here, written
from .simhash import BKTree, bits_of, kept_rows, row_id, shingle_hashes

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 48, 5
#: Bits within which a BK-tree is searched (texts of likeness 0.8 differ in 10 on average), and the members of a tree.
RADIUS, TREE = 20, 256
#: Rounds that hold a band's members against one of them, before those left apart are paired by their rarest shingles.
STARS = 2
_CHUNK, _SLICE = 2048, 128


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; empty without words."""
    return np.unique(shingle_hashes(text, SHINGLE))


def digest_of(shingles: np.ndarray) -> int:
    """64 bits that stand for the set; zero for the empty one."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42) if shingles.size else 0


def multipliers() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """One key for each band: its least values, hashed with the band's number."""
    if not shingles.size:
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, shingles.size, _CHUNK):
        np.minimum(least, (by * shingles[a : a + _CHUNK]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketched(text: Column) -> Column:
    """struct of the set's digest, its SimHash, and its bands."""

    @F.pandas_udf("struct<fp:long,bits:long,keys:array<long>>")
    def made(texts: pd.Series) -> pd.DataFrame:
        by = held_here("near-copies", multipliers)
        each = [(digest_of(s), bits_of(s), band_keys(s, by)) for s in map(shingle_set, texts)]
        longs = lambda i: np.array([x[i] for x in each], np.uint64).view(np.int64)
        return pd.DataFrame({"fp": longs(0), "bits": longs(1), "keys": [x[2] for x in each]})

    return made(text)


def shingled(texts: DataFrame) -> DataFrame:
    """(fp, shingles) of the column `text`; handed over a few rows at a time, because sets are larger than texts."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), _SLICE):
                sets = [shingle_set(t) for t in batch["text"].iloc[a : a + _SLICE]]
                yield pd.DataFrame({"fp": np.array([digest_of(s) for s in sets], np.uint64).view(np.int64), "shingles": [s.view(np.int64) for s in sets]})

    return texts.select("text").mapInPandas(made, "fp long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) whose exact likeness is enough."""
    both = F.size(F.array_intersect("sa", "sb"))
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(both >= likeness * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, fp, root) of the bands whose members are not all in one component."""
    placed = shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return written(placed.join(mixed, "key"), "near-copies-apart")


def nearest_pairs(members: list[tuple[int, int]], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fp, fp of a nearest earlier member) of members (fp, SimHash) by a BK-tree, within the radius."""
    tree, first, out = BKTree(), {}, []
    for fp, bits in sorted(members):
        near = tree.nearest(bits, radius)
        if near is not None:
            out.append((fp, first[near]))
        if bits not in first:
            first[bits] = fp
            tree.add(bits)
    return out


def tree_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): members of every shard with their nearest ones; a large shard is several trees."""

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def nearest(fps: pd.Series, bits: pd.Series) -> pd.Series:
        mask = (1 << 64) - 1
        return pd.Series([[{"a": a, "b": b} for a, b in nearest_pairs([(int(f), int(x) & mask) for f, x in zip(*m, strict=True)])] for m in zip(fps, bits, strict=True)])

    trees = shared.groupBy("key", F.pmod(F.xxhash64("fp"), F.col("trees")).alias("tree")).agg(F.collect_list(F.struct("fp", "bits")).alias("m")).where(F.size("m") > 1)
    return trees.select(F.explode(nearest("m.fp", "m.bits")).alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()


def rare_pairs(members: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b): members (fp, root) of different roots that can be like enough, by their rarest shingles.

    Sets that are like enough share one of the first n - ceil(likeness n) + 1 shingles of each in any
    common order. The order is by the number of members that hold a shingle, so that a passage that
    many members share comes last, and shingles of one member alone, which come first, pair nothing.
    Pairs whose sizes, or whose shingles around the place of the shared one, cannot reach the
    likeness are dropped within the join.
    """
    held = sets.join(members, "fp").select("fp", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = held.join(often, "s").groupBy("fp", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("t"))  # of one text
    first = (F.size("t") - F.ceil(F.lit(likeness) * F.col("n") - 1e-9) + 1).cast("int")
    met = own.where(first > 0).select("fp", "root", "n", F.size("t").alias("c"), F.posexplode(F.slice("t", F.lit(1), first)).alias("i", "t")).select("fp", "root", "n", "c", "i", F.col("t.s").alias("s"))
    other = met.select("s", F.col("fp").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("i").alias("j"))
    # of shingles that anyone shares, those before this one and those from it on bound what the two have in common
    most = F.least("i", "j") + F.least(F.col("c") - F.col("i"), F.col("d") - F.col("j"))
    enough = most >= F.ceil((F.col("n") + F.col("m")) * F.lit(likeness / (1 + likeness)) - 1e-9)
    fits = enough & (F.least("n", "m") >= F.lit(likeness) * F.greatest("n", "m") - 1e-9) & (F.col("root") != F.col("other"))
    return met.join(other, "s").where((F.col("fp") < F.col("b")) & fits).select(F.col("fp").alias("a"), "b")


def linked(shared: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(node, root) of the components over all pairs that share a band and are like enough."""
    edges = written(confirmed(tree_pairs(shared), sets, likeness), "near-copies-edges")
    for star in range(STARS + 1):
        roots = components(edges)
        left = apart(shared, roots)
        if left.isEmpty():
            return roots
        if star < STARS:
            one = left.groupBy("key").agg(F.max_by(F.struct("fp", "root"), F.xxhash64("fp", F.lit(star))).alias("one"))
            pairs = left.join(one, "key").where("root <> one.root").select(F.least("fp", "one.fp").alias("a"), F.greatest("fp", "one.fp").alias("b"))
        else:
            pairs = rare_pairs(left.select("fp", "root").distinct(), sets, likeness)
        edges = edges.unionAll(written(confirmed(pairs.distinct(), sets, likeness), "near-copies-edges"))
    return components(edges)


def near_copies(docs: DataFrame, likeness: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every row.

    component_id is the smallest id among rows reachable by links. Words and case are those of
    `byte_words`; a text of fewer than five words is one shingle. Null and empty texts are together,
    and like no other. Repeated rows stay; a null id is never chosen unless a component has no other.
    Pairs at exactly the likeness are linked; long texts are read whole; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(rows.select("doc_id", sketched(F.col("text")).alias("s")).select("doc_id", "s.fp", "s.bits", "s.keys"), "near-copies")
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"))
    keyed = found.select("fp", "keys").distinct().select("fp", F.explode("keys").alias("key")).repartition("key")
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TREE).cast("int").alias("trees"))
    shared = written(keyed.join(several, "key").join(least.select("fp", "bits"), "fp").select("key", "fp", "bits", "trees"), "near-copies-shared")
    wanted = written(shared.select("fp").distinct().join(least.select("fp", "least"), "fp"), "near-copies-wanted")
    ids = wanted.select(F.col("least").alias("_id")).distinct()
    read = shingled(rows.join(ids, rows.doc_id.eqNullSafe(ids._id), "left_semi"))
    sets = written(read.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "near-copies-sets")
    roots = linked(shared, sets, likeness).withColumnRenamed("node", "fp")
    rooted = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "near-copies-components")
    return found.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each component of near copies the rows of the smallest id, with all their columns; of equal rows one.

    Rows without an id are told apart by their texts, and come after those with one. Rows of one id
    and different texts stay together if one of them stays. An empty table gives an empty result.
    """
    rows = docs.select(row_id(F.col(id_col), F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    return kept_rows(docs, near_copies(rows, **options), id_col, text_col)
