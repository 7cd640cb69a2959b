"""Near-duplicates by 64-bit SimHash, linked by BK-trees.

Fingerprints are computed where the texts are. Distinct fingerprints meet in shards: 64 bits are
cut into radius + 1 blocks, and two fingerprints within the radius agree on at least one block, so
each goes to the shard of each of its blocks. A shard that holds more than SHARD_SIZE is cut again
by blocks of its other bits, and what is still larger into pairs of chunks, so no pair is lost. In a shard the fingerprints form a BK-tree whose
children are keyed by their distance to the parent, and a search follows only edges within the
radius. Trees stay with the shard's task rather than being broadcast, because they grow with the
corpus. A shard returns one edge for each member to its local root, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import byte_words, held_here, written

SHINGLE = 3
RADIUS = 2
SHARD_SIZE = 2048
#: Rows of a list of ids that is broadcast.
FEW = 1_000_000
BITS = 64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `size` words, repeats included; of all words if they are fewer."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned SimHash; zero without words."""
    return bits_of(shingle_hashes(text, size))


def bits_of(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not h.size:
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, h.size, 65536):
        part = h[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > h.size, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        held_here("simhash", object)
        return pd.Series(np.array([fingerprint_of(t, size) for t in texts], np.uint64).view(np.int64))

    return signed(text)


class BKTree:
    """Integers under Hamming distance; a node is its children by distance to it."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Members at most `radius` bits from x."""
        todo = [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            d = (node ^ x).bit_count()
            if d <= radius:
                yield node
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)

    def nearest(self, x: int, radius: int) -> int | None:
        """A member of least distance to x, at most `radius` bits; the bound shrinks with every nearer one."""
        best, todo = None, [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            d = (node ^ x).bit_count()
            if d <= radius:
                best, radius = node, d - 1
                if d == 0:
                    break
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return best

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = x
            self.children[x] = {}
            return
        node = self.root
        while d := (node ^ x).bit_count():
            if (child := self.children[node].get(d)) is None:
                self.children[node][d] = x
                self.children[x] = {}
                return
            node = child


def local_roots(members: list[int], radius: int) -> dict[int, int]:
    """member -> root of its part of the shard, for members that have a neighbour other than themselves."""
    tree, parent = BKTree(), {m: m for m in members}

    def root(m: int) -> int:
        while parent[m] != m:
            parent[m] = m = parent[parent[m]]
        return m

    for m in parent:
        for near in tree.within(m, radius):
            a, b = root(m), root(near)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(m)
    return {m: r for m in parent if (r := root(m)) != m}


def blocks(n_bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of nearly equal blocks."""
    cuts = [n_bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _piece(fp: Column, bits: list[int]) -> Column:
    """The bits at the given places, as one number: runs of places are cut out together."""
    out, at, i = F.lit(0).cast("long"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        part = F.shiftrightunsigned(fp, bits[i]).bitwiseAND(F.lit((1 << (j - i + 1)) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, at))
        at, i = at + j - i + 1, j + 1
    return out


def _keys(fp: Column, radius: int, held: list[int]) -> list[tuple[Column, list[int]]]:
    """(value of a block, all bits held by then) for each block of the bits not held yet."""
    free = [b for b in range(BITS) if b not in held]
    return [(_piece(fp, free[a : a + w]), sorted(held + free[a : a + w])) for a, w in blocks(len(free), radius + 1)]


def shard_edges(fps: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that join everything within the radius."""
    fp = F.col("fp")
    first = _keys(fp, radius, [])
    keyed = fps.select("fp", F.posexplode(F.array(*[k for k, _ in first])).alias("block", "value"))
    hot = keyed.groupBy("block", "value").count().where(F.col("count") > shard_size).select("block", "value", F.lit(True).alias("hot"))
    marked = keyed.join(hot, ["block", "value"], "left")
    again = F.lit(None).cast("array<long>")
    for i, (_, held) in enumerate(first):
        again = F.when(F.col("block") == i, F.array(*[k for k, _ in _keys(fp, radius, held)])).otherwise(again)
    plain = F.array(F.lit(0).cast("long"))
    keys = ["block", "value", "hot", "sub_block", "sub_value"]
    dealt = marked.select("fp", "block", "value", F.posexplode(F.when(F.col("hot"), again).otherwise(plain)).alias("sub_block", "sub_value"), F.coalesce("hot", F.lit(False)).alias("hot"))
    # a shard that is still large is cut into chunks by hash, and every two chunks are a shard
    large = dealt.groupBy(*keys).count().where(F.col("count") > shard_size).select(*keys, F.ceil(F.col("count") / max(1, shard_size // 2)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    placed = dealt.join(large, keys, "left").select("fp", *keys, F.explode(F.when(F.col("chunks").isNotNull(), pairs).otherwise(alone)).alias("pair"))
    shards = placed.groupBy(*keys, "pair").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def linked(members: pd.Series) -> pd.Series:
        mask = (1 << BITS) - 1
        signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
        return pd.Series([[{"a": signed(m), "b": signed(r)} for m, r in local_roots(sorted(int(x) & mask for x in ms), radius).items()] for ms in members])

    return shards.select(F.explode(linked("members")).alias("e")).select("e.*").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", shard_size: int = SHARD_SIZE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest id among rows whose fingerprints are reachable by links of at most
    `radius` bits; equal texts are always together. Null and empty texts have fingerprint zero and
    are linked like any other. Repeated rows stay, one row each; a null id is kept and never chosen
    as component_id unless a component has no other. Long texts are hashed whole, in stretches. An
    empty table gives an empty result; other columns are not read.
    """
    fps = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(shard_edges(least.select("fp"), radius, shard_size))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_id(id_: Column, text: Column) -> Column:
    """struct that tells rows apart and orders them: by id, those without one last and by text."""
    return F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.when(id_.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long")).alias("h"))


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The written table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that `found` (doc_id, component_id: structs of `row_id`) names as their component's; of equal rows one.

    Only the ids that go and those of repeated rows are looked up, and broadcast where they are few,
    so that texts stay where they are.
    """
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).where("not kept").select(F.col("doc_id").alias("_lectern_gone"))
    this, text_hash = row_id(docs[id_col], docs[text_col]), F.xxhash64(docs[text_col])
    left = docs.join(few(written(gone, "rows-gone")), this == F.col("_lectern_gone"), "left_anti")
    same = docs.groupBy(F.struct(this.alias("id"), text_hash.alias("h")).alias("_lectern_same")).count().where("count > 1").select("_lectern_same")
    same = few(written(same, "rows-repeated"))
    key = F.struct(this.alias("id"), text_hash.alias("h"))
    single = left.join(same, key == F.col("_lectern_same"), "left_anti")
    order = Window.partitionBy("_lectern_same").orderBy(*[F.col(f"_lectern_row.`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() != "map"])
    rows = F.struct(*[docs[c] for c in docs.columns]).alias("_lectern_row")
    repeated = left.join(same, key == F.col("_lectern_same")).select(rows, "_lectern_same")
    first = repeated.withColumn("_lectern_n", F.row_number().over(order)).where("_lectern_n = 1").select("_lectern_row.*")
    return single.unionByName(first)
