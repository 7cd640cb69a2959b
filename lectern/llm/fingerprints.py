"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Every word shingle is hashed once; the high bits of a hash choose its bin, and each bin keeps its
least hash. An empty bin takes the value of the first filled bin in its own fixed random order of
all bins, so that two texts fill it alike where their filled bins agree. The low BITS of every bin
are packed; likeness is the share of equal bins, corrected for bits that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_words, written

BINS, BITS, SHINGLE = 512, 4, 5
#: Rows of a run of neighbouring ids: one in RUNS of all, within bounds.
RUNS, LEAST_IN_RUN, MOST_IN_RUN = 400, 100, 50_000
_LOW = np.uint64((1 << BITS) - 1)


def word_hashes(text: str | None) -> np.ndarray:
    words = byte_words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of every run of `size` words; of all words if they are fewer, of nothing if there is none."""
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        out = mixed(out + words[j : j + n] + np.uint64(0x9E3779B97F4A7C15))
    return mixed(out)


@lru_cache(maxsize=1)
def probes() -> tuple[np.ndarray, np.ndarray]:
    """For each bin a random order of all bins, and each bin's place in it."""
    rng = np.random.default_rng(2017)
    order = np.array([rng.permutation(BINS) for _ in range(BINS)])
    return order, np.argsort(order, axis=1)


def packed(shingles: np.ndarray) -> bytes:
    """The packed fingerprint of a text's shingle hashes."""
    h = np.sort(shingles)
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    filled, least = bins[first], h[first]
    values = np.zeros(BINS, np.uint64)
    values[filled] = mixed(least) & _LOW
    if len(filled) < BINS:
        order, place = probes()
        has = np.zeros(BINS, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        if len(filled) < 32:
            source = filled[place[empty][:, filled].argmin(axis=1)]
        else:
            source, todo, t = np.zeros(len(empty), np.int64), np.arange(len(empty)), 0
            while len(todo):
                source[todo] = order[empty[todo], t]
                todo = todo[~has[source[todo]]]
                t += 1
        values[empty] = values[source]
    nibbles = values.astype(np.uint8)
    return (nibbles[0::2] << 4 | nibbles[1::2]).tobytes()


def fingerprint(text: str | None) -> bytes:
    return packed(shingle_hashes(word_hashes(text)))


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common shingles, 0 to 1."""
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = int((x >> 4 == 0).sum() + (x & 15 == 0).sum()) / BINS
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def order_key(id_: Column, text: Column) -> Column:
    """A string that sorts rows by falling id, those without one last, and rows of one id by the falling hash of their texts."""
    falling = lambda x: F.lpad(F.hex(F.bitwise_not(x.bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    return F.concat(F.when(id_.isNull(), "1").otherwise("0"), falling(F.coalesce(id_.cast("long"), F.lit(0))), falling(F.xxhash64(text)))


def run_starts(keys: DataFrame, per_run: int) -> list[str]:
    """The first key of every run of about `per_run` rows in order; only these and a count for each partition reach the driver.

    Equal keys are never in two runs.
    """
    parts = max(1, keys.sparkSession.sparkContext.defaultParallelism * 2)
    placed = written(keys.repartitionByRange(parts, "key").select("key", F.spark_partition_id().alias("part")), "run-keys")
    counts = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    before, base = 0, []
    for part in sorted(counts):
        base.append((part, before))
        before += counts[part]
    if not base:
        return []
    bases = F.broadcast(keys.sparkSession.createDataFrame(base, "part int, base long"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    firsts = placed.join(bases, "part").withColumn("rank", rank).where(F.col("rank") % per_run == 0)
    return sorted({r.key for r in firsts.select("key").collect()})


def in_runs(rows: DataFrame, starts: list[str]) -> DataFrame:
    """Rows (key, ...) with their `run`; the first row of each run comes again with `lent` after the last one of the run before it (of the last run for the first of all)."""
    sent, n = rows.sparkSession.sparkContext.broadcast(np.array(starts, "S33")), len(starts)

    @F.pandas_udf("run int, first boolean")
    def placed(keys: pd.Series) -> pd.DataFrame:
        own = keys.to_numpy().astype("S33")
        run = np.searchsorted(sent.value, own, side="right") - 1
        return pd.DataFrame({"run": run.astype(np.int32), "first": sent.value[run] == own})

    at = rows.withColumn("p", placed("key"))
    own = F.struct(F.col("p.run").alias("run"), F.lit(False).alias("lent"))
    lent = F.struct(F.pmod(F.col("p.run") - 1, F.lit(n)).alias("run"), F.lit(True).alias("lent"))
    return at.select("*", F.explode(F.when(F.col("p.first"), F.array(own, lent)).otherwise(F.array(own))).alias("to")).select("*", "to.*").drop("p", "to")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_run: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Rows follow one another by falling id (null ids last), rows of one id by the hash of their
    texts; after the last comes the first. Null texts count as empty; an empty text has the
    fingerprint of no shingle, like any other empty text. A single row is its own next. Repeated
    rows stay, next to one another, and of equal rows at the head of a run any stands for the others.
    A worker reads its runs as a stream and holds two texts at a time, long ones whole. An empty
    table gives an empty result; other columns are not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), order_key(F.col(id_col), text).alias("key"))
    n = docs.count()
    if per_run is None:
        per_run = min(MOST_IN_RUN, max(LEAST_IN_RUN, n // RUNS))
    starts = run_starts(rows.select("key"), per_run)
    if not starts:
        return docs.sparkSession.createDataFrame([], schema)
    parts = min(len(starts), 8 + n // 8192)  # tasks grow in number, not in size
    dealt = in_runs(rows, starts).repartition(parts, "run").sortWithinPartitions("run", "lent", "key").select("id", "text", "run", "lent")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, run, names = None, None, [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for i, t, own_run, lent in zip(batch.id, batch.text, batch.run, batch.lent, strict=True):
                if own_run != run:
                    run, last = own_run, None
                if lent and last is None:  # equal first rows are all lent; one of them is needed
                    continue
                own = fingerprint(t)
                if last is not None:
                    e = edited(last[1], t)
                    print_e = last[2] if e == last[1] else fingerprint(e)
                    out.append((last[0], len(last[1]), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), last[2].hex(), print_e.hex(), likeness(last[2], print_e), likeness(last[2], own)))
                last = None if lent else (None if pd.isna(i) else int(i), t, own)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return dealt.mapInPandas(compute, schema)
