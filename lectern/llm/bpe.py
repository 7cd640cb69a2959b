"""Byte-level encoding and decoding by folds of ranked merges in Spark expressions.

A word is written as its bytes, one character of ISO-8859-1 each. The entries of the rank map that
occur in the word, lowest rank first, are folded over it: each replaces its two parts, wherever they
stand side by side, by the one character that stands for the token. The rank map is a literal of the
plan, split into buckets by hash, because a lookup in a map goes through all its keys.

The words of a corpus are counted over all texts, in Arrow batches. The most frequent ones, of a
bounded number, are encoded and decoded once. Batches of texts then take what is known of these, and
leave other words where they stand; the same expressions fold them there.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import frequent
from .packing import _WIDE, narrow, stretches
from .shared import held_here, written

#: Words that are encoded once, and their longest; rows of a batch that are held at a time.
WORDS, LONGEST, ROWS = 400_000, 40, 200
#: Character of the token of rank 0; those below stand for bytes.
FIRST = 256


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` the value, which is worked out once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def literal(entries: Iterable[tuple[str, object]], kind: str, buckets: int) -> Callable[[Column], Column]:
    """Lookup of a string in a literal map; null where it is missing."""
    held: list[dict] = [{} for _ in range(buckets)]
    for key, value in entries:
        held[xxhash.xxh64_intdigest(key.encode(), 42) & (buckets - 1)][key] = value
    table = F.from_json(F.lit(json.dumps(held, ensure_ascii=False)), f"array<map<string,{kind}>>")
    return lambda key: F.try_element_at(F.get(table, F.xxhash64(key).bitwiseAND(buckets - 1).cast("int")), key)


def last_merge(token: str, ranks: dict[str, int]) -> int:
    """Bytes of the left one of the two parts that the token's own merge joins."""
    parts = [*token]
    while len(parts) > 2:
        _, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b != token)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts[0])


class Ranks:
    """A rank file as literals: the rank map, the two characters that each token joins, and what a character stands for."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.width, most = max(map(len, ranks)), max(ranks.values()) + 1
        if FIRST + most > 0xD800:
            raise ValueError(f"ranks up to {most - 1}; characters for {0xD800 - FIRST} at most are expected")
        letter = {t: t if len(t) == 1 else chr(FIRST + r) for t, r in ranks.items()}
        self.find = literal(((t, r) for t, r in ranks.items() if len(t) > 1), "int", 1 << 14)
        parts, pieces, ids = [""] * most, [""] * most, [*[None] * FIRST, *range(most)]
        for t, r in ranks.items():
            pieces[r] = t
            if len(t) > 1:
                k = last_merge(t, ranks)
                parts[r] = letter[t[:k]] + letter[t[k:]]
            else:
                ids[ord(t)] = r
        held = lambda x, kind: F.from_json(F.lit(json.dumps(x, ensure_ascii=False)), f"array<{kind}>")
        self.parts, self.letters, self.pieces = (held(x, "string") for x in (parts, [chr(FIRST + r) for r in range(most)], pieces))
        self.ids = held(ids, "int")

    def encode(self, word: Column) -> Column:
        """Ids of a word of one byte or more, as array<int>."""
        folded = let(F.decode(word.cast("binary"), "ISO-8859-1"), self._folded)
        return F.transform(F.split(folded, ""), lambda c: F.get(self.ids, F.ascii(c)))

    def _folded(self, word: Column) -> Column:
        n = F.length(word)
        within = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(2), F.least(n - i + 1, F.lit(self.width))), lambda k: F.substring(word, i, k))))
        entries = F.filter(F.transform(within, self.find), lambda r: r.isNotNull())
        joined = lambda word, r: F.replace(word, F.get(self.parts, r), F.get(self.letters, r))
        return F.when(n > 1, F.aggregate(F.sort_array(F.array_distinct(entries)), word, joined)).otherwise(word)

    def decode(self, ids: Column) -> Column:
        """The bytes that an array of ids stands for, one character of ISO-8859-1 each."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "")


class Splitter:
    """All matches of a pattern in a text; texts of common characters take a spelled-out form of it."""

    def __init__(self, pattern: str):
        spelled = narrow(pattern)
        self.any = regex.compile(pattern).findall
        self.common = re.compile(spelled).findall if spelled else self.any

    def __call__(self, text: str | None) -> Iterator[list[str]]:
        """The words of the whole text, in lists for its stretches."""
        for part in stretches(text or ""):
            if part:
                yield self.any(part) if _WIDE.search(part) else self.common(part)


def word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """word, count over all texts (one column); each batch is counted before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held_here(("split", pattern), lambda: Splitter(pattern))
        for batch in batches:
            n: Counter = Counter()
            for first in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(first, ROWS).to_pylist():
                    for part in words(text):
                        n.update(part)
                if len(n) > WORDS or first + ROWS >= batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], names=["word", "n"])
                    n.clear()

    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))


class Known:
    """What is known of frequent words: the decimals of their ids, and the bytes that these give."""

    def __init__(self, table: bytes, pattern: str):
        word, self.ids, held = (c.to_pylist() for c in pa.ipc.open_stream(table).read_all().columns)
        self.bytes = [w if b == w else b for w, b in zip(word, held, strict=True)]  # one string for both where they are equal
        self.place = {w: i for i, w in enumerate(word)}
        self.split = Splitter(pattern)

    def parts(self, text: str | None) -> Iterator[tuple[str | None, str | None, str | None]]:
        """The text in order: runs of known words as (ids, bytes, null), other words as (null, null, word)."""
        for words in self.split(text):
            at = [*map(self.place.get, words)]
            unmet = [i for i, p in enumerate(at) if p is None] if None in at else []
            a = 0
            for b in [*unmet, len(at)]:
                if a < b:
                    yield " ".join([self.ids[p] for p in at[a:b]]), "".join([self.bytes[p] for p in at[a:b]]), None
                if b < len(at):
                    yield None, None, words[b]
                a = b + 1


def round_trip(docs: DataFrame, path: str, pattern: str, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the ids' decimals joined by blanks, decoded_sha256 of the bytes that the ids give, of every row.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows, ties and null ids
    are kept, one row each; an empty table gives an empty result; other columns are not read. Texts
    and words are taken whole, however long.
    """
    spark, ranks = docs.sparkSession, Ranks(path)
    entry = lambda w: let(ranks.encode(w), lambda ids: F.struct(F.array_join(ids.cast("array<string>"), " ").alias("i"), ranks.decode(ids).alias("b")))
    counts = written(word_counts(docs.select(text_col), pattern).where((F.col("count") > 1) & (F.length("word") <= LONGEST)), "bpe-words")
    top = counts.where(F.col("count") >= frequent(counts, words)).select("word", entry(F.col("word")).alias("e")).select("word", "e.i", "e.b").toArrow()  # `words` rows at most
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as stream:
        stream.write_table(top)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    own = uuid.uuid4().hex

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held_here(("bpe", own), lambda: Known(sent.value, pattern))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                ends, parts = [0], []
                for text in rows.column(1).to_pylist():
                    parts += known.parts(text)
                    ends.append(len(parts))
                ids, held, word = zip(*parts, strict=True) if parts else ((), (), ())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (ids, held, word)], ["i", "b", "w"]))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["doc_id", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(looked, f"doc_id {kind}, parts array<struct<i:string,b:string,w:string>>")
    found = F.transform("parts", lambda p: F.when(p.w.isNull(), F.struct(p.i.alias("i"), p.b.alias("b"))).otherwise(entry(p.w)))
    said = let(found, lambda e: F.struct(F.array_join(e.i, " ").alias("ids"), F.array_join(e.b, "").alias("bytes")))
    n = F.when(F.col("x.ids") == "", 0).otherwise(F.length("x.ids") - F.length(F.replace("x.ids", F.lit(" "), F.lit(""))) + 1)
    return split.select("doc_id", said.alias("x")).select("doc_id", n.cast("long").alias("n_tokens"), F.sha2(F.col("x.ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.encode("x.bytes", "ISO-8859-1"), 256).alias("decoded_sha256"))
