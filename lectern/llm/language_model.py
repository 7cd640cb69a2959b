"""An interpolated modified Kneser-Ney bigram model of the corpus, and the score of every text under it.

Counting goes by blocks, never by single tokens. A block is a stretch of documents: its distinct
word hashes, sorted, and its words as places in them. Each block asks the hash range of each of
its distinct bigrams for the corpus count, and learns which bigrams it owns (each is owned by one
block), so that what must be summed over distinct bigrams - continuation counts, and how many
followers a word has once, twice, or more - is summed over owned ones and then over the hash range
of each word. Ranges get at most one row from a block, with repeats already added up, so neither a
frequent word nor a frequent pair makes a hot task. What comes back is the block's slice of the
model: sorted hash arrays with their statistics, which a worker memory-maps to score the block.

The order is two: a corpus of this kind has nearly as many distinct trigrams as tokens, and asking
for each of them would move more than the input.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import mixed
from .language_id import held_out
from .shared import byte_words, written

#: Hashes of the end of a text (a token) and of the place before its first word (a context only).
END, START = 1, 2
BLOCK_TOKENS = 3_000_000
RANGE_TOKENS = 2_000_000

BLOCK = "block string, doc_ids array<long>, held array<boolean>, n_tokens long, lens binary, words binary, seq binary"
ASKED = "range int, block string, keys binary, counts binary"
FOUND = "block string, kind string, range int, reply binary, s1 long, s2 long, s3 long, s4 long, types long, tokens long"


def packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if x.size else b"")


def unpacked(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if raw.size else np.zeros(0, dtype)


def packed_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, "<u8"), dtype=np.uint64)


def blocks(docs: DataFrame, held: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of BLOCK, of about BLOCK_TOKENS tokens each; one longer text may make a longer block."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, helds, hashes, size, k = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            words, seq = np.unique(np.concatenate([*hashes, np.array([END, START], np.uint64)]), return_inverse=True)
            name = f"{TaskContext.get().partitionId()}-{k}"
            lens = np.array([len(h) for h in hashes], "<i8")
            row = [[name], [ids], [helds], [size], [packed(lens)], [packed_sorted(words)], [packed(seq[:-2].astype("<u4"))]]
            types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = byte_words(text)
                h = np.fromiter(map(digest, words), np.uint64, len(words))
                ids.append(doc_id)
                helds.append(out)
                hashes.append(np.append(h, np.uint64(END)))
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield closed()
                    ids, helds, hashes, size, k = [], [], [], 0, k + 1
        if ids:
            yield closed()

    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), F.col(text_col).alias("text")).mapInArrow(make, BLOCK)


class Block:
    """A block's words, tokens and distinct bigrams; bigrams are sorted by their hashes."""

    def __init__(self, row):
        self.lens, self.words, self.token = unpacked(row.lens, "<i8"), unpacked_sorted(row.words), unpacked(row.seq, "<u4").astype(np.int64)
        self.doc_ids, self.held = row.doc_ids, np.array(row.held, bool)
        self.first = np.cumsum(self.lens) - self.lens
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first] = np.searchsorted(self.words, np.uint64(START))
        self.learned = np.repeat(~self.held, self.lens)
        pairs, inverse = np.unique(self.context << 32 | self.token, return_inverse=True)
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        keys = mixed(self.words[left] * np.uint64(0x9E3779B97F4A7C15) + mixed(self.words[right]))
        order = np.argsort(keys)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.keys, self.left, self.right, self.bigram = keys[order], left[order], right[order], place[inverse]
        self.counts = np.bincount(self.bigram[self.learned], minlength=len(order))


def by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range, slice) of the ranges of the leading bits that sorted keys fall in."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(top)) + 1, [len(top)])) if len(top) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(top[a]), slice(a, b)


def asked_bigrams(bits: int):
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                b = Block(row)
                yield pd.DataFrame([(r, row.block, packed_sorted(b.keys[s]), packed(b.counts[s].astype("<u4"))) for r, s in by_range(b.keys, bits)], columns=["range", "block", "keys", "counts"])

    return ask


def counts_of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def answered_bigrams(part: pd.DataFrame) -> pd.DataFrame:
    """To each block that asked: corpus count times two, plus one if it owns the bigram."""
    part = part.sort_values("block")
    keys = [unpacked_sorted(k) for k in part["keys"]]
    _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([unpacked(c, "<u4") for c in part["counts"]])).astype(np.int64)
    reply = (total[inverse] << 1).astype("<u8")
    reply[first] |= np.uint64(1)
    ends = np.cumsum([len(k) for k in keys])
    rows = [(b, "bigram", r, packed(reply[e - len(k) : e]), *[0] * 6) for b, r, e, k in zip(part["block"], part["range"], ends, keys, strict=True)]
    rows.append((None, "bigram", None, None, *counts_of_counts(total), int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"range": "Int32"})


def reply_of(found: pd.DataFrame, kind: str) -> list[np.ndarray]:
    own = found[found.kind == kind].sort_values("range")
    return [unpacked(r, "<u8") for r in own.reply]


def asked_words(bits: int):
    def ask(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b = Block(next(block.itertuples()))
        reply = np.concatenate(reply_of(found, "bigram"))
        total, owned = reply >> np.uint64(1), (reply & np.uint64(1)).astype(bool)
        n = len(b.words)
        of = lambda places: np.bincount(places, minlength=n)
        sums = np.stack([
            of(b.token[b.learned]), of(b.right[owned & (total > 0)]), of(b.context[b.learned]),
            of(b.left[owned & (total == 1)]), of(b.left[owned & (total == 2)]), of(b.left[owned & (total > 2)]),
        ]).astype("<u8")
        rows = [(r, block.block.iloc[0], packed_sorted(b.words[s]), packed(sums[:, s].ravel())) for r, s in by_range(b.words, bits)]
        return pd.DataFrame(rows, columns=["range", "block", "keys", "counts"])

    return ask


def answered_words(part: pd.DataFrame) -> pd.DataFrame:
    """To each block that asked: count, continuations, count as context, followers seen once, twice, more."""
    part = part.sort_values("block")
    keys = [unpacked_sorted(k) for k in part["keys"]]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.concatenate([unpacked(c, "<u8").reshape(6, -1) for c in part["counts"]], axis=1)
    total = np.stack([np.bincount(inverse, weights=s) for s in sums]).astype("<u8")
    reply = total[:, inverse]
    ends = np.cumsum([len(k) for k in keys])
    rows = [(b, "word", r, packed(reply[:, e - len(k) : e].ravel()), *[0] * 6) for b, r, e, k in zip(part["block"], part["range"], ends, keys, strict=True)]
    rows.append((None, "word", None, None, *counts_of_counts(total[1]), int((total[0] > 0).sum()), int(total[0].sum())))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"range": "Int32"})


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and over 2, from the numbers of counts 1 to 4; never 0, so that every word has a probability."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    of = lambda k, a, b: min(float(k), max(1e-3, k - (k + 1) * y * b / a)) if a else k / 2
    return np.array([0.0, of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)])


def mapped(**arrays: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays as read-only maps of one unnamed file in the worker's own folder, gone when it is closed."""
    out = {}
    with tempfile.TemporaryFile() as f:
        at = {k: (f.tell(), a.dtype, f.write(np.ascontiguousarray(a).data)) for k, a in arrays.items() if a.size}
        f.flush()
        for k, (offset, dtype, n) in at.items():
            out[k] = np.memmap(f, dtype, "r", offset, (n // dtype.itemsize,))
    return out


class Slice:
    """The part of the model that a block needs, as sorted arrays of word and bigram hashes with their statistics, memory-mapped and searched by hash."""

    def __init__(self, words: np.ndarray, bigrams: np.ndarray, found: pd.DataFrame, totals: dict):
        d, dc = discounts(totals["bigram"]), discounts(totals["word"])
        self.v, self.n = totals["types"], totals["tokens"]
        c, cont, as_context, one, two, more = np.concatenate([r.reshape(6, -1) for r in reply_of(found, "word")], axis=1).astype(np.float64)
        count = (np.concatenate(reply_of(found, "bigram")) >> np.uint64(1)).astype(np.int64)
        all_cont = totals["continuations"]
        k = cont.astype(np.int64)
        spread = float(dc[1:] @ np.array([totals["word"][0], totals["word"][1], totals["word_more"]]))
        lower = (np.maximum(cont - dc[np.minimum(k, 3)], 0) + spread / (self.v + 1)) / all_cont if all_cont else np.full(len(c), 1 / (self.v + 1))
        self.m = mapped(words=words, count=c, lower=lower, context=as_context, left_over=d[1] * one + d[2] * two + d[3] * more, bigrams=bigrams, kept=np.maximum(count - d[np.minimum(count, 3)], 0))

    def of(self, keys: str, hashes: np.ndarray, *names: str) -> list[np.ndarray]:
        """Statistics of hashes, each found by binary search in the sorted keys."""
        at = np.searchsorted(self.m[keys], hashes)
        return [self.m[name][at] for name in names]

    def log10(self, b: Block) -> np.ndarray:
        """log10 probability of each of the block's tokens after the one before it."""
        seen, left_over, lower = self.of("words", b.words, "context", "left_over", "lower")
        (kept,) = self.of("bigrams", b.keys, "kept")
        context, w = seen[b.context], b.token
        return np.log10(np.where(context > 0, (kept[b.bigram] + left_over[b.context] * lower[w]) / np.maximum(context, 1), lower[w]))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def scored(totals: dict):
    def score(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b = Block(next(block.itertuples()))
        s = Slice(b.words, b.keys, found, totals)
        added = lambda x: np.add.reduceat(x, b.first)
        c = s.of("words", b.words, "count")[0][b.token]
        total = added(s.log10(b))
        return pd.DataFrame({
            "doc_id": pd.array([None if i is None or i != i else int(i) for i in b.doc_ids], "Int64"), "held_out": b.held, "n_tokens": b.lens,
            "n_known": added((c > 0).astype(np.int64)), "train_tokens": s.n,
            "base_score": added(np.log10(c + 1)) - b.lens * np.log10(s.n + s.v + 1), "score": total, "perplexity": 10 ** (-total / b.lens),
        })

    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Score of every whole text; learned from rows that are not held out.

    Null and empty texts are an end alone. Repeated rows are counted as often as they are there;
    null ids are held out and kept. With nothing to learn from, every token has probability 1 (there
    is one outcome, the unknown word). A long text is scored whole, in a block of its own if need be;
    words of equal hash are one word. An empty table gives an empty result; other columns are not read.
    """
    held = held_out(F.col(id_col), modulus, remainder)
    made = written(blocks(docs, held, id_col, text_col), "lm-blocks")
    tokens = made.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, tokens) / RANGE_TOKENS))) + 1)
    bigrams = written(made.mapInPandas(asked_bigrams(bits), ASKED).groupBy("range").applyInPandas(answered_bigrams, FOUND), "lm-bigrams")
    replies = bigrams.where("block is not null")
    words = written(made.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(asked_words(bits), ASKED).groupBy("range").applyInPandas(answered_words, FOUND), "lm-words")
    add = lambda df: [int(x or 0) for x in df.where("block is null").agg(*[F.sum(c) for c in ("s1", "s2", "s3", "s4", "types", "tokens")]).first()]
    b, w = add(bigrams), add(words)
    totals = {"bigram": b[:4], "word": w[:4], "types": w[4], "tokens": w[5], "continuations": b[4], "word_more": w[4] - w[0] - w[1]}
    slices = bigrams.unionByName(words).where("block is not null").select("block", "kind", "range", "reply")
    return made.groupBy("block").cogroup(slices.groupBy("block")).applyInPandas(scored(totals), SCORES)
