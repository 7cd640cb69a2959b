"""Token counts by byte-pair merging, without building identifiers.

For each word: a heap of adjacent pairs by merge rank over a linked list of symbols. The lowest
rank (then the leftmost place) is popped until no pair can merge; the count is the number of
initial symbols less the merges. Counts of words are remembered in each Python worker, up to a
fixed number of words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held_here

WORD_MEMORY = 800_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class WordCounts(dict):
    """word -> its number of tokens after merging; forgets all words when it is full."""

    def __init__(self, merges: list, vocab: dict[str, int], ending: str, size: int = WORD_MEMORY):
        super().__init__()
        self.size = size
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + ending] for s in symbols]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        #: left and right symbol in one number -> rank and merged symbol in one number
        self.ranks = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[word] = n
        return n

    def count(self, word: bytes) -> int:
        ids = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        n = len(ids)
        find = self.ranks.get
        heap = [m >> 32 << 32 | i for i in range(n - 1) if (m := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, merged = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            if ids[i] < 0 or (j := after[i]) >= n:
                continue
            m = find(ids[i] << 32 | ids[j])
            if m is None or m >> 32 != top >> 32:  # one of the two has merged since
                continue
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            merged += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := find(ids[i] << 32 | ids[k])) is not None:
                    push(heap, m >> 32 << 32 | i)
            h = before[i]
            if h >= 0 and (m := find(ids[h] << 32 | ids[i])) is not None:
                push(heap, m >> 32 << 32 | h)
        return n - merged


class TokenCounter:
    """Counts tokens of texts as a tokenizer file of normalised, pattern-split, byte-level merges gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.counts = WordCounts(model["merges"], model["vocab"], model.get("end_of_word_suffix") or "")

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts, extra = [text], 0
        if "<|" in text:
            parts = self.special.split(text)
            extra = len(parts) - 1
        total = extra
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-casing goes by character, without a final form
            total += sum(map(self.counts.__getitem__, self.words(part.lower())))
        return total


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of each whole text. `path` must be readable on every executor."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = held_here(("tokens", path), lambda: TokenCounter(path))
        return pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null and empty texts count 0 bytes and 0 tokens. Repeated rows, ties and null ids are kept as
    they are, one row each; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
