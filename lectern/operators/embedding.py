"""Hashed embeddings, the model seam, width truncation, and nearest neighbours by blocks of vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.tables import stored

#: Vectors of a block, bytes of query blocks that are broadcast, and words that a task keeps the coordinates of.
BLOCK_ROWS, BROADCAST_BYTES, WORD_MEMORY = 4096, 64 << 20, 300_000


_HASH_WORDS = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]+")
_ASCII_WORDS = re.compile(r"[A-Za-z0-9_]+")  # the same words of a text of ASCII


class HashVectors:
    """Texts to unit vectors: four signed coordinates for each word from its SHA-256, summed and scaled; the first axis for a text without words."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}
        self.places = self.signs = None  # made by the first text, so that a model without any is small to send

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Rows of `places` and `signs` that hold the words' coordinates; at most WORD_MEMORY words."""
        if self.places is None:
            self.places, self.signs = np.zeros((WORD_MEMORY, 4), np.int32), np.zeros((WORD_MEMORY, 4), np.int8)
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(fresh) > WORD_MEMORY:
            self.known.clear()
            fresh = [*dict.fromkeys(words)]
        if fresh:
            start = len(self.known)
            h = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest() for w in fresh), np.uint8).reshape(-1, 32)[:, :16].reshape(-1, 4, 4).astype(np.int32)
            self.places[start : start + len(fresh)] = (h[..., 0] << 8 | h[..., 1]) % self.dim
            self.signs[start : start + len(fresh)] = (h[..., 2] & 1) * 2 - 1
            self.known.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def add(self, out: np.ndarray, words: list[str], sizes: list[int], first: int) -> None:
        """Sums the words' coordinates into the rows of out from `first`, of so many words each; sums of whole numbers, so that their order is free."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        for a in range(0, len(words), WORD_MEMORY // 3):
            at = self.rows_of(words[a : a + WORD_MEMORY // 3])
            cells = row[a : a + len(at), None] * self.dim + self.places[at]
            out[first : first + len(sizes)] += np.bincount(cells.ravel(), weights=self.signs[at].ravel(), minlength=len(sizes) * self.dim).reshape(-1, self.dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """One row for each text, in lower case already."""
        out = np.zeros((len(texts), self.dim))
        words, sizes, first = [], [], 0
        for i, text in enumerate(texts):
            own = (_ASCII_WORDS if text.isascii() else _HASH_WORDS).findall(text)
            words += own
            sizes.append(len(own))
            if len(words) >= WORD_MEMORY // 3 or i == len(texts) - 1:
                self.add(out, words, sizes, first)
                words, sizes, first = [], [], i + 1
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
        out /= np.where(norm > 0, norm, 1)
        out[norm[:, 0] == 0, 0] = 1.0
        return out


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, vector) by HashVectors; a null text has the vector of no words."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = HashVectors(dim)
        for texts in batches:
            yield pd.Series([*model(texts.tolist())])

    return df.select(F.col(id_col).alias("id"), vectors(F.coalesce(F.lower(F.col(text_col)), F.lit(""))).alias("vector"))


def embed(chunks: DataFrame, model: Callable[[list[str]], np.ndarray], dim: int, batch: int = 32) -> DataFrame:
    """The seam for any model: chunks (chunk_id, content) with vectors, in batches of at most the model's size.

    `model` takes texts and returns one row of `dim` finite numbers for each. A blank or null text, a
    short answer, another width or a number that is none fails the task. No text, no call.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                texts = part.content.tolist()
                if not all(t and t.strip() for t in texts):
                    raise ValueError("cannot embed an empty text")
                got = np.asarray(model(texts), np.float32)
                if len(got) != len(texts):
                    raise ValueError(f"the model gave {len(got)} vectors for {len(texts)} inputs")
                if got.shape != (len(texts), dim):
                    raise ValueError(f"the model gave dimension {got.shape[1:]}, {dim} is configured")
                if not np.isfinite(got).all():
                    raise ValueError("the model gave a vector that is not finite")
                yield pd.DataFrame({"chunk_id": part.chunk_id, "vector": list(got)})

    return chunks.select("chunk_id", "content").mapInPandas(run, "chunk_id long, vector array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def truncate_vector(v: Column, width: int) -> Column:
    """The first `width` numbers, scaled to length 1 again; zeros stay."""
    head = F.slice(v, 1, width)
    norm = F.sqrt(dot(head, head))
    return F.transform(head, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def searchable(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks with a vector of the active model."""
    return chunks.where(F.col("vector").isNotNull() & (F.col("embedding_model") == model))


def model_counts(chunks: DataFrame, model: str) -> DataFrame:
    """One row that tells an empty corpus from one embedded by another model."""
    has = F.col("vector").isNotNull()
    return chunks.agg(F.count_if(has & (F.col("embedding_model") == model)).alias("active"), F.count_if(has & (F.col("embedding_model") != model)).alias("other"), F.count_if(~has).alias("unembedded"))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1; zeros stay."""
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def blocks(df: DataFrame, id_col: str, extra: str | None = None, keys: str | None = None) -> DataFrame:
    """(ids, rows, extra, cell): up to BLOCK_ROWS vectors of length 1 as one row, for products of blocks.

    `extra` is an array<string> of each row, for masks of blocks; with `keys`, an int column, rows of
    one key make their own blocks.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, own in frame.groupby("cell") if len(frame) else ():
                for a in range(0, len(own), BLOCK_ROWS):
                    part = own.iloc[a : a + BLOCK_ROWS]
                    yield pd.DataFrame({"ids": [part.id.to_numpy()], "rows": [unit_rows(part.vector).tobytes()], "extra": [[*part.extra]], "cell": [cell]})

    given = df.where("vector is not null").select(F.col(id_col).alias("id"), "vector", (F.col(extra) if extra else F.array().cast("array<string>")).alias("extra"), (F.col(keys) if keys else F.lit(0)).cast("int").alias("cell"))
    return given.mapInPandas(pack, "ids array<long>, rows binary, extra array<array<string>>, cell int")


#: From what rows and what queries carry to whether each row may be found by each query.
Mask = Callable[[Sequence, Sequence], np.ndarray]


def best_of_block(cos: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, rows and values of the k largest of each column, at `floor` or above; of equal ones the least ids.

    Only what is no less than a column's k-th largest is sorted.
    """
    by_query = np.nan_to_num(np.ascontiguousarray(cos.T), nan=-np.inf)
    least = np.partition(by_query, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(by_query), -np.inf)
    asks, at = np.nonzero(by_query >= np.maximum(least, floor)[:, None])
    order = np.lexsort((ids[at], -by_query[asks, at], asks))
    asks, at = asks[order], at[order]
    nth = np.arange(len(asks)) - np.searchsorted(asks, asks)
    asks, at = asks[nth < k], at[nth < k]
    return asks, at, by_query[asks, at]


def best_of_pairs(pairs: DataFrame, k: int, floor: float, mask: Mask | None = None) -> DataFrame:
    """(query_id, id, score) of the best k of each pair of blocks (ids, rows, extra; q_ids, q_rows, q_extra)."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame.itertuples():
                ids, asked = np.asarray(p.ids), np.asarray(p.q_ids)
                cos = (np.frombuffer(p.rows).reshape(len(ids), -1) @ np.frombuffer(p.q_rows).reshape(len(asked), -1).T).round(9)  # equal texts tie exactly
                if mask:
                    cos = np.where(mask(p.extra, p.q_extra), cos, -np.inf)
                asks, at, top = best_of_block(cos, ids, k, floor)
                yield pd.DataFrame({"query_id": asked[asks], "id": ids[at], "score": top})

    return pairs.mapInPandas(score, "query_id long, id long, score double")


def _asked(blocks_: DataFrame) -> DataFrame:
    return blocks_.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "extra")], "cell")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", F.greatest(F.lit(0.0), "score").alias("score"), "rank")


def nearest(base: DataFrame, queries: DataFrame, k: int, floor: float, facts: str | None = None, demands: str | None = None, mask: Mask | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows of `base` (id, vector) of the largest cosine with each query, at `floor` or above.

    Both sides are packed into blocks, and every block of queries meets every block of the base in
    some task: a stated query set against all rows. The query blocks are written once, and broadcast
    if they are few; nothing goes through the driver. With `mask` only rows that it lets pass by their
    `facts` are ranked for a query and its `demands` (both array<string>).
    """
    q = stored(_asked(blocks(queries, "query_id", demands)), "query-blocks")
    size = q.agg(F.coalesce(F.sum(F.length("q_rows")), F.lit(0))).first()[0]
    b = blocks(base, "id", facts)
    if size > BROADCAST_BYTES:
        b = stored(b, "base-blocks")
    pairs = b.drop("cell").crossJoin(F.broadcast(q.drop("cell")) if size <= BROADCAST_BYTES else q.drop("cell"))
    return _ranked(best_of_pairs(pairs, k, floor, mask), k)
