"""A stored vector index: cells of nearest centres, product-quantised residuals, exact scores for what these leave in doubt.

Every vector is kept in the cell of its nearest centre as a code of one byte for each four
coordinates of what the centre leaves over. A search looks into the cells whose centres are nearest
to a query, reckons all their rows from the codes, and scores only those exactly that the codes
cannot rule out: whose reckoned score, with the error that a sample shows, reaches the k-th best
exact one that the task has met for the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding import BLOCK_ROWS, BROADCAST_BYTES, _ranked, unit_rows

#: Coordinates that share a byte, values of a byte, most centres, rows that centres and codes are fitted on.
WIDTH, VALUES, MOST_CELLS, SAMPLE = 4, 256, 4096, 20_000
#: Share of a sample's neighbours that the cells looked into must hold, and share of its rows whose error the margin must cover.
RECALL, COVERED = 0.95, 0.999
BLOCKS = "cell int, ids array<long>, codes binary, rows binary"
MODEL = "dim int, centres binary, books binary, looks int, margin double"


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of the nearest row of c for each row of x."""
    return (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)


def means(x: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    """`count` centres of the rows of x, by rounds of nearest centre and mean."""
    c = x[np.random.default_rng(seed).choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest_of(x, c)
        n = np.bincount(own, minlength=len(c))[:, None]
        sums = np.stack([np.bincount(own, weights=column, minlength=len(c)) for column in x.T], axis=1)
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


class Codes:
    """Centres, one book of values for each WIDTH coordinates of the residuals, and what a sample shows of both."""

    def __init__(self, dim: int, centres: np.ndarray, books: np.ndarray, looks: int, margin: float):
        self.dim, self.centres, self.books, self.looks, self.margin = dim, centres, books, looks, margin

    @classmethod
    def fitted(cls, x: np.ndarray, rows: int, k: int, seed: int = 3) -> Codes:
        """On rows of length 1 that stand for `rows` in all."""
        dim, parts = x.shape[1], -(-x.shape[1] // WIDTH)
        centres = means(x, int(min(max(16, 4 * math.isqrt(rows)), MOST_CELLS, max(1, len(x) // 4))), seed)
        own = nearest_of(x, centres)
        left = np.pad(x - centres[own], ((0, 0), (0, parts * WIDTH - dim))).reshape(len(x), parts, WIDTH)
        books = np.zeros((parts, VALUES, WIDTH))
        for p in range(parts):
            made = means(left[:, p], VALUES, seed + p)
            books[p, : len(made)], books[p, len(made) :] = made, made[0]
        codes = cls(dim, centres, books, 1, 0.0)
        reckoned = np.concatenate([codes.rows_of(c, codes.codes_of(x[own == c], c)) for c in range(len(centres))]) if len(x) else x
        order = np.argsort(own, kind="stable")
        asked = x[:: max(1, len(x) // 200)]
        exact = asked @ x.T
        codes.margin = float(np.quantile(np.abs(asked @ reckoned.T - exact[:, order]), COVERED))
        true = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
        at = np.take_along_axis(place, own[true], axis=1)
        codes.looks = next((n for n in range(1, len(centres)) if (at < n).mean() >= RECALL), len(centres))
        return codes

    def codes_of(self, x: np.ndarray, cell: int) -> np.ndarray:
        left = np.pad(x - self.centres[cell], ((0, 0), (0, len(self.books) * WIDTH - self.dim))).reshape(len(x), len(self.books), WIDTH)
        return np.stack([nearest_of(left[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def rows_of(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for."""
        left = self.books[np.arange(len(self.books)), codes].reshape(len(codes), len(self.books) * WIDTH)[:, : self.dim]
        return (self.centres[cell] + left).astype(np.float32)

    def looked_into(self, q: np.ndarray) -> np.ndarray:
        """The cells for each row of q, as a table of flags."""
        flags = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(flags, np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.looks], True, axis=1)
        return flags

    def row(self) -> tuple:
        return self.dim, self.centres.tobytes(), self.books.tobytes(), self.looks, self.margin

    @classmethod
    def of_row(cls, dim: int, centres: bytes, books: bytes, looks: int, margin: float) -> Codes:
        return cls(dim, np.frombuffer(centres).reshape(-1, dim), np.frombuffer(books).reshape(-1, VALUES, WIDTH), looks, margin)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        model = spark.read.schema(MODEL).parquet(f"{path}/model").first()
        self.codes = Codes.of_row(*model) if model else None

    @staticmethod
    def write(base: DataFrame, path: str, k: int = 20, sample: int = SAMPLE) -> None:
        """Indexes all rows of base (id, vector) with a vector; centres and codes are fitted on at most `sample` rows, those of least hashed id."""
        spark, base = base.sparkSession, base.where("vector is not null").select("id", "vector")
        few = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()
        n = base.count() if len(few) == sample else len(few)
        codes = Codes.fitted(unit_rows(few.vector), n, k) if n else None
        spark.createDataFrame([codes.row()] if codes else [], MODEL).coalesce(1).write.parquet(f"{path}/model")
        sent = spark.sparkContext.broadcast(codes)  # MOST_CELLS centres at most
        salts = max(1, n // (MOST_CELLS * BLOCK_ROWS))

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"id": frame.id, "vector": frame.vector, "cell": nearest_of(unit_rows(frame.vector), sent.value.centres).astype(np.int32)})

        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for cell, own in frame.groupby("cell") if len(frame) else ():
                    for a in range(0, len(own), BLOCK_ROWS):
                        part = own.iloc[a : a + BLOCK_ROWS]
                        x = unit_rows(part.vector)
                        yield pd.DataFrame({"cell": np.array([cell], np.int32), "ids": [part.id.to_numpy()], "codes": [sent.value.codes_of(x, cell).tobytes()], "rows": [x.tobytes()]})

        kind = base.schema["vector"].dataType.simpleString()
        cells = base.mapInPandas(placed, f"id long, vector {kind}, cell int")
        dealt = cells.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("cell")
        dealt.mapInPandas(packed, BLOCKS).write.parquet(f"{path}/blocks")

    def search(self, queries: DataFrame, k: int, floor: float, tally: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the best k of each query (query_id, vector) at `floor` or above, of the rows in the cells it looks into.

        With `tally`, (query_id, reckoned, scored) instead: how many rows its tasks reckoned from
        codes, and how many they scored exactly.
        """
        if self.codes is None:
            return self.spark.createDataFrame([], "query_id long, " + ("reckoned long, scored long" if tally else "id long, score double, rank int"))
        sent = self.spark.sparkContext.broadcast(self.codes)

        def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), BLOCK_ROWS):
                    part = frame.iloc[a : a + BLOCK_ROWS]
                    q = unit_rows(part.vector)
                    yield pd.DataFrame({"q_ids": [part.query_id.to_numpy()], "q_rows": [q.tobytes()], "q_cells": [np.packbits(sent.value.looked_into(q), axis=1).tobytes()]})

        def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codes, held = sent.value, {}
            for frame in frames:
                for _, own in frame.groupby([frame.q_ids.map(lambda q: (len(q), int(q[0]), int(q[-1]))), np.cumsum(frame.ids.map(len)) // BLOCK_ROWS], sort=False):
                    ids = np.asarray(own.q_ids.iloc[0])
                    key = (len(ids), int(ids[0]), int(ids[-1]))
                    if key not in held:
                        held[key] = Best(ids, np.frombuffer(own.q_rows.iloc[0]).reshape(len(ids), -1), np.frombuffer(own.q_cells.iloc[0], np.uint8).reshape(len(ids), -1), k, floor)
                    held[key].add(codes, own)
            for best in held.values():
                yield best.tally() if tally else best.found()

        few = queries.where("vector is not null").select("query_id", "vector").mapInPandas(asked, "q_ids array<long>, q_rows binary, q_cells binary")
        if queries.count() * (8 * self.codes.dim + len(self.codes.centres) // 8) <= BROADCAST_BYTES:
            few = F.broadcast(few)
        found = self.blocks.crossJoin(few).mapInPandas(scored, "query_id long, reckoned long, scored long" if tally else "query_id long, id long, score double")
        return found.groupBy("query_id").agg(F.sum("reckoned").alias("reckoned"), F.sum("scored").alias("scored")) if tally else _ranked(found, k)


class Best:
    """The best k of a block of queries among the blocks that a task meets."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, cells: np.ndarray, k: int, floor: float):
        self.ids, self.rows, self.k, self.floor = ids, rows, k, floor
        self.narrow, self.flags = rows.astype(np.float32), np.unpackbits(cells, axis=1).astype(bool)
        self.score, self.id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.reckoned, self.scored = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def add(self, codes: Codes, blocks: pd.DataFrame) -> None:
        """Blocks (cell, ids, codes, rows) of about BLOCK_ROWS rows, taken together."""
        sizes = blocks.ids.map(len).to_numpy()
        cell, ids = np.repeat(blocks.cell.to_numpy(), sizes), np.concatenate(blocks.ids.tolist())
        asks = np.flatnonzero(self.flags[:, blocks.cell].any(axis=1))
        if not len(asks):
            return
        near = np.concatenate([codes.rows_of(c, np.frombuffer(x, np.uint8).reshape(n, -1)) for c, x, n in zip(blocks.cell, blocks.codes, sizes, strict=True)])
        near = self.narrow[asks] @ near.T
        looks = self.flags[asks][:, cell]
        near[~looks] = -np.inf
        self.reckoned[asks] += looks.sum(axis=1)
        rows = np.frombuffer(b"".join(blocks.rows)).reshape(len(ids), -1)
        if len(ids) > self.k:  # the best by codes first, so that few of the others stay in doubt
            first = np.argpartition(-near, self.k - 1, axis=1)[:, : self.k]
            self.take(np.repeat(asks, self.k), first.ravel(), np.take_along_axis(near, first, 1).ravel() > -np.inf, ids, rows)
            np.put_along_axis(near, first, -np.inf, 1)
        at, row = np.nonzero(near >= (np.maximum(self.score[asks, -1], self.floor) - codes.margin)[:, None])
        self.take(asks[at], row, np.ones(len(at), bool), ids, rows)

    def take(self, query: np.ndarray, row: np.ndarray, real: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int = 100_000) -> None:
        """Scores pairs of a query and a row, in order of queries, exactly."""
        for a in range(0, len(query), most):
            q, r = query[a : a + most][real[a : a + most]], row[a : a + most][real[a : a + most]]
            self.scored += np.bincount(q, minlength=len(self.ids))
            score = np.einsum("ij,ij->i", rows[r], self.rows[q]).round(9)
            keep = (score >= self.floor) & (score >= self.score[q, -1])
            q, score, found = q[keep], score[keep], ids[r[keep]]
            some = np.unique(q)
            all_q = np.concatenate([np.repeat(some, self.k), q])
            all_score, all_id = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.id[some].ravel(), found])
            order = np.lexsort((all_id, -all_score, all_q))
            begin = np.searchsorted(all_q[order], some)
            best = order[begin[:, None] + np.arange(self.k)]
            self.score[some], self.id[some] = all_score[best], all_id[best]

    def found(self) -> pd.DataFrame:
        keep = self.score > -np.inf
        return pd.DataFrame({"query_id": np.broadcast_to(self.ids[:, None], keep.shape)[keep], "id": self.id[keep], "score": self.score[keep]})

    def tally(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids, "reckoned": self.reckoned, "scored": self.scored})
