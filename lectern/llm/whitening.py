"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows are written once as blocks of whole numbers. Each step is one Spark job over the blocks:
u = X v for a direction v, less what it has of the earlier u, and at once the sums of Xᵀu. A left
vector is never stored or gathered: it is the rows times a vector of one entry for each column,
which the driver keeps, so that a lost block's share is made again from the block alone. Both sides
are reorthogonalised in full. The driver holds a few arrays of columns by steps, whatever the number
of rows, and takes the singular values of the small bidiagonal matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

COMPONENTS = 8
#: Up to so many columns all steps are taken, so that even equal deviations are told apart; beyond, until the wanted ones have settled to TOLERANCE.
FULL, TOLERANCE, BLOCK = 256, 1e-13, 4096


def whole(vector: Column) -> Column:
    """floor(1024 c) + 100000 of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 1024) + F.lit(100_000).cast("long"))


def usable(vector: Column) -> Column:
    """No null and no entry that is null, not a number or infinite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda c: bad(c.cast("double"))), F.lit(False)) & (F.size(vector) > 0)


class Blocks:
    """Rows of whole numbers as a table of blocks, and jobs over it."""

    def __init__(self, rows: DataFrame, width: int):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                parts = [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["block"])

        self.width = width
        self.table = written(rows.select("x").mapInArrow(cut, "block binary"), "whitening-blocks")
        self.mean = np.zeros(width)
        ints = lambda x: [*map(int, x.sum(axis=0)), len(x)]
        sums = self.total(ints, "decimal(38,0)", centred=False)
        self.sums, self.n = [*map(int, sums[:-1])], int(sums[-1])
        self.mean = np.array([s / self.n for s in self.sums])

    def total(self, of: object, kind: str = "double", centred: bool = True) -> list:
        """Sums over all blocks of the numbers that `of` gives for a block of centred rows."""
        width, mean = self.width, self.mean

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for block in batch.column(0):
                    x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, width)
                    got = of(x - mean if centred else x)
                    held = got if held is None else [a + b for a, b in zip(held, got, strict=True)] if isinstance(got, list) else held + got
            if held is not None:
                made = pa.array(held, pa.float64()) if kind == "double" else pa.array([*map(str, held)])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), made], names=["i", "v"])

        sums = self.table.mapInArrow(partial, f"i int, v {'double' if kind == 'double' else 'string'}").groupBy("i").agg(F.sum(F.col("v").cast(kind)).alias("v"))
        return [r.v for r in sorted(sums.collect(), key=lambda r: r.i)]  # a number for each column or two


def bidiagonalised(blocks: Blocks, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(deviations times the root of n, components as columns), falling, of the centred rows."""
    d, rng = blocks.width, np.random.default_rng(seed)
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v; what rows are multiplied by for u; Xᵀu
    alphas, betas = [], []

    def apart(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    def fresh() -> np.ndarray:
        w = apart(rng.standard_normal(d))
        return w / np.linalg.norm(w)

    v, scale = fresh(), 0.0
    while len(alphas) < d:
        p = v - left @ (back.T @ v)  # u_j · X v is Xᵀu_j · v
        k = left.shape[1]
        both = np.concatenate([left, p[:, None]], axis=1)

        def products(x: np.ndarray, both: np.ndarray = both) -> np.ndarray:
            made = x @ both
            u = made[:, -1]
            return np.concatenate([made.T @ u, x.T @ u])

        got = np.array(blocks.total(products))
        again, square, t = got[:k], got[k], got[k + 1 :]
        p, t, square = p - left @ again, t - back @ again, square - again @ again
        alpha = float(np.sqrt(max(square, 0.0)))
        scale = max(scale, alpha)
        if alpha <= 1e-13 * scale or scale == 0:
            alpha, p, t = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, t = p / alpha, t / alpha
        right, left, back = (np.concatenate([m, c[:, None]], axis=1) for m, c in ((right, v), (left, p), (back, t)))
        alphas.append(alpha)
        if len(alphas) == d:
            break
        w = apart(t - alpha * v)
        beta = float(np.linalg.norm(w))
        if d > FULL and len(alphas) >= wanted:
            y, s, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if beta * np.abs(y[-1, :wanted]).max() <= TOLERANCE * s[0]:
                break
        if beta <= 1e-13 * scale:
            beta, v = 0.0, fresh()
        else:
            v = w / beta
        betas.append(beta)
    _, s, z = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))
    vectors = right @ z.T[:, :wanted]
    return s[:wanted], vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or empty or hold null or non-finite entries are dropped; so are those of
    another width than most have (of several as frequent, the longest). Repeated rows and null ids
    are kept and count as often as they occur. Components without any deviation are left out, so
    that equal vectors, a single one, and an empty table give no rows. Components of equal deviations
    are some orthonormal basis of theirs. A deviation above the range of a long is an error, and so
    is an entry above it. Other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col)).alias("x"))
    none = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {OUT}")
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return none
    rows = rows.where(F.size("x") == widths["width"])
    blocks = Blocks(rows, widths["width"])
    mean, n = blocks.mean, blocks.n
    s, found = bidiagonalised(blocks, min(components, blocks.width))
    trace = blocks.total(lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0] / n
    held = int((s > 1e-9 * max(s[0], 1e-300)).sum()) if s[0] > 0 else 0
    if not held or not trace:
        return none
    e = s[:held] ** 2 / n
    scaled = found[:, :held] / np.sqrt(e)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = np.array(blocks.total(moments)) / n
    error = float(np.abs(got[held:].reshape(held, held) - np.outer(got[:held], got[:held]) - np.eye(held)).max())
    explained = e / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            w = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, -1) - mean) @ scaled
            row = pa.array(np.repeat(np.arange(m), held))
            columns = [batch.column(0).take(row), np.tile(np.arange(1, held + 1, dtype=np.int32), m), np.full(m * held, n), batch.column(2).take(row), w.ravel(), np.tile(explained, m), np.full(m * held, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", *(f.split(" ")[0] for f in OUT.split(", "))])

    sums = F.array(*[F.lit(x).cast("long") for x in blocks.sums])
    apart = F.zip_with("x", sums, lambda x, total: x * F.lit(n).cast("long") - total)
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda acc, y: acc + y * y)
    return rows.select("vec_id", "x", deviation.alias("deviation")).mapInArrow(projected, f"vec_id {kind}, {OUT}")
