"""Language identification by error-correcting output codes.

Each language has a codeword; each bit is a binary classifier on hashed byte trigrams (smoothed
log-odds of the languages coded 1 against those coded 0). Decoding weighs each bit's exponential
loss by how well that bit was predicted for the language in training, takes the codeword of least
loss, and flags a text whose two nearest codewords are nearly as far.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import held_here, written

BUCKET_BITS = 16
PER_LANGUAGE = 800
UNKNOWN = "und"
#: A gap in probability between the two nearest codewords under which a text is ambiguous.
GAP = 0.05
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves the remainder; a null id is held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text, ASCII other than letters as blanks."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_SPACED), np.uint8).astype(np.uint32)
    if b.size < 3:
        return np.zeros(0, np.uint32)
    k = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (k * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1/1: every split of up to 5 classes, else random columns with the best least distance of 50 draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, float).T
    rng, best, width = random.Random(seed), None, 15 * (n - 1).bit_length()
    for _ in range(50):
        m = np.array([[rng.choice((-1, 1)) for _ in range(width)] for _ in range(n)], float)
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(m, 2))
        if (best is None or apart > best[0]) and all(abs(c.sum()) < n for c in m.T):
            best = (apart, m)
    return best[1]


class Model:
    """Codewords, bit classifiers, their scale, and the loss weights of (language, bit)."""

    def __init__(self, languages: list[str], profiles: np.ndarray, alpha: float = 0.05):
        self.languages, self.codes = languages, codewords(len(languages))
        n = profiles.sum(axis=1, keepdims=True)
        p = (profiles + alpha / profiles.shape[1] * np.maximum(n, 1)) / ((1 + alpha) * np.maximum(n, 1))
        w = []
        for column in self.codes.T:
            ones, others = p[column > 0], p[column < 0]
            w.append(np.log(ones.mean(axis=0)) - np.log(others.mean(axis=0)) if len(others) else np.zeros(p.shape[1]))
        self.w = np.ascontiguousarray(np.array(w).T, np.float32)
        self.scale = np.ones(self.codes.shape[1])
        self.weights = np.full(self.codes.shape, 1 / self.codes.shape[1])

    def margins(self, text: str) -> np.ndarray:
        """Mean log-odds of each bit over the whole text."""
        at = trigram_buckets(text)
        total = np.zeros(self.w.shape[1])
        for a in range(0, at.size, 65536):
            total += self.w[at[a : a + 65536]].sum(axis=0, dtype=np.float64)
        return total / max(1, at.size)

    def weigh(self, languages: np.ndarray, margins: np.ndarray) -> None:
        """Sets the scale of each bit and, from the bits' accuracy on each language, the loss weights."""
        self.scale = np.maximum(np.abs(margins).mean(axis=0), 1e-9)
        for i, code in enumerate(self.codes):
            own = margins[languages == i]
            right = ((own * code > 0).mean(axis=0) if len(own) else np.ones(len(code))) + 1e-6
            self.weights[i] = right / right.sum()

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """Nearest codeword, its probability, and whether the second is nearly as near."""
        loss = (self.weights * np.exp(-np.clip(self.codes * (margins / self.scale), -6, 6))).sum(axis=1)
        p = np.exp(-3 * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        gap = p[order[0]] - p[order[1]] if len(p) > 1 else 1.0
        return int(order[0]), float(p[order[0]]), bool(gap < GAP)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        i, p, unsure = self.decode(self.margins(text))
        return self.languages[i], p, unsure


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from at most `per_language` rows of each language (those of least hashed id), whole texts.

    Only rows with a language and a letter in the text are used. The rows that reach the driver are
    summed profiles, one for each language and each of 8 tasks, and one row of margins for each sampled text.
    """
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = usable.where("lang is not null and text is not null").select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h"))
    # rows that can be among the least of their language, so that a language with many rows doesn't meet in one task
    share = known.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count("*")).alias("share"))
    few = known.join(F.broadcast(share), "lang").where(F.col("h") < F.greatest(F.lit(64.0), F.col("share") * (1 << 20)))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    sample = written(usable.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).select("lang", "text").repartition(8), "language-sample")

    def profiles(batches):
        held_here("language", object)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if has_letter(text):
                    at = trigram_buckets(text)
                    sums.setdefault(lang, np.zeros(1 << BUCKET_BITS)).__iadd__(np.bincount(at, minlength=1 << BUCKET_BITS) / at.size)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [s.astype("<f4").tobytes() for s in sums.values()]})

    found: dict[str, np.ndarray] = {}
    for row in sample.mapInPandas(profiles, "lang string, sums binary").toLocalIterator():
        found[row.lang] = found.get(row.lang, 0) + np.frombuffer(row.sums, "<f4").astype(float)
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((0, 1 << BUCKET_BITS)))
    model = Model(languages, np.array([found[x] for x in languages]))

    def margins(batches):
        held_here("language", object)
        for batch in batches:
            kept = [(lang, model.margins(text).tolist()) for lang, text in zip(batch["lang"], batch["text"], strict=True) if has_letter(text)]
            if kept:
                yield pd.DataFrame(kept, columns=["lang", "margins"])

    rows = sample.mapInPandas(margins, "lang string, margins array<double>").collect()
    model.weigh(np.array([languages.index(r.lang) for r in rows]), np.array([r.margins for r in rows]))
    return model


def predicted(text: Column, model: Model) -> Column:
    """struct of lang_pred, score, ambiguous for each whole text."""
    sent = text_session(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        held_here("language", object)
        m = sent.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return guess(text)


def text_session(model: object):
    """The model (of a size fixed by its parameters) as a broadcast variable."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return session.sparkContext.broadcast(model)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, learned from rows that are not held out.

    Null texts and texts without a letter give `und` with score 0, as does every text if no row can
    be learned from. Repeated rows and null ids stay; ties between codewords go to the first
    language by name; an empty table gives an empty result.
    """
    held = held_out(F.col(id_col), 5, 0)
    model = fit(docs.where(~held), per_language, id_col, text_col, lang_col)
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), predicted(F.col(text_col), model).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with a clear language: texts without a letter and those between two languages go."""
    text, name = F.col(options.get("text_col", "text")), "_lectern_language"
    held = held_out(F.col(options.get("id_col", "doc_id")), 5, 0)
    model = fit(docs.where(~held), **options)
    clear = (F.col(f"{name}.lang_pred") != UNKNOWN) & ~F.col(f"{name}.ambiguous")
    return docs.withColumn(name, predicted(text, model)).where(clear).drop(name)
