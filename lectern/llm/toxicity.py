"""Toxicity by a small convolutional text classifier, trained in numpy by Spark tasks.

A word is the sum of hashed embeddings of itself and of its first letters; filters of several
widths slide over the words of the whole text, their rectified maxima over the text feed one
logistic unit. Words that too few training texts hold have no embedding. The decision threshold is
calibrated for each language, which is guessed from the words alone, and the score is shifted so
that every threshold lies at 0.5.

All labelled texts are learned from: counts of words and languages are sums over all of them, three
quarters train the weights, the others set the thresholds. Each round trains a copy of the network
in every task, on the texts of its partition as they stream by; then the changes of a bucket are
averaged over the tasks that met it, all other weights over all tasks by their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language_id import held_out, text_session
from .packing import stretches
from .shared import held_here, small_batches, written

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 64, 0.05
WORD_MEMORY = 150_000
#: Texts that a task trains on at least, while others are idle; words (about) that it takes together; rows of a batch that are Python strings at a time, and rows of a batch.
TASK_TEXTS, STRETCH, ROWS, BATCH_ROWS = 4096, 1 << 15, 256, 1024
#: Buckets whose counts or changes travel in one row; steps of a logit's unit that thresholds lie on, and its largest size.
SLICE, STEPS, LARGEST = 1 << 13, 128, 64
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def text_words(text: str | None) -> list[bytes]:
    """Lower-cased words, cut at ASCII other than letters and digits."""
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split() if text else []


def word_buckets(word: bytes) -> list[int]:
    """Buckets of the word and of its first letters."""
    digest = xxhash.xxh64_intdigest
    return [digest(word, 0) % BUCKETS, *(digest(word[:n], n) % BUCKETS for n in PREFIXES)]


class Network:
    """Embeddings (bucket, DIM), filters by width, output weights; thresholds by guessed language."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.full(FILTERS, -0.05, np.float32) for _ in WIDTHS]
        self.out = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.thresholds = np.zeros(1)
        self.language = np.zeros(BUCKETS, np.int16)  # 0: none

    def pooled(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over the rows of v (after rectifying), and where they lie."""
        top, at = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, -1)
        for i, w in enumerate(WIDTHS):
            n = len(v) - w + 1
            if n <= 0:
                continue
            act = v[:n] @ self.filters[i][:DIM]
            for j in range(1, w):
                act += v[j : j + n] @ self.filters[i][j * DIM : (j + 1) * DIM]
            k = act.argmax(axis=0)
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            top[own] = np.maximum(0, act[k, np.arange(FILTERS)] + self.shift[i])
            at[own] = np.where(top[own] > 0, k, -1)
        return top, at

    def best(self, v: np.ndarray) -> np.ndarray:
        """The maxima alone, over stretches of a bounded number of rows that overlap by the widest filter."""
        step, most = 65536, np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for a in range(0, max(1, len(v)), step):
            most = np.maximum(most, self.pooled(v[a : a + step + max(WIDTHS) - 1])[0])
        return most

    def logit(self, best: np.ndarray) -> float:
        return float(best @ self.out + self.bias)


class Trainer:
    """A task's copy of the network and of the sums of its squared gradients (Adagrad on the logistic loss)."""

    def __init__(self, net: Network, sums: np.ndarray, other_sums: np.ndarray, known: np.ndarray):
        self.known, self.emb, self.sums = known, net.emb.copy(), sums.copy()
        self.touched = np.zeros(BUCKETS, bool)
        self.width = np.repeat(WIDTHS, FILTERS)
        #: filters by place in the window (place, DIM, all filters), zero beyond their widths; then shifts, output weights and the bias
        self.inside = np.arange(max(WIDTHS))[:, None] < self.width
        self.cut = np.cumsum([max(WIDTHS) * DIM * len(self.width), len(self.width), len(self.width)])
        self.other, self.other_sums = dense(net), other_sums.copy()
        self.filters, self.shift, self.out, self.bias = self.parts(self.other)

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        filters, shift, out, bias = np.split(flat, self.cut)
        return filters.reshape(max(WIDTHS), DIM, -1), shift, out, bias

    def windows(self, stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over each stretch (before shifting; -inf where none fits), and the buckets under them (stretch, filter, place, bucket)."""
        ids, ends = np.concatenate(stretches), np.cumsum([*map(len, stretches)])
        v = self.emb.take(ids[:, 0], axis=0)
        for c in range(1, ids.shape[1]):
            v += self.emb.take(ids[:, c], axis=0)
        act = v @ self.filters[0]
        for j in range(1, max(WIDTHS)):
            act[:-j] += v[j:] @ self.filters[j]
        for j in range(1, max(WIDTHS)):  # windows of j + 1 places and more don't start at the last j
            act[np.ix_((ends[:, None] - np.arange(1, j + 1)).ravel(), self.width > j)] = -np.inf
        at = np.array([a + act[a:b].argmax(axis=0) for a, b in zip([0, *ends[:-1]], ends)])
        place = np.minimum(at[..., None] + np.arange(max(WIDTHS)), len(ids) - 1)
        return np.take_along_axis(act, at, axis=0), ids[place]

    def step(self, texts: list[list[np.ndarray]], labels: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch of texts, each given as its stretches of buckets."""
        n, k = len(texts), len(self.width)
        top, win = np.full((n, k), -np.inf, np.float32), np.zeros((n, k, max(WIDTHS), 1 + len(PREFIXES)), np.int32)

        def met(held: list[tuple[int, np.ndarray]]) -> None:
            if held:
                for (d, _), own, ids in zip(held, *self.windows([x for _, x in held]), strict=True):
                    more = own > top[d]
                    top[d], win[d] = np.where(more, own, top[d]), np.where(more[:, None, None], ids, win[d])

        held, size = [], 0
        for d, parts in enumerate(texts):
            for x in parts:
                if len(x):
                    if size + len(x) > 2 * STRETCH:
                        met(held)
                        held, size = [], 0
                    held.append((d, x))
                    size += len(x)
        met(held)
        top = np.maximum(0, top + self.shift)
        z = top @ self.out + self.bias[0]
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight / n).astype(np.float32)
        by = g[:, None] * self.out * (top > 0)
        v = self.emb[win].sum(axis=3) * self.inside.T[..., None]
        slope = np.concatenate([(np.einsum("nf,nfjd->jdf", by, v) + 1e-4 * self.filters).ravel(), by.sum(axis=0), g @ top, [g.sum()]]).astype(np.float32)
        rows = (by[:, :, None] != 0) & self.inside.T
        grads = (by[:, :, None, None] * self.filters.transpose(2, 0, 1))[rows]
        ids = win[rows]
        self.other_sums += slope * slope
        self.other -= RATE * slope / np.sqrt(self.other_sums)
        own = self.known[ids]
        where, back = np.unique(ids[own], return_inverse=True)
        total = np.zeros((len(where), DIM), np.float32)
        np.add.at(total, back, np.broadcast_to(grads[:, None], (*ids.shape, DIM))[own])
        self.sums[where] += total * total
        self.emb[where] -= RATE * total / np.sqrt(self.sums[where])
        self.touched[where] = True


def dense(net: Network) -> np.ndarray:
    """All weights of the network but its embeddings, as a trainer holds them."""
    filters = np.zeros((max(WIDTHS), DIM, len(WIDTHS) * FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        filters[:w, :, i * FILTERS : (i + 1) * FILTERS] = net.filters[i].reshape(w, DIM, FILTERS)
    return np.concatenate([filters.ravel(), *net.shift, net.out, [net.bias]]).astype(np.float32)


def put_back(net: Network, flat: np.ndarray) -> None:
    k = len(WIDTHS) * FILTERS
    filters = flat[: -2 * k - 1].reshape(max(WIDTHS), DIM, k)
    for i, w in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        net.filters[i], net.shift[i] = filters[:w, :, own].reshape(w * DIM, FILTERS).copy(), flat[-2 * k - 1 : -k - 1][own].copy()
    net.out, net.bias = flat[-k - 1 : -1].copy(), np.float32(flat[-1])


def threshold(logits: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The cut with the best balanced accuracy, in the middle of the widest such gap; of distinct logits and the texts of each label that have them."""
    order = np.argsort(logits)
    z, below1, below0 = logits[order], np.concatenate(([0], np.cumsum(positive[order]))), np.concatenate(([0], np.cumsum(negative[order])))
    good = (below1[-1] - below1) / max(1, below1[-1]) + below0 / max(1, below0[-1])
    edges = np.concatenate(([z[0] - 2], z, [z[-1] + 2]))
    width = np.minimum(edges[1:] - edges[:-1], 20)
    k = max(range(len(good)), key=lambda i: (round(float(good[i]), 9), width[i]))
    return float((edges[k] + edges[k + 1]) / 2)


class Buckets:
    """A worker's memory of the buckets of words, of a fixed number of them."""

    def __init__(self):
        self.rows, self.ids = {}, np.zeros((WORD_MEMORY, 1 + len(PREFIXES)), np.int32)

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets (word, 1 + prefixes) of the whole text, in stretches that overlap by the widest filter."""
        part: list[bytes] = []
        for own in stretches(text or "", 4 * STRETCH):
            part = part[len(part) - max(WIDTHS) + 1 :] + text_words(own) if len(part) >= max(WIDTHS) else part + text_words(own)
            at = [*map(self.rows.get, part)]
            if None in at:
                fresh = [w for w in dict.fromkeys(part) if w not in self.rows]
                if len(self.rows) + len(fresh) > WORD_MEMORY:
                    self.rows.clear()
                    fresh = list(dict.fromkeys(part))
                start = len(self.rows)
                self.ids[start : start + len(fresh)] = [word_buckets(w) for w in fresh]
                self.rows.update(zip(fresh, range(start, start + len(fresh)), strict=True))
                at = [*map(self.rows.__getitem__, part)]
            if part:
                yield self.ids.take(at, axis=0)


def laid_out(ids: np.ndarray) -> bytes:
    """Buckets (word, 1 + prefixes): their number, and in 9 bytes a word, compressed, the low 16 bits of each, then the high two of all."""
    high = (ids >> 16).astype(np.uint8) << np.arange(0, 2 * ids.shape[1], 2, dtype=np.uint8)
    return len(ids).to_bytes(4, "little") + pa.compress(ids.astype("<u2").tobytes() + np.bitwise_or.reduce(high, axis=1).tobytes(), "zstd", asbytes=True)


def taken_up(held: bytes) -> np.ndarray:
    """The buckets that `laid_out` wrote."""
    width, n = 1 + len(PREFIXES), int.from_bytes(held[:4], "little")
    held = pa.decompress(held[4:], n * (2 * width + 1), "zstd", asbytes=True)
    high = np.frombuffer(held, np.uint8, offset=2 * width * n)[:, None] >> np.arange(0, 2 * width, 2, dtype=np.uint8) & 3
    return np.frombuffer(held, "<u2", n * width).reshape(n, width) | high.astype(np.int32) << 16


class Scorer:
    """A worker's view of the network: word -> row of summed embeddings, up to a fixed number of words."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.vectors, self.languages = np.zeros((WORD_MEMORY, DIM), np.float32), np.zeros(WORD_MEMORY, np.int16)

    def indices(self, words: list[bytes]) -> np.ndarray:
        rows = self.rows
        at = [*map(rows.get, words)]
        if None not in at:
            return np.array(at, np.int64)
        fresh = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(fresh) > WORD_MEMORY:
            rows.clear()
            fresh = list(dict.fromkeys(words))
        if fresh:
            ids = np.array([word_buckets(w) for w in fresh])
            start = len(rows)
            self.vectors[start : start + len(fresh)] = self.net.emb[ids].sum(axis=1)
            self.languages[start : start + len(fresh)] = self.net.language[ids[:, 0]]
            rows.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def guess(self, text: str | None) -> tuple[int, float]:
        """The guessed language and the logit of the whole text."""
        words, overlap, step = text_words(text), max(WIDTHS) - 1, WORD_MEMORY // 4
        best, guesses = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(1 + self.net.language.max(initial=0), np.int64)
        for a in range(0, len(words), step):
            at = self.indices(words[a : a + step + overlap])
            best = np.maximum(best, self.net.best(self.vectors[at]))
            guesses += np.bincount(self.languages[at[:step]], minlength=len(guesses))
        language = int(guesses[1:].argmax()) + 1 if len(guesses) > 1 and guesses[1:].any() else 0
        return language, self.net.logit(best)

    def score(self, text: str | None) -> float:
        language, z = self.guess(text)
        z -= self.net.thresholds[language]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def untrained() -> Network:
    """Scores every text alike, below 0.5."""
    net = Network()
    net.emb[:] = 0
    return net


def bounded(rows: DataFrame, positive: int | None, negative: int | None, words: int | None) -> DataFrame:
    """Only for callers that bound what is learned from: of each label at most so many rows and words, by hashed id; texts that would pass `words` are passed over."""

    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        return pd.Series([len(text_words(t)) for t in texts], dtype="int64")

    most = {y: [(1 << 62) if n is None else n, (1 << 62) if words is None else words] for y, n in ((0, negative), (1, positive))}
    sized, fits = rows.withColumn("n", length("text")), []
    listed = sized.groupBy("doc_id", "y", "n", F.xxhash64("doc_id").alias("h")).count().collect()
    for r in sorted(listed, key=lambda r: (r.h, r.doc_id, r.n)):
        if r["count"] <= most[r.y][0] and r.n * r["count"] <= most[r.y][1]:
            most[r.y] = [most[r.y][0] - r["count"], most[r.y][1] - r.n * r["count"]]
            fits.append((r.doc_id, r.n))
    return sized.join(rows.sparkSession.createDataFrame(fits, "doc_id long, n long"), ["doc_id", "n"]).drop("n")


def perhaps_labelled(rows: DataFrame, of: DataFrame, count: int) -> DataFrame:
    """The rows whose id is in `of`, and about one in 33 others: a bitmap of hashed ids, 4 bytes for an id of `of`, is broadcast."""
    at = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(32 * max(1, count))) + 1
    bits = of.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "bucket")
    return found.where(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).select(*rows.columns)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS).to_pylist()


def with_buckets(rows: DataFrame) -> DataFrame:
    """(lang, y, later, words, text): the buckets of every row's whole text, by stretches, so that rounds need not cut it again; the text only where thresholds are set."""
    kind = pa.schema([("lang", pa.string()), ("y", pa.int32()), ("later", pa.bool_()), ("words", pa.list_(pa.binary())), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held_here("toxicity-buckets", Buckets)
        for part in rows_of(batches):
            yield pa.RecordBatch.from_pylist([r | {"words": [*map(laid_out, words.of(r["text"]))], "text": r["text"] if r["later"] else None} for r in part], kind)

    return rows.select("text", "lang", "y", "later").mapInArrow(cut, "lang string, y int, later boolean, words array<binary>, text string")


def counted(rows: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Over all rows (lang, and words or else text): the texts that hold each bucket, the names of the languages, and the language (from 1; 0: none) that a word's bucket tells."""

    if "words" not in rows.columns:
        rows = with_buckets(rows.select("text", "lang", F.lit(0).alias("y"), F.lit(False).alias("later")))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def add(key: tuple, at: np.ndarray) -> None:
            if key not in sums:
                sums[key] = np.zeros(BUCKETS, np.int32)
            sums[key][at] += 1  # once for a bucket, however often it stands in `at`

        for part in rows_of(batches):
            for r in part:
                ids = np.concatenate([np.zeros((0, 1 + len(PREFIXES)), np.int32), *map(taken_up, r["words"])])
                add((False, None), ids.ravel())
                if r["lang"] is not None:
                    add((True, r["lang"]), ids[:, 0])
        for (known, lang), n in sums.items():
            for a in range(0, BUCKETS, SLICE):
                yield pa.RecordBatch.from_pylist([{"of_lang": known, "lang": lang, "a": a, "n": n[a : a + SLICE].tobytes()}], pa.schema([("of_lang", pa.bool_()), ("lang", pa.string()), ("a", pa.int32()), ("n", pa.binary())]))

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i4") for x in part["n"]], axis=0, dtype=np.int64)
        return part.iloc[:1].assign(n=[total.tobytes()], total=[int(total.sum())])[["of_lang", "lang", "a", "n", "total"]]

    sums = written(rows.select("lang", "words").mapInArrow(counts, "of_lang boolean, lang string, a int, n binary").groupBy("of_lang", "lang", "a").applyInPandas(summed, "of_lang boolean, lang string, a int, n binary, total long"), "toxicity-counts")
    totals = {r.lang: r.total for r in sums.where("of_lang").groupBy("lang").agg(F.sum("total").alias("total")).collect()}
    names, held_by = sorted(totals), np.zeros(BUCKETS, np.int64)
    best, share, language = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS, np.int16)
    for r in sums.orderBy("lang", "a").toLocalIterator():
        own, n = slice(r.a, r.a + SLICE), np.frombuffer(r.n, "<i8")
        if not r.of_lang:
            held_by[own] += n
            continue
        mine = n / max(1, totals[r.lang])
        share[own] += mine
        language[own] = np.where(mine > best[own], names.index(r.lang) + 1, language[own])
        best[own] = np.maximum(best[own], mine)
    return held_by, names, np.where((held_by >= 3) & (best > 0.8 * share), language, 0).astype(np.int16)


def train(rows: DataFrame, net: Network, known: np.ndarray, weight: tuple[float, float]) -> None:
    """Rounds of all rows: every task trains its own copy, and the copies' changes are averaged."""
    context = rows.sparkSession.sparkContext
    sums, other_sums = np.full(net.emb.shape, 1e-2, np.float32), np.full(len(dense(net)), 1e-2, np.float32)

    def trained(sent, epoch: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Trainer(*sent.value), 0
            part, rng = TaskContext.get().partitionId(), np.random.default_rng(epoch)
            start, at, wait = own.emb.copy(), own.sums.copy(), []

            def learn(picked: list[dict]) -> None:
                y = np.array([r["y"] for r in picked])
                own.step([[*map(taken_up, r["words"])] for r in picked], y, np.where(y > 0, weight[1], weight[0]))

            for got in rows_of(batches):
                wait += [got[i] for i in rng.permutation(len(got))]
                while len(wait) >= BATCH:
                    learn(wait[:BATCH])
                    wait, seen = wait[BATCH:], seen + BATCH
            if wait:
                learn(wait)
                seen += len(wait)
            if not seen:
                return
            kind = pa.schema([("a", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("at", pa.binary()), ("x", pa.binary()), ("s", pa.binary())])
            yield pa.RecordBatch.from_pylist([{"a": -1, "part": part, "n": seen, "at": b"", "x": own.other.tobytes(), "s": own.other_sums.tobytes()}], kind)
            for a in range(0, BUCKETS, SLICE):
                where = np.flatnonzero(own.touched[a : a + SLICE]).astype(np.int32)
                if len(where):
                    moved = a + where
                    yield pa.RecordBatch.from_pylist([{"a": a, "part": part, "n": seen, "at": where.tobytes(), "x": (own.emb[moved] - start[moved]).tobytes(), "s": (own.sums[moved] - at[moved]).tobytes()}], kind)

        return run

    def averaged(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        if part["a"].iloc[0] < 0:
            x, s = (np.average([np.frombuffer(v, "<f4") for v in part[c]], axis=0, weights=part["n"]).astype("<f4") for c in "xs")
            return pd.DataFrame([(-1, b"", x.tobytes(), s.tobytes())], columns=["a", "at", "x", "s"])
        met, x, s = np.zeros(SLICE), np.zeros((SLICE, DIM)), np.zeros((SLICE, DIM))
        for r in part.itertuples():
            where = np.frombuffer(r.at, "<i4")
            met[where] += 1
            x[where] += np.frombuffer(r.x, "<f4").reshape(-1, DIM)
            s[where] += np.frombuffer(r.s, "<f4").reshape(-1, DIM)
        where = np.flatnonzero(met)
        mean = lambda v: (v[where] / met[where, None]).astype("<f4").tobytes()
        return pd.DataFrame([(part["a"].iloc[0], where.astype("<i4").tobytes(), mean(x), mean(s))], columns=["a", "at", "x", "s"])

    for epoch in range(EPOCHS):
        sent = context.broadcast((net, sums, other_sums, known))
        changes = rows.select("y", "words").mapInArrow(trained(sent, epoch), "a int, part int, n long, at binary, x binary, s binary").groupBy("a").applyInPandas(averaged, "a int, at binary, x binary, s binary").collect()
        for r in changes:  # the network's size at most
            x, s = np.frombuffer(r.x, "<f4"), np.frombuffer(r.s, "<f4")
            if r.a < 0:
                put_back(net, x)
                other_sums = s
            else:
                where = r.a + np.frombuffer(r.at, "<i4")
                net.emb[where] += x.reshape(-1, DIM)
                sums[where] += s.reshape(-1, DIM)
        sent.destroy()


def calibrate(rows: DataFrame, net: Network, languages: int) -> None:
    """Sets the thresholds from the logits of all rows, which are counted on a fixed grid."""
    sent, stamp = text_session(net), uuid.uuid4().hex

    @F.pandas_udf("language int, step int")
    def placed(texts: pd.Series) -> pd.DataFrame:
        scorer = held_here(("toxicity", stamp), lambda: Scorer(sent.value))
        return pd.DataFrame([(g, round(float(np.clip(z, -LARGEST, LARGEST)) * STEPS)) for g, z in map(scorer.guess, texts)], columns=["language", "step"])

    one = lambda y: F.sum((F.col("y") == y).cast("long"))
    got = rows.select("y", placed("text").alias("p")).groupBy("p.language", "p.step").agg(one(1).alias("positive"), one(0).alias("negative")).orderBy("language", "step").toPandas()
    net.thresholds = np.zeros(languages + 1)
    if not len(got):
        return
    cut = lambda x: threshold(x.index.to_numpy() / STEPS, x["positive"].to_numpy(), x["negative"].to_numpy())
    net.thresholds[:] = cut(got.groupby("step")[["positive", "negative"]].sum())
    for g, own in got.groupby("language"):
        if min(own["positive"].sum(), own["negative"].sum()) >= 10:
            net.thresholds[g] = cut(own.set_index("step"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", positive: int | None = None, negative: int | None = None, words: int | None = None) -> Network:
    """Learns from all labelled rows, whole texts; a caller may bound them (see `bounded`).

    Rows whose hashed id leaves 3 by 4 set the thresholds, all others train. What reaches the driver
    is of the network's size, and counts by language and logit.
    """
    of = written(labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")), "toxicity-labels")
    count, h = of.count(), F.xxhash64("doc_id", F.lit(1)).alias("h")
    tasks = max(1, min(count // TASK_TEXTS, docs.sparkSession.sparkContext.defaultParallelism))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # labels are dealt out among the texts and meet them there, so that a labelled text is shuffled once and others are not
    texts = perhaps_labelled(rows, of, count).select("*", F.lit(None).cast("int").alias("own"), F.lit(True).alias("is_text"), h)
    marks = of.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.col("y").alias("own"), F.lit(False).alias("is_text"), h)
    rows = texts.unionByName(marks).repartition(tasks, "h", "doc_id").withColumn("y", F.max("own").over(Window.partitionBy("h", "doc_id"))).where("is_text and y is not null")
    if not positive is negative is words is None:
        rows = bounded(rows, positive, negative, words)
        rows = rows.repartition(tasks, "h", "doc_id")
    rows = rows.withColumn("later", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3)
    # each task streams its rows, which are kept on the executors' disks until the network is made
    rows = with_buckets(rows.sortWithinPartitions("h", "doc_id", F.xxhash64("text"))).persist(StorageLevel.DISK_ONLY)
    try:
        n = {(r.later, r.y): r["count"] for r in rows.groupBy("later", "y").count().collect()}
        n1, n0 = (n.get((False, y), 0) for y in (1, 0))
        if not n1 + n.get((True, 1), 0) or not n0 + n.get((True, 0), 0):
            return untrained()
        net, (held_by, names, net_language) = Network(), counted(rows)
        net.language, known = net_language, held_by >= 3
        net.emb[~known] = 0
        train(rows.where("not later"), net, known, ((n0 + n1) * 0.5 / max(1, n0), (n0 + n1) * 0.5 / max(1, n1)))
        calibrate(rows.where("later"), net, len(names))
    finally:
        rows.unpersist()
    return net


def toxicity(text: Column, net: Network) -> Column:
    """Score (0 to 1) of each whole text; an empty or null text has that of no words."""
    sent, stamp = text_session(net), uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        scorer = held_here(("toxicity", stamp), lambda: Scorer(sent.value))
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", positive: int | None = None, negative: int | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from labelled rows that are not held out.

    Null and empty texts get the score of a text without words. Repeated rows and null ids stay.
    Of conflicting labels of one document the larger holds; null labels are ignored. Without labels
    of both kinds every score is that of an untrained unit, below 0.5. A score of exactly 0.5 counts
    as toxic. Long texts are scored whole, by stretches. An empty table gives none; other columns are
    not read.
    """
    held = held_out(F.col(id_col), 5, 0)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        net = fit(docs.where(~held), labels.where(~held_out(F.col(id_col), 5, 0)), id_col, text_col, lang_col, label_col, positive, negative)
    scored = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), toxicity(F.col(text_col), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, with all their columns; learned from labelled rows that are not held out.

    Null and empty texts stay, as do rows without an id; an empty table gives an empty result.
    """
    id_col, name = options.get("id_col", "doc_id"), "_lectern_toxicity"
    with small_batches(docs.sparkSession, BATCH_ROWS):
        net = fit(docs.where(~held_out(F.col(id_col), 5, 0)), labels.where(~held_out(F.col(id_col), 5, 0)), **options)
    return docs.withColumn(name, toxicity(F.col(options.get("text_col", "text")), net)).where(F.col(name) < 0.5).drop(name)
