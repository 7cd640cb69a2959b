"""Packing of tokenised documents into sequences by bin completion.

Lengths are whole numbers up to the sequence size, so the packing problem is a table of counts by
length, of bounded size however large the corpus. Branch and bound works on that table: around the
largest length left it enumerates undominated fillings, applies one as often as its counts allow,
prunes by a bound on waste, and keeps the best solution found, at first that of best-fit
decreasing. The pieces are then dealt to the places of the solution by their rank among pieces of
their length, with joins and windows whose groups are salted.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import held_here, small_batches, written
from .token_counts import byte_symbols

SEQUENCE = 2048
END_ID = 0
#: Fillings tried at a node, steps spent to find them, and nodes visited in all.
FILLINGS, STEPS, NODES = 4, 300, 6000
#: Words that a worker remembers, and as many from before.
WORD_MEMORY = 250_000
#: Rows of a batch whose texts are Python strings at a time.
ROWS = 1000
#: Characters of text whose words are looked up together, and the least character that the spelled-out pattern doesn't know.
STRETCH, NARROW = 1 << 20, 0x250
_WIDE, _EDGE = re.compile(f"[^\\x00-{chr(NARROW - 1)}]"), re.compile("[!-~](?= )")

Pattern = tuple[tuple[int, int], ...]  # (length, copies), lengths falling


# ---- ids --------------------------------------------------------------------


def members(category: str) -> str:
    """The characters below NARROW of a class such as `\\s`, escaped for a character set."""
    return "".join(f"\\x{i:02x}" if i < 256 else chr(i) for i in range(NARROW) if regex.fullmatch(category, chr(i)))


def narrow(pattern: str) -> str | None:
    """The pattern with its Unicode classes spelled out, right for texts of characters below NARROW; None if it holds other classes."""
    sets = {c: members(c) for c in (r"\p{L}", r"\p{N}", r"\s")}
    for inside in regex.findall(r"\[\^?(?:\\p\{\w\}|\\s)+\]", pattern):
        spelled = inside
        for c, chars in sets.items():
            spelled = spelled.replace(c, chars)
        pattern = pattern.replace(inside, spelled)
    for c, chars in sets.items():
        pattern = pattern.replace(c, f"[{chars}]")
    pattern = pattern.replace(r"\S", f"[^{sets[chr(92) + 's']}]")
    return None if r"\p" in pattern else pattern


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in parts of about `most` characters, cut before a blank that follows a visible character, where no word goes on."""
    a = 0
    while len(text) - a > most and (edge := _EDGE.search(text, a + most)):
        yield text[a : edge.end()]
        a = edge.end()
    yield text[a:]


class WordIds:
    """word -> its ids by the library as little-endian unsigned 32-bit; when full, forgets words not met since it was last full."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_file(path)
        #: the file's merges alone, for words that are cut already and written in its byte symbols
        self.merges = Tokenizer(library.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.any_words = regex.compile(pattern).findall
        spelled = narrow(pattern)
        self.narrow_words = re.compile(spelled).findall if spelled else self.any_words
        vocab, special = library.get_vocab(), {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.special_ids = {content: np.array([i], "<u4").tobytes() for content, i in special.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        #: bytes of text that each id stands for; a word's ids are told from the next one's by them
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for symbol, i in vocab.items():
            self.width[i] = len(symbol)

    def words(self, text: str) -> list[str]:
        return self.any_words(text) if _WIDE.search(text) else self.narrow_words(text)

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word; many words are given to the library at once."""
        out = []
        for a in range(0, len(words), 2000):
            part = [w.encode() for w in words[a : a + 2000]]
            written = " ".join([w.decode("latin-1").translate(self.symbols) for w in part])
            ids = np.array(self.merges.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()]
            held = ids.tobytes()
            out += [held[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def learn(self, lists: list[list[str]]) -> None:
        """Makes all words of the lists known."""
        if len(self.known) > WORD_MEMORY:
            self.known, self.before = {}, self.known
        unmet = set(itertools.chain.from_iterable(lists)).difference(self.known)
        met = unmet.intersection(self.before)
        self.known.update(zip(met, map(self.before.__getitem__, met), strict=True))
        fresh = [*unmet.difference(met)]
        self.known.update(zip(fresh, self.encode(fresh), strict=True))

    def parts(self, text: str) -> Iterator[bytes | list[str]]:
        """A stretch's words, and the ids of special tokens between them."""
        if self.special and any(content in text for content in self.special_ids):
            for part in self.special.split(text):
                yield self.special_ids[part] if part in self.special_ids else self.words(part)
        else:
            yield self.words(text)

    def ids_of(self, held: list[list[bytes | list[str]]]) -> list[bytes]:
        """Ids of texts given as their parts."""
        self.learn([p for parts in held for p in parts if isinstance(p, list)])
        find = self.known.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(find, p)) for p in parts) for parts in held]

    def of_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each whole text in turn; short texts are taken together up to STRETCH characters, long ones by stretches."""
        held, size = [], 0
        for text in texts:
            size += len(text or "")
            if size > STRETCH:
                yield from self.ids_of(held)
                held, size = [], len(text or "")
            if size > STRETCH:
                yield b"".join(self.ids_of([[*self.parts(stretch)]])[0] for stretch in stretches(text))
                size = 0
            else:
                held.append([*self.parts(text or "")])
        yield from self.ids_of(held)

    def of(self, text: str | None) -> bytes:
        return next(self.of_all([text]))


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full ones after a first that may be shorter."""
    first = n if n <= size else n % size or size
    return [(0, first), *((a, size) for a in range(first, n, size))]


def pieces(docs: DataFrame, path: str, pattern: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by END_ID."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held_here(("packing", path, pattern), lambda: WordIds(path, pattern))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(first, ROWS), []
                for row, own in enumerate(ids.of_all(part.column(1).to_pylist())):
                    got = own + END_ID.to_bytes(4, "little")
                    rows += [(row, k, a, n, zlib.crc32(got[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(got) // 4, size))]
                row, *numbers = zip(*rows, strict=True)
                columns = [part.column(0).take(pa.array(row)), *map(pa.array, numbers, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenised, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the solution on counts ---------------------------------------------------


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, equal bins together: (pattern, number of bins)."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            kept = []
            for pattern, m in open_bins.pop(room):
                k = room // length
                full = min(m, left // k)
                rest = min(left - full * k, k - 1) if full < m else 0
                for n, copies in ((full, k), (1 if rest else 0, rest)):
                    if n:
                        open_bins.setdefault(room - copies * length, []).append(((*pattern, (length, copies)), n))
                        left -= n * copies
                        m -= n
                if m:
                    kept.append((pattern, m))
            if kept:
                open_bins.setdefault(room, []).extend(kept)
            if not left:
                break
        k = size // length
        for n, copies in ((left // k, k), (1 if left % k else 0, left % k)):
            if n:
                open_bins.setdefault(size - copies * length, []).append((((length, copies),), n))
    return [b for bins in open_bins.values() for b in bins]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that any packing needs: by total size, and by what fits beside large pieces."""
    best = math.ceil(sum(n * c for n, c in counts.items()) / size)
    for small in {n for n in counts if 2 * n <= size} | {0}:
        top = sum(c for n, c in counts.items() if n > size - small)
        middle = [(n, c) for n, c in counts.items() if 2 * n > size and n <= size - small]
        beside = sum((size - n) * c for n, c in middle)
        low = sum(n * c for n, c in counts.items() if small <= n and 2 * n <= size)
        best = max(best, top + sum(c for _, c in middle) + max(0, math.ceil((low - beside) / size)))
    return best


def fillings(counts: list[int], largest: int, room: int) -> list[Pattern]:
    """Undominated fillings of `room` with what is left, fullest first; the search is bounded by STEPS.

    A filling is dominated if a length left out fits in place of one it holds, or of two together,
    that are no longer than it.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def dominated(chosen: tuple[int, ...], free: int) -> bool:
        used: dict[int, int] = {}
        for n in chosen:
            used[n] = used.get(n, 0) + 1
        spare = lambda n: counts[n] - used.get(n, 0) - (n == largest) > 0
        if any(spare(n) for n in range(1, free + 1)):
            return True
        sums = {*chosen, *(a + b for i, a in enumerate(chosen) for b in chosen[:i])}
        return any(spare(n) for s in sums for n in range(s + (s in chosen), s + free + 1) if n < len(counts) and n not in chosen)

    def search(limit: int, free: int, chosen: tuple[int, ...]) -> bool:
        """False once enough is found or the steps are spent."""
        nonlocal steps
        used = chosen.count
        below = [n for n in range(min(limit, free), 0, -1) if counts[n] > used(n) + (n == largest)]
        if not below:
            found.append((free, chosen))
            return sum(f == 0 for f, _ in found) < FILLINGS
        if below[0] != free and free <= limit and counts[free] > used(free) + (free == largest):
            below.insert(0, free)
        for n in below:
            steps += 1
            if steps > STEPS:
                return False
            if not search(n, free - n, (*chosen, n)):
                return False
        return True

    search(room, room, ())
    found.sort(key=lambda x: x[0])
    best = [chosen for free, chosen in found if not dominated(chosen, free)] or [chosen for _, chosen in found[:1]]
    out: dict[Pattern, None] = {}
    for chosen in best:
        full = sorted((largest, *chosen), reverse=True)
        out[tuple((n, full.count(n)) for n in dict.fromkeys(full))] = None
    return [*out][:FILLINGS] or [((largest, 1),)]


def complete_bins(counts: dict[int, int], size: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """(pattern, number of bins) with as few bins as the search finds, never more than best fit."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    best = best_fit(counts, size)
    n_best, bound = sum(m for _, m in best), lower_bound(counts, size)
    total = sum(n * c for n, c in counts.items())
    left = [0] * (size + 1)
    for n, c in counts.items():
        left[n] = c
    path: list[tuple[Pattern, int]] = []
    bins = waste = 0

    def options() -> Iterator[tuple[Pattern, int]]:
        largest = next(n for n in range(size, 0, -1) if left[n])
        for pattern in fillings(left, largest, size - largest):
            most = min(left[n] // k for n, k in pattern)
            yield pattern, most
            if most > 1:
                yield pattern, 1

    def move(pattern: Pattern, m: int) -> None:
        nonlocal bins, waste
        for n, k in pattern:
            left[n] -= k * m
        bins += m
        waste += m * (size - sum(n * k for n, k in pattern))

    stack = [options()]
    while stack and n_best > bound and nodes > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                pattern, m = path.pop()
                move(pattern, -m)
            continue
        nodes -= 1
        pattern, m = step
        move(pattern, m)
        path.append(step)
        if math.ceil((total + waste) / size) >= n_best:  # no better than the incumbent
            move(pattern, -m)
            path.pop()
        elif not any(left):
            best, n_best = list(path), bins
            move(pattern, -m)
            path.pop()
        else:
            stack.append(options())
    return best


def places(solution: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies in a bin, first bin, offset of the first copy in its bin)."""
    ranks: dict[int, int] = {}
    out, first_bin = [], 0
    for pattern, m in solution:
        offset = 0
        for n, k in pattern:
            out.append((n, ranks.get(n, 0), k * m, k, first_bin, offset))
            ranks[n] = ranks.get(n, 0) + k * m
            offset += n * k
        first_bin += m
    return out


# ---- dealing ------------------------------------------------------------------


def pack(cuts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """`cuts` (a table already written: doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = cuts.sparkSession
    counts = {r.length: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most `size` rows
    spots = spark.createDataFrame(places(complete_bins(counts, size)), "length long, first_rank long, ranks long, copies long, first_bin long, first_offset long")
    salts = max(64, math.ceil(sum(counts.values()) / 1_000_000))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n"))
    placed = ranked.join(F.broadcast(spots), (ranked.length == spots.length) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))).drop(spots.length)
    at = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: where it comes from and where it lies.

    Null and empty texts are one piece that holds the end id alone. Repeated rows and null ids are
    packed like others; ties between equal lengths go by a hash of the id, then by the id. An empty
    table gives an empty result; other columns are not read.
    """
    with small_batches(docs.sparkSession, ROWS):
        cuts = written(pieces(docs, path, pattern, size, id_col, text_col), "pieces")
    return pack(cuts, size)
