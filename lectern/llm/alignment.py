"""Alignment of two tokenisations of each text, and how often which tokens end together.

A byte range of a text is a fragment: an open prefix (all that lies up to the first offset where
tokens of both sides end), closed groups, and an open suffix. Fragments compose, associatively:
the left suffix and the right prefix meet and give closed groups of their own. A text of up to
CHUNK bytes is one fragment of its task; a longer one is cut into byte ranges, which Spark deals
out, and their fragments are composed by a tree of groups of FAN neighbours.

Links are counted over the whole corpus by pair of ids. Documents get their links' counts back by
joins on the pair: the most frequent pairs, HOT of them at most, are broadcast, so that no frequent
pair is left in the shuffle of the others.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import _WIDE
from .shared import held_here, written
from .token_counts import byte_symbols

CHUNK, FAN, HOT = 1 << 16, 16, 400_000
#: Short stretches that a worker remembers, and as many from before; their length.
UNITS, LONGEST = 120_000, 64
#: Places where the sides may be cut without changing a token: before a blank that follows a visible
#: character of ASCII (left), before a blank that follows anything else than a blank (right).
_LEFT_EDGE, _RIGHT_EDGE, _UNIT = re.compile("[!-~](?= )"), re.compile("[^ ▁](?= )"), re.compile("(?<=[!-~])(?= )")
_NONE = np.zeros((0, 2), np.int64)

Tokens = np.ndarray  # rows of (id, byte offset of the end)


class LeftIds:
    """Ids and widths of a byte-level tokenizer file; texts of common characters take the same merges as ranks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(map(of.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if i not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        #: merges stand in the order of their ids, so that the lowest rank is the lowest id
        self.ranked = tiktoken.Encoding("left", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None
        self.bytes = [b""] * (max([*special, *ranks.values()]) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.widths = [*map(len, self.bytes)]
        self.width = np.array(self.widths, np.int64)

    @functools.cached_property
    def library(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def of(self, text: str) -> list[int]:
        if not text:
            return []
        if self.ranked is None or _WIDE.search(text):
            return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.ranked.encode_ordinary(text)


class RightIds:
    """Ids and widths of a piece model, which puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = lambda i: b"" if self.model.is_control(i) or self.model.is_unknown(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = [bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i) else plain(i) for i in range(n)]
        self.widths = [*map(len, self.bytes)]
        self.width = np.array(self.widths, np.int64)
        self.blank = self.model.piece_to_id("▁")

    def of(self, text: str) -> list[int]:
        """Ids of a stretch that begins with a blank."""
        return self.model.encode(text[1:], num_threads=1) if len(text) > 1 else [self.blank] * len(text)


@dataclass
class Fragment:
    """`cut`: whether some offset ends tokens of both sides, or is known to. Without one, all tokens are in `tail`."""

    n_a: int = 0
    n_b: int = 0
    cut: bool = False
    head: tuple[Tokens, Tokens] = (_NONE, _NONE)
    tail: tuple[Tokens, Tokens] = (_NONE, _NONE)
    groups: int = 0
    closed: list[bytes] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    exact: bool = True


def common(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of both sides that end together."""
    if not (len(a) and len(b)):
        return _NONE[:, 0], _NONE[:, 0]
    place = np.searchsorted(b[:, 1], a[:, 1])
    last_a = np.flatnonzero(b[np.minimum(place, len(b) - 1), 1] == a[:, 1])
    return last_a, place[last_a]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = LeftIds(a_path), RightIds(b_path)
        self.known: dict[str, tuple[bytes, bytes, int]] = {}
        self.before: dict[str, tuple[bytes, bytes, int]] = {}
        n, m = len(self.a.bytes), len(self.b.bytes)
        #: what is written for a token within a group and at its end, for both sides
        self.written = [b"%d%s" % (i, mark) for count, marks in ((n, (b",", b"|")), (m, (b",", b";"))) for mark in marks for i in range(count)]

    def write(self, tokens: tuple[Tokens, Tokens], last_a: np.ndarray, last_b: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """What is written for each token of closed groups, in order, and their links; last_a and last_b are the places of the groups' last tokens."""
        if not len(last_a):
            return [], _NONE[:, 0]
        ids_a, ids_b = tokens[0][: last_a[-1] + 1, 0], tokens[1][: last_b[-1] + 1, 0]
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[last_a], mark_b[last_b] = len(self.a.bytes), len(self.b.bytes)
        codes[np.arange(len(ids_a)) + np.repeat(last_b + 1 - sizes_b, sizes_a)] = ids_a + mark_a
        codes[np.arange(len(ids_b)) + np.repeat(last_a + 1, sizes_b)] = ids_b + mark_b + 2 * len(self.a.bytes)
        return [*map(self.written.__getitem__, codes.tolist())], ids_a[last_a] << 32 | ids_b[last_b]

    def fragment(self, a: Tokens, b: Tokens, opening: bool = False) -> Fragment:
        """The fragment of neighbouring tokens; with `opening`, its prefix is known to begin where a group does, and is closed."""
        f, (last_a, last_b) = Fragment(len(a), len(b)), common(a, b)
        if not len(last_a):
            f.tail = (a, b)
            return f
        f.cut = True
        i, j = (0, 0) if opening else (last_a[0] + 1, last_b[0] + 1)
        f.head, f.tail = (a[:i], b[:j]), (a[last_a[-1] + 1 :], b[last_b[-1] + 1 :])
        written, links = self.write((a[i:], b[j:]), last_a[not opening :] - i, last_b[not opening :] - j)
        if len(links):
            f.groups, f.closed, f.links = len(links), [b"".join(written)], [links]
        return f

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        """The fragment of two neighbouring byte ranges."""
        right = y.head if y.cut else y.tail
        mid = self.fragment(np.concatenate([x.tail[0], right[0]]), np.concatenate([x.tail[1], right[1]]), opening=x.cut)
        parts = (x, mid, y) if y.cut else (x, mid)
        # where y begins with closed groups, what lies before them is a prefix even if no offset in it is known to end both sides
        head = x.head if x.cut else mid.head if mid.cut else mid.tail
        return Fragment(
            x.n_a + y.n_a, x.n_b + y.n_b, x.cut or mid.cut or y.cut, head, y.tail if y.cut else mid.tail,
            sum(p.groups for p in parts), sum((p.closed for p in parts), []), sum((p.links for p in parts), []), x.exact and y.exact,
        )

    def finished(self, f: Fragment) -> Fragment:
        """`f` as a whole text: the prefix is closed too."""
        return self.compose(Fragment(cut=True), f)

    def learn(self, units: set[str]) -> None:
        """Makes short stretches known that both sides are cut around: their closed groups, links and numbers of tokens (left * 2**32 + right).

        Those that end in a visible character are given to the libraries as one text. A stretch that
        a side does not give back stays unknown.
        """
        if len(self.known) > UNITS:
            self.known, self.before = {}, self.known
        unmet = units.difference(self.known)
        met = unmet.intersection(self.before)
        self.known.update(zip(met, map(self.before.__getitem__, met), strict=True))
        fresh = [u for u in unmet.difference(met) if len(u) <= LONGEST]
        last = [u for u in fresh if not "!" <= u[-1] <= "~"]
        inner = [*set(fresh).difference(last)]
        for group in [inner[i : i + 5000] for i in range(0, len(inner), 5000)] + [[u] for u in last]:
            self.known.update(self.units(group))

    def units(self, group: list[str]) -> dict[str, tuple[bytes, bytes, int]]:
        text = "".join(group)
        a, b = self.both(text, text, 0, 0)
        if a is None:
            return {} if len(group) == 1 else {k: v for u in group for k, v in self.units([u]).items()}
        last_a, last_b = common(a, b)
        written, links = self.write((a, b), last_a, last_b)
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in group), np.int64, len(group)))
        last = np.searchsorted(a[last_a, 1], ends)  # of a unit's groups
        of_a, of_b = last_a[last] + 1, last_b[last] + 1
        n = (np.diff(of_a, prepend=0) << 32 | np.diff(of_b, prepend=0)).tolist()
        tokens, groups, links = [0, *(of_a + of_b).tolist()], [0, *(8 * (last + 1)).tolist()], links.tobytes()
        return {u: (b"".join(written[i:j]), links[k:m], c) for u, i, j, k, m, c in zip(group, tokens, tokens[1:], groups, groups[1:], n, strict=False)}

    def both(self, left: str, right: str, at_a: int, at_b: int) -> tuple[Tokens | None, Tokens]:
        """Tokens of two stretches that begin with a blank, or are empty, at these byte offsets; None if a side does not give its stretch back."""
        ids_a, ids_b = self.a.of(left), self.b.of(right)
        if b"".join(map(self.a.bytes.__getitem__, ids_a)) != left.encode() or b"".join(map(self.b.bytes.__getitem__, ids_b)) != right.encode():
            return None, _NONE
        stack = lambda ids, width, at: np.stack([ids, np.cumsum(width[ids]) + at], axis=1) if len(ids) else _NONE
        return stack(np.array(ids_a, np.int64), self.a.width, at_a), stack(np.array(ids_b, np.int64), self.b.width, at_b)

    def tokens(self, left: str, right: str, at_a: int, at_b: int) -> Fragment:
        a, b = self.both(left, right, at_a, at_b)
        return Fragment(exact=False) if a is None else self.fragment(a, b)

    def closed(self, texts: list[str]) -> Iterator[Fragment]:
        """The fragments of stretches that both sides are cut around, from what is known of their units."""
        held = [*map(_UNIT.split, texts)]
        self.learn(set(itertools.chain.from_iterable(held)))
        for units in held:
            f = Fragment(cut=True)
            try:
                self.settle(f, [*map(self.known.__getitem__, units)])
            except KeyError:  # long ones, or such as a side does not give back
                for unit in units:
                    if unit in self.known:
                        self.settle(f, [self.known[unit]])
                    else:
                        f = self.compose(f, self.tokens(unit, unit, 0, 0))
            yield f

    def settle(self, f: Fragment, units: list[tuple[bytes, bytes, int]]) -> None:
        f.closed.append(b"".join([g for g, _, _ in units]))
        f.links.append(np.frombuffer(b"".join([x for _, x, _ in units]), np.int64))
        n = sum([n for _, _, n in units])
        f.n_a, f.n_b, f.groups = f.n_a + (n >> 32), f.n_b + (n & 0xFFFFFFFF), f.groups + len(f.links[-1])

    def part(self, lead: str, lead_at: int, both: str, left: str, right: str, at: int) -> Fragment:
        """The fragment of a byte range: what the right side has at the byte offset `lead_at`, the stretch `both`, which begins at `at`, and what each side has behind it."""
        f = self.tokens("", lead, at, lead_at)
        if both:
            f, at = self.compose(f, next(self.closed([both]))), at + len(both.encode())
        return self.compose(f, self.tokens(left, right, at, at))

    def whole(self, texts: list[str | None]) -> Iterator[Fragment]:
        """The fragments of whole texts; empty ones for null and empty texts. Texts are taken together up to a megabyte."""
        first, size = 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text or "")
            if size > 1 << 20 or k == len(texts):
                made = self.closed([" " + t for t in texts[first:k] if t])
                yield from (next(made) if t else Fragment() for t in texts[first:k])
                first, size = k, 0


def held(a_path: str, b_path: str) -> Aligner:
    return held_here(("alignment", a_path, b_path), lambda: Aligner(a_path, b_path))


def ranges(text: str, size: int) -> list[tuple[str, int, str, str, str, int]]:
    """The byte ranges of a text with its blank, as Aligner.part takes them.

    In each range a side is cut at its own first edge, or goes on where it has none; so a range
    begins and ends within groups.
    """
    spaced, marks, at = " " + text, [(0, 0)], 0
    step = max(1, size // 4)  # characters; a range has `size` bytes at most but for what follows until an edge
    while at + step < len(spaced):
        at += step
        a, b = _LEFT_EDGE.search(spaced, max(at, marks[-1][0])), _RIGHT_EDGE.search(spaced, max(at, marks[-1][1]))
        marks.append((a.end() if a else len(spaced), b.end() if b else len(spaced)))
        at = max(at, min(marks[-1]))
    marks = [*dict.fromkeys(marks), (len(spaced), len(spaced))]
    out, offset = [], 0
    for (a, b), (c, d) in zip(marks, marks[1:]):  # every edge of the left side is one of the right side, so b <= a and d <= c
        if a < c or b < d:
            edges = [m.end() for m in _LEFT_EDGE.finditer(spaced, max(a - 1, d - 2000), d + 1) if a <= m.end() <= d] if a < d else []
            e = edges[-1] if edges else min(a, d)
            lead, both, left, right = spaced[b : min(a, d)], spaced[a:e], spaced[max(a, e) : c], spaced[max(min(a, d), e) : d]
            out.append((lead, offset - len(spaced[b:a].encode()), both, left, right, offset))
        offset += len(spaced[a:c].encode())
    return out


RANGE = ["lead", "lead_at", "both", "left", "right", "at"]
ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
PART = "exact boolean, n_a long, n_b long, cut boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, n_groups long, closed binary, links binary"


def row(f: Fragment) -> tuple:
    """A finished fragment as n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
    if not f.exact or not f.groups:
        return 0, 0, 0, 0, "", [], []
    pairs, times = np.unique(np.concatenate(f.links), return_counts=True)
    digest = hashlib.sha256()
    for k, text in enumerate(f.closed):
        digest.update(text if k < len(f.closed) - 1 else text[:-1])
    return f.n_a, f.n_b, f.groups, f.groups, digest.hexdigest(), pairs, times


def packed(f: Fragment) -> tuple:
    return f.exact, f.n_a, f.n_b, f.cut, *(t.tobytes() for t in (*f.head, *f.tail)), f.groups, b"".join(f.closed), b"".join(x.tobytes() for x in f.links)


def unpacked(exact, n_a, n_b, cut, head_a, head_b, tail_a, tail_b, groups, closed, links) -> Fragment:  # noqa: ANN001
    t = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in (head_a, head_b, tail_a, tail_b)]
    return Fragment(n_a, n_b, cut, (t[0], t[1]), (t[2], t[3]), groups, [closed] if closed else [], [np.frombuffer(links, np.int64)] if links else [], exact)


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the linked pairs (left id * 2**32 + right id) with their times, one row for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.octet_length("text") > chunk
    row_of, parts_of = ([f.split(" ")[0] for f in fields.split(", ")] for fields in (ROW, PART))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(a_path, b_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                made = zip(*map(row, aligner.whole(part.column(2).to_pylist())), strict=True)
                kinds = [*[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, made, kinds)], names=["rid", "doc_id", *row_of])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = ranges(text, chunk)
                n = len(own)
                same = pa.array([k] * n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(range(n), pa.int64()), *map(pa.array, zip(*own, strict=True))], names=["rid", "doc_id", "k", *RANGE])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = held(a_path, b_path)
        for batch in batches:
            made = [packed(aligner.part(*x)) for x in batch[RANGE].itertuples(index=False, name=None)]
            yield pd.concat([batch[["rid", "doc_id", "k"]], pd.DataFrame(made, columns=parts_of)], axis=1)

    def joined(last: bool):  # noqa: ANN202
        def neighbours(part: pd.DataFrame) -> pd.DataFrame:
            aligner, part = held(a_path, b_path), part.sort_values("k")
            f = None
            for x in map(unpacked, *(part[n] for n in parts_of)):
                f = x if f is None else aligner.compose(f, x)
            rid, doc_id, k = (part[c].iloc[0] for c in ("rid", "doc_id", "k"))
            return pd.DataFrame([[rid, doc_id, *row(aligner.finished(f))] if last else [rid, doc_id, k // FAN, *packed(f)]], columns=["rid", "doc_id", *(row_of if last else ["k", *parts_of])])

        return neighbours

    short = rows.where(~long).mapInArrow(whole, f"rid long, doc_id {kind}, {ROW}")
    largest = rows.where(long).agg(F.max(F.octet_length("text"))).first()[0]
    if largest is None:
        return short
    parts = rows.where(long).mapInArrow(cut, f"rid long, doc_id {kind}, k long, lead string, lead_at long, both string, left string, right string, at long")
    tree = parts.repartition("rid", "k").mapInPandas(first, f"rid long, doc_id {kind}, k long, {PART}")
    width = 4 * largest // chunk + 2  # a range has a quarter of `chunk` characters or more
    while width:
        width = -(-width // FAN)
        last = width == 1
        tree = tree.groupBy("rid", (F.col("k") / FAN).cast("long").alias("of")).applyInPandas(joined(last), f"rid long, doc_id {kind}, {ROW if last else 'k long, ' + PART}")
        width -= last
    return short.unionByName(tree)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count, best (the highest of its right id) over (rid, pair, times)."""
    n = links.groupBy("pair").agg(F.sum("times").alias("count"))
    return n.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))))


def frequent(pairs: DataFrame, most: int) -> int:
    """The least count that at most `most` pairs have."""
    counts = pairs.groupBy("count").agg(F.count("*").alias("n"))
    # distinct counts of pairs above the least are as many as the largest ones at most, which add up to the corpus: bounded by the root of its links
    top = counts.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("count"))))
    least = top.where(F.col("above") <= most).agg(F.min("count")).first()[0]
    return least if least is not None else (1 << 62)


def align_documents(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Null and empty texts, and texts that either side does not give back byte by byte, have zeros and
    an empty digest. Ties of counts are all best. Repeated rows and null ids are kept, one row each,
    and count as often as they occur; an empty table gives an empty result; other columns are not
    read. A text's groups must fit a row (2 GB).
    """
    each = written(aligned(docs, a_path, b_path, chunk, id_col, text_col), "alignment")
    links = each.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    pairs = written(pair_counts(links), "alignment-pairs")
    least = frequent(pairs, hot)
    top, rest = pairs.where(F.col("count") >= least), pairs.where(F.col("count") < least)
    said = F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best")
    common = links.join(F.broadcast(top), "pair").groupBy("rid").agg(*said)
    rare = links.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(rest, "pair").groupBy("rid").agg(*said)
    sums = common.unionByName(rare).groupBy("rid").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return each.join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
