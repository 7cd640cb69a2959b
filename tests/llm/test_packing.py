import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm import packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def fewest(lengths, size):
    """Bins by brute force."""
    best = len(lengths)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= size and bins[i] not in bins[:i]:
                go(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best


def checked(counts, solution, size):
    got = {}
    for pattern, m in solution:
        assert m > 0 and sum(n * k for n, k in pattern) <= size
        for n, k in pattern:
            got[n] = got.get(n, 0) + k * m
    assert got == {n: c for n, c in counts.items() if c}
    return sum(m for _, m in solution)


def test_solutions():
    rng = random.Random(5)
    for _ in range(60):
        size = rng.choice((10, 20, 37))
        lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 12))]
        counts = {n: lengths.count(n) for n in lengths}
        best = fewest(lengths, size)
        assert packing.lower_bound(counts, size) <= best
        assert best <= checked(counts, packing.best_fit(counts, size), size)
        assert checked(counts, packing.complete_bins(counts, size), size) == best
    large = {n: rng.randrange(1, 400) for n in range(1, 2049, 3)}
    assert checked(large, packing.complete_bins(large, 2048), 2048) <= packing.lower_bound(large, 2048) * 1.01 + 1
    assert packing.complete_bins({}, 10) == []


def test_ids_equal_the_library():
    library, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH, PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choices("aAbé'sT  \n\t.,1٣ß😀漢", k=rng.randrange(20))) + "<|endoftext|>" * (i % 9 == 0) for i in range(1500)]
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_and_full_memory(monkeypatch):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    pieces = ["word", " ", "  ", "\n", " \n", "'s", "é", "x1", "¾", "\x1c", "\x85", "\xa0", "日", "<|endoftext|>", "!?", " and", "\u0250"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(400))) for _ in range(200)]
    monkeypatch.setattr(packing, "STRETCH", 300)
    monkeypatch.setattr(packing, "WORD_MEMORY", 50)
    monkeypatch.setattr(packing.stretches, "__defaults__", (300,))
    got = [*packing.WordIds(PATH, PATTERN).of_all([*texts, None, "", "".join(texts)])]
    want = [library.encode(t, add_special_tokens=False).ids for t in [*texts, "", "", "".join(texts)]]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_fillings_are_undominated():
    rng = random.Random(5)
    for _ in range(100):
        counts = [0] + [rng.choice((0, 0, 1, 2)) for _ in range(30)]
        if not any(counts):
            continue
        largest = max(n for n, c in enumerate(counts) if c)
        for pattern in packing.fillings(counts, largest, 40 - largest):
            used = dict(pattern)
            free = 40 - sum(n * k for n, k in pattern)
            assert free >= 0 and all(counts[n] >= k for n, k in pattern)
            assert not any(counts[n] > used.get(n, 0) for n in range(1, min(free, 30) + 1))


def test_rows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("alpha beta gamma delta,.".split(), k=rng.choice((1, 30, 300, 5000)))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (None, "one two", "x"), (3, texts[3], "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH, PATTERN).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(itertools.pairwise(cuts))]
    order = lambda x: (x[0] is None, x)
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_seq) <= packing.lower_bound({n: [w[3] for w in want].count(n) for n in {w[3] for w in want}}, 2048) + 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_texts_come_in_small_batches(spark, monkeypatch):
    """A worker is never handed more than ROWS texts at once, and the session's own setting holds again afterwards."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "written", lambda df, tag, made=packing.written: (seen.append(int(spark.conf.get(name))), made(df, tag))[1])
    rows = [(k, "a b") for k in range(10)]
    assert packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 10
    assert seen[0] <= packing.ROWS < 10_000 and spark.conf.get(name) == before
