import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers
import pytest

from lectern.llm.alignment import Aligner, align_documents, packed, ranges, row, unpacked

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
POOL = "aAthe eintn 's  \t\n\x1c\x85　éÉÑß漢字1٣½-_!😀éİΣσς<0x41>"


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(POOL + "▁" * (k % 9 == 0), k=rng.randrange(60))) for k in range(n)]
    return [*texts, "", " ", "x" * 5000, "the " * 3000, "é" * 900, "  " * 500, "<|endoftext|> <s> a", "漢字" * 700 + " a b " * 50, "a\nb " * 300, "\x00", "two  blanks "]


def plain(aligner, text):
    """n_a, n_b, groups as written, links: by the libraries and sets of offsets."""
    spaced = (" " + (text or "")).encode()
    a, b = aligner.a.library.encode(spaced.decode(), add_special_tokens=False).ids, aligner.b.model.encode(text or "")
    sides = [(ids, [own[i] for i in ids]) for ids, own in ((a, aligner.a.bytes), (b, aligner.b.bytes))]
    if not text or any(b"".join(x) != spaced for _, x in sides):
        return 0, 0, [], []
    ends = [[*itertools.accumulate(map(len, x))] for _, x in sides]
    groups, links, i, j = [], [], 0, 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        p, q = i, j
        while i < len(a) and ends[0][i] <= c:
            i += 1
        while j < len(b) and ends[1][j] <= c:
            j += 1
        groups.append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
        links.append((a[i - 1], b[j - 1]))
    return len(a), len(b), groups, links


def digest(groups):
    return hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""


def test_whole_texts_and_fragments_in_any_association(aligner):
    rng = random.Random(1)
    for text, f in zip(texts := odd_texts(800), aligner.whole(texts), strict=True):
        n_a, n_b, groups, links = plain(aligner, text)
        got = row(f)
        assert got[:5] == (n_a, n_b, len(groups), len(links), digest(groups))
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(map(int, got[5]), got[6], strict=True)} == Counter(links)
        for size in (16, 40) if text else ():
            parts = [unpacked(*packed(aligner.part(*x))) for x in ranges(text, size)]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [aligner.compose(parts[i], parts[i + 1])]
            again = row(aligner.finished(parts[0]))
            assert again[:5] == got[:5] and [*again[5]] == [*got[5]] and [*again[6]] == [*got[6]]


@pytest.mark.parametrize("hot", [0, 50, 10**6])
def test_counts_over_the_corpus(spark, aligner, hot):
    texts = odd_texts(150, 7) + [None, "again and again", "again and again"]
    rows = [(None if k == 3 else k // 2, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    want, own = Counter(), []
    for doc_id, text, _ in rows:
        own.append((doc_id, *plain(aligner, text)))
        want.update(own[-1][-1])
    top = {}
    for (_, b), n in want.items():
        top[b] = max(top.get(b, 0), n)
    expected = [(d, a, b, len(g), len(x), sum(want[y] == top[y[1]] for y in x), sum(want[y] for y in x), digest(g)) for d, a, b, g, x in own]
    got = align_documents(docs, A, B, chunk=64, hot=hot).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert len({r.count_sum for r in got if r.groups_sha256 == digest(plain(aligner, "again and again")[2])}) == 1


def test_empty_table(spark):
    assert align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
