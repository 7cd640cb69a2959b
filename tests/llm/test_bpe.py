import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm.bpe import Ranks, last_merge, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
POOL = "aAthe eintn 's'LL  \t\n\x1c\x85　éÉÑß漢字1٣½-_!😀éİΣσς \x00￿\U00031350\U0001e4d0"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def said(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest(library.decode_bytes(ids))


@pytest.mark.parametrize("words", [0, 40, 10**6])
def test_equals_the_library(spark, library, words):
    rng = random.Random(words)
    texts = ["".join(rng.choices(POOL, k=rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 3000, "the " * 3000, "é" * 900, " " * 700, "<|endoftext|>", "aaaaaaa aaaaaa", "\r\n" * 60, "same words here", "same words here", "".join(rng.choices("acgt", k=3000))]
    rows = [(None if k == 5 else k // 2, t, "x") for k, t in enumerate(texts)]
    got = round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), PATH, public_tokenizers.PATTERN, words).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(said(library, d, t)) for d, t, _ in rows)


def test_every_token_is_its_own_code(spark, library):
    """The premise of folding by rank: a token's bytes encode to the token alone, and its parts by lower ranks to the two that it joins."""
    ranks = {t: i for i in range(50256) for t in [library.decode_single_token_bytes(i).decode("latin-1")]}
    assert all(library.encode_single_token(t.encode("latin-1")) == library._encode_single_piece(t.encode("latin-1"))[0] for t in ranks)
    for token in random.Random(1).sample([t for t in ranks if len(t) > 1], 2000):
        k = last_merge(token, ranks)
        assert ranks[token[:k]] < ranks[token] and ranks[token[k:]] < ranks[token]


def test_ids_and_bytes_of_words(spark, library):
    own, words = Ranks(PATH), ["a", " hello", "漢字", "x" * 300, "\x00\x01"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", own.encode(F.col("w")).alias("ids")).select("w", "ids", own.decode(F.col("ids")).alias("b")).collect()
    for r in got:
        assert r.ids == library.encode_ordinary(r.w) and r.b.encode("latin-1") == r.w.encode()


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0


def test_tokens_of_any_length(spark, tmp_path):
    """Tokens are folded as single characters, so that a long one needs no room in the lookup's number."""
    tokens = [bytes([b]) for b in range(256)] + [b"a" * (1 << k) for k in range(1, 10)]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + f" {r}\n".encode() for r, t in enumerate(tokens)))
    got = spark.createDataFrame([("a" * 700,)], "w string").select(Ranks(str(tmp_path / "ranks")).encode(F.col("w")).alias("ids")).first().ids
    assert b"".join(tokens[i] for i in got) == b"a" * 700 and got == [264, 262, 260, 259, 258, 257]
