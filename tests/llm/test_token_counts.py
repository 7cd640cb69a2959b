import random

import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm.token_counts import TokenCounter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_the_library_on_odd_texts():
    library, count = Tokenizer.from_file(PATH), TokenCounter(PATH)
    rng = random.Random(3)
    pool = "aA'sStTlL  \t\n\x1c\x85　éÉÑß漢字1٣½-_!😀éİΣσς"
    texts = ["".join(rng.choices(pool, k=rng.randrange(15))) + "<|endoftext|>" * (k % 7 == 0) for k in range(2000)]
    texts += ["", "x" * 5000, "the " * 3000, "<|startoftext|>", "é" * 900]
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark):
    rows = [(1, "Hello world", "a"), (2, None, None), (None, "", "b"), (1, "Hello world", "a"), (3, "wörld " * 3000, "c")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got)[:2] == [(False, 1, 11, 2, False)] * 2
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].n_tokens == 0 and by_id[None].n_bytes == 0 and by_id[3].over_limit
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
