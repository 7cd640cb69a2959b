import math
import random
import zlib
from collections import Counter

import numpy as np

from lectern.llm import language_model as lm


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def slow_discounts(n1, n2, n3, n4):
    """Discounts of counts 0 to 3 and over, as the formulas have them."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(k / 2 if not a else min(k, max(0.001, k - (k + 1) * y * b / a)))
    return out


def slow(rows):
    """The model by plain counting; scores by id."""
    train = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for ws in train:
        for v, w in zip(["start", *ws], ws):
            uni[w] += 1
            bi[v, w] += 1
            ctx[v] += 1
    cont, n, v_size = Counter(w for _, w in bi), sum(uni.values()), len(uni)
    followers = {}
    for (v, _), c in bi.items():
        followers.setdefault(v, Counter())[min(c, 3)] += 1
    d = slow_discounts(*[sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    dc = slow_discounts(*[sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    spread = sum(dc[min(c, 3)] for c in cont.values())
    lower = lambda w: (max(0, cont[w] - dc[min(3, cont[w])]) + spread / (v_size + 1)) / len(bi)

    def p(v, w):
        if not ctx[v]:
            return lower(w)
        rest = sum(d[k] * c for k, c in followers[v].items())
        return (max(0, bi[v, w] - d[min(3, bi[v, w])]) + rest * lower(w)) / ctx[v]

    for v in [*list(ctx)[:5], "unseen"]:  # probabilities of all words and the unknown one add up to 1
        assert abs(sum(p(v, w) for w in uni) + p(v, "never seen") - 1) < 1e-9
    return {i: (len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10((uni[w] + 1) / (n + v_size + 1)) for w in ws), sum(math.log10(p(v, w)) for v, w in zip(["start", *ws], ws))) for i, t in rows for ws in [tokens(t)]}


def test_scores_equal_plain_counting(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(60)))) for i in range(80)]
    rows += [(600, " ".join(f"x{i % 7000}" for i in range(20_000)))]
    rows += [(500, None), (501, ""), (None, "w1 zzz"), (502, "new words only"), (3, rows[3][1])]
    want = slow(rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    for size in (50, lm.BLOCK_TOKENS):
        monkeypatch.setattr(lm, "BLOCK_TOKENS", size)
        got = lm.score_documents(table.repartition(3)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert np.allclose([r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score], want[r.doc_id])
            assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_edges(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = lm.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert one.score == one.base_score == 0 and one.train_tokens == 0 and one.n_known == 0
    x = np.array([5, 2**63, 7], np.uint64)
    assert (lm.unpacked(lm.packed(x), "<u8") == x).all() and (lm.unpacked_sorted(lm.packed_sorted(np.sort(x))) == np.sort(x)).all()
