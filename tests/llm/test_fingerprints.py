import hashlib
import random

from lectern.llm import fingerprints as fp


def true_likeness(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_likeness_is_close_to_the_truth():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    for n, part in ((30, 0.3), (400, 0.5), (3000, 0.9), (6, 1.0), (2000, 0.02)):
        a = rng.choices(words, k=n)
        b = a[: int(n * part)] + rng.choices(words, k=n - int(n * part))
        a, b = " ".join(a), " ".join(b)
        assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - true_likeness(a, b)) < 0.12 + 0.2 * (n < 50)
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint(None)) == 1.0
    assert fp.fingerprint("A b  c") == fp.fingerprint("a b c")


def test_both_ways_to_fill_empty_bins_agree():
    rng = random.Random(1)
    for n in (31, 33, 200):
        h = fp.shingle_hashes(fp.word_hashes(" ".join(str(rng.random()) for _ in range(n + 4))))
        order, place = fp.probes()
        filled = sorted({int(x) >> 55 for x in h})
        for i in range(fp.BINS):
            if i not in filled:
                first = next(b for b in order[i] if b in filled)
                assert first == min(filled, key=lambda b: place[i][b])
        assert len(fp.packed(h)) == fp.BINS * fp.BITS // 8


def slow_fingerprint(text):
    """Bins of the hashes one by one, empty ones by walking each one's order, low bits packed by hand."""
    import numpy as np
    import xxhash

    mask, words = (1 << 64) - 1, (text or "").encode().lower().split()

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    least = {}
    for i in range(max(1, len(words) - 4)):
        h = 0
        for w in words[i : i + 5]:
            h = mixed(h + xxhash.xxh64_intdigest(w) + 0x9E3779B97F4A7C15 & mask)
        h = mixed(h)
        least[h >> 55] = min(h, least.get(h >> 55, mask))
    rng = np.random.default_rng(2017)
    order = [rng.permutation(512) for _ in range(512)]
    values = [mixed(least[b if b in least else next(int(x) for x in order[b] if int(x) in least)]) & 15 for b in range(512)]
    return bytes(values[i] << 4 | values[i + 1] for i in range(0, 512, 2))


def test_against_a_plain_version():
    rng = random.Random(8)
    for n in (0, 1, 4, 5, 6, 40, 300, 5000):
        text = " ".join(rng.choices([f"Word{i}é" for i in range(200)], k=n))
        assert fp.fingerprint(text) == slow_fingerprint(text)


def test_rows(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}é" for i in range(50)]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.randrange(80))), "x") for i in range(57)] + [(1000, None, "x"), (None, "last one here", "x"), (-7, "", None)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", nxt[1] or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        want[r[0]] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(t).hex(), fp.fingerprint(e).hex(), fp.likeness(fp.fingerprint(t), fp.fingerprint(e)), fp.likeness(fp.fingerprint(t), fp.fingerprint(u)))
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    for size in (7, 500):
        got = fp.fingerprint_documents(table, per_run=size).collect()
        assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want
    doubled = fp.fingerprint_documents(table.unionAll(table), per_run=9)
    assert doubled.count() == 2 * len(rows)
    assert fp.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(None, "the same text", "x")] * 40 + [(4, "the same text", "x")] * 30, "doc_id long, text string, run string")
    got = fp.fingerprint_documents(same, per_run=5).collect()
    assert len(got) == 70 and {r.near_next for r in got} == {1.0}
    long = [(i, " ".join(f"w{(j * i) % 9973}" for j in range(60_000 + i)), "x") for i in (3, 4)]
    assert {r.doc_id: r.n_chars for r in fp.fingerprint_documents(spark.createDataFrame(long, "doc_id long, text string, key string")).collect()} == {i: len(t) for i, t, _ in long}
    one = fp.fingerprint_documents(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
