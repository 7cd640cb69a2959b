import random

import corpus_pipeline
from pyspark.sql import functions as F

from lectern.llm import near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_least(rows):
    """doc_id -> smallest id of its component, by all pairs."""
    sets, at = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and at[a] != at[b] and len(x & y) >= 0.8 * len(x | y):
                old, new = max(at[a], at[b]), min(at[a], at[b])
                at = {i: new if r == old else r for i, r in at.items()}
    return at


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_edited_copies_against_all_pairs(spark):
    rng, texts = random.Random(5), []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(6, 300))]
        texts.append(words)
        for n in range(rng.randrange(5)):
            texts.append(edited(rng, words, rng.randrange(1, max(2, len(words) // 30))))
    base = [f"b{k}" for k in range(200)]
    texts += [edited(rng, base, 4) for _ in range(60)]  # one large group
    chain = base[:150]
    for _ in range(8):  # each like the one before, the ends unlike
        chain = edited(rng, chain, 2)
        texts.append(chain)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9001, "One two"), (9002, "one  TWO"), (9003, "one two three"), (9004, None), (9005, "")]
    least = slow_least(rows)
    least[9005] = 9004  # without words: together
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(set(least.values()))
    assert len(got) < len({shingles(t) for _, t in rows}) - 50


def test_a_passage_that_many_texts_share_pairs_none_of_them(spark):
    """Unlike texts under one long passage, some with a copy: all links are found, few pairs are tried."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(90)]
    texts = [[*passage, *(f"t{k}x{i}" for i in range(rng.randrange(40, 120)))] for k in range(150)]
    texts += [edited(rng, rng.choice(texts[:150]), 3) for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    least = slow_least(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == least and len(set(got.values())) < len(rows)
    sets = near_copies.shingled(docs).dropDuplicates(["fp"])
    members = sets.select("fp", F.col("fp").alias("root"))
    pairs = {(r.a, r.b) for r in near_copies.rare_pairs(members, sets, 0.8).collect()}
    whole = {r.fp: set(r.shingles) for r in sets.collect()}
    alike = {(a, b) for a in whole for b in whole if a < b and len(whole[a] & whole[b]) >= 0.8 * len(whole[a] | whole[b])}
    assert alike and alike <= pairs and len(pairs) < 2 * len(rows)


def test_rows_that_stay(spark):
    """Clashing column names, rows without an id, repeated rows and rows of one id with different texts."""
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, "a b c d e f", 7, "x"), (1, "a b c d e f", 7, "x"), (2, "A b c d e f", 7, "x"), (3, "g h i j k", 1, None), (3, "other words of this id", 1, None)]
    rows += [(None, "a b c d e f", 1, "y"), (None, "only here without an id", 1, "y"), (None, "only here without an id", 1, "y"), (None, None, 1, "z"), (8, "", 2, "z"), (9, long, 3, "l"), (10, long + " end", 3, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int, component_id string")
    kept = near_copies.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:30], r._n, r.component_id) for r in kept.collect()), key=repr)
    want = [rows[0], rows[3], rows[4], rows[6], rows[9], rows[10]]
    assert got == sorted(((i, (t or "")[:30], n, c) for i, t, n, c in want), key=repr)
    assert near_copies.keep_one_of_each(docs.limit(0)).count() == 0


def test_nearest_pairs():
    rng = random.Random(3)
    members = [(i, rng.getrandbits(64) if i % 4 == 0 else rng.getrandbits(8)) for i in range(200)]
    got, first = dict(near_copies.nearest_pairs(members)), {}
    for fp, bits in members:
        near = min(((bits ^ b).bit_count() for b in first), default=65)
        assert (near <= near_copies.RADIUS) == (fp in got)
        if fp in got:
            assert got[fp] < fp and (dict(members)[got[fp]] ^ bits).bit_count() == near
        first.setdefault(bits, fp)


def test_large_shards_by_chunks(spark):
    """Over twice the shard size of fingerprints that agree on all bits but the last ones."""
    from test_simhash import slow_components

    from lectern.llm.components import components

    fps = sorted({random.Random(i).getrandbits(12) for i in range(60)})
    edges = simhash.shard_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, 10)
    got = {r.node: r.root for r in components(edges).collect()}
    slow = slow_components(fps)
    assert {f: got.get(f, f) for f in fps} == slow
