import random

import xxhash

from lectern.llm.simhash import BKTree, fingerprint_of, local_roots, near_duplicates, shard_edges


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprint():
    for t in (None, "", " \n", "One", "one two", "one two three", "A b c d e f a b c " * 9):
        assert fingerprint_of(t) == slow_fingerprint(t)


def slow_components(fps, radius=2):
    ids = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= radius and ids[a] != ids[b]:
                    ids[a] = ids[b] = min(ids[a], ids[b])
                    changed = True
    return ids


def some_prints(n, seed):
    rng, out = random.Random(seed), []
    while len(out) < n:
        f = rng.choice(out) if out and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return sorted(set(out))


def test_tree_and_local_roots():
    fps = some_prints(150, 1)
    tree = BKTree()
    for f in fps:
        tree.add(f)
    assert all(sorted(tree.within(f, 2)) == [g for g in fps if (f ^ g).bit_count() <= 2] for f in fps)
    slow = slow_components(fps)
    assert {f: local_roots(fps, 2).get(f, f) for f in fps} == slow


def test_shards_lose_no_link(spark):
    from lectern.llm.components import components

    fps = some_prints(120, 2)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    for size in (1, 2000):  # 1: every shard is cut again
        edges = shard_edges(spark.createDataFrame([(sign(f),) for f in fps], "fp long"), 2, size)
        got = {r.node & (1 << 64) - 1: r.root for r in components(edges).collect()}
        slow = slow_components(fps)
        groups = {}
        for f in fps:
            groups.setdefault(slow[f], set()).add(got.get(f, sign(f)))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_rows(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(5, base, "x"), (3, base, "y"), (9, base.upper(), None), (7, None, "x"), (8, "", "x"), (None, base, "x"), (3, base, "y"), (11, "something else entirely", "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    ids = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert [ids[i][1] for i in (5, 3, 9, None)] == [3] * 4 and ids[7] == ids[8] == ("0" * 16, 7) and ids[11][1] == 11
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
