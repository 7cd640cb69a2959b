"""The stored index against plain scans of the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import lexical as L


def words_of(text):
    found = re.findall(r"\w+", text.lower())
    return [(i, re.sub(r"(es|s)$", "", w) if len(w) > 4 else w) for i, w in enumerate(found) if len(w) > 1 and w not in T.STOP_WORDS]


def plain_search(texts, queries, k, allowed=lambda q, c: True):
    """Every query against every text, from the definition."""
    out = {}
    for q, groups in queries.items():
        best = {}
        for words, phrases, barred in groups:
            needed = {*words, *(t for f in phrases for t in f)}
            for c, text in texts.items():
                at = words_of(text)
                held = {t for _, t in at}
                whole = all(any(all((p + i, t) in at for i, t in enumerate(f)) for p in range(len(text))) for f in phrases)
                if not needed or not needed <= held or held & set(barred) or not whole or not allowed(q, c):
                    continue
                spots = [(p, t) for p, t in at if t in needed]
                score = L.window_score(*zip(*spots, strict=True), len(needed))
                best[c] = max(best.get(c, 0), score)
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{a}{b}" for a in "abcdef" for b in "kmnp"]
    texts = {}
    for c in range(400):
        own = rng.choices(vocabulary[: 6 if c % 7 == 0 else 24], k=rng.randrange(1, 30))
        texts[c * 13 + 5] = " ".join(own) + (" wak wak wak wak" if c > 380 else "")
    return texts


QUERIES = {
    1: ("wak", [(["wak"], [], [])]),
    2: ("wak wbm", [(["wak", "wbm"], [], [])]),
    3: ('"wak wbm"', [([], [["wak", "wbm"]], [])]),
    4: ("wak or wfp", [(["wak"], [], []), (["wfp"], [], [])]),
    5: ("wak -wbm", [(["wak"], [], ["wbm"])]),
    6: ('wck "wak wam" wcm', [(["wck", "wcm"], [["wak", "wam"]], [])]),
    7: ("missing", [(["missing"], [], [])]),
    8: ("-wak", []),
}


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_search_equals_a_plain_one(spark, corpus, tmp_path, monkeypatch, first):
    monkeypatch.setattr(L, "CELL", 16)
    monkeypatch.setattr(L, "BLOCK", 5)
    monkeypatch.setattr(L, "TASK_CHARS", 4000)
    chunks = spark.createDataFrame([*corpus.items()], "chunk_id long, content string").repartition(3)
    L.LexicalIndex.write(chunks, str(tmp_path / "index"))
    index = L.LexicalIndex(spark, str(tmp_path / "index"))
    held = {(t, c): p for c, text in corpus.items() for t in {w for _, w in words_of(text)} for p in [[i for i, w in words_of(text) if w == t]]}
    assert {(r.term, r.chunk_id): r.positions for r in index.postings().collect()} == held
    assert max(r.n for r in index.blocks.collect()) <= 5
    parsed = L.parse_query(spark.createDataFrame([(q, text) for q, (text, _) in QUERIES.items()], "query_id long, query string"))
    for allowed, keep in ((lambda q, c: True, None), (lambda q, c: c % 2 == 0, lambda df: df.where("chunk_id % 2 = 0"))):
        best, cells = L.Search(parsed, index).best(4, keep, first)
        got = {}
        for r in best.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
        want = {q: [(c, round(s, 9)) for c, s in rows] for q, rows in plain_search(corpus, {q: g for q, (_, g) in QUERIES.items()}, 4, allowed).items() if rows}
        assert got == want
        if first == 3 and not keep:  # the frequent term's texts of many places make most cells hopeless
            read = cells.where("query_id = 1").count()
            assert read < L.Search(parsed, index).cells().where("query_id = 1").count() / 2


def test_only_the_folders_of_the_terms_are_read(spark, corpus, tmp_path):
    L.LexicalIndex.write(spark.createDataFrame([*corpus.items()], "chunk_id long, content string"), str(tmp_path / "index"))
    index = L.LexicalIndex(spark, str(tmp_path / "index"))
    some = index.of(spark.createDataFrame([("wak",)], "term string"))
    assert {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()} >= {str(r.bucket) for r in some.select("bucket").distinct().collect()}
    assert "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().toString()
    assert some.where(F.col("term") == "wak").count() > 0


def test_empty_corpus(spark, tmp_path):
    L.LexicalIndex.write(spark.createDataFrame([], "chunk_id long, content string"), str(tmp_path / "index"))
    parsed = L.parse_query(spark.createDataFrame([(1, "wak")], "query_id long, query string"))
    assert L.lexical_search(parsed, L.LexicalIndex(spark, str(tmp_path / "index"))).count() == 0


@pytest.mark.parametrize("words", [1, 40, 1 << 21])
def test_words_are_packed_where_their_chunks_stand(spark, tmp_path, monkeypatch, words):
    """A term in every text, rows of one chunk, plurals and texts without words; no row for each word is dealt out."""
    monkeypatch.setattr(L, "positioned_terms", None)
    for name, value in {"CELL": 8, "BLOCK": 3, "TASK_CHARS": 300, "LEAST_CHARS": 300, "WORDS": words}.items():
        monkeypatch.setattr(L, name, value)
    texts = [(c, f"leyes de la norma n{c % 5} leyes casas") for c in range(60)] + [(7, "y otras leyes"), (900, "de la y"), (901, "")]
    L.LexicalIndex.write(spark.createDataFrame(texts, "chunk_id long, content string"), str(tmp_path / "index"))
    want = {}
    for c, text in texts:
        for i, w in words_of(text):
            want.setdefault((w, c), []).append(i)
    index = L.LexicalIndex(spark, str(tmp_path / "index"))
    got = {}
    for r in index.postings().collect():
        assert (r.term, r.chunk_id) not in got
        got[r.term, r.chunk_id] = r.positions
    assert got == {k: sorted(p) for k, p in want.items()}
    assert max(r.n for r in index.blocks.collect()) <= 3


def test_a_task_gathers_a_bounded_number_of_postings(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "TASK_POSTINGS", 50)
    monkeypatch.setattr(L, "CELL", 16)
    L.LexicalIndex.write(spark.createDataFrame([*corpus.items()], "chunk_id long, content string"), str(tmp_path / "index"))
    search = L.Search(L.parse_query(spark.createDataFrame([(2, "wak wbm")], "query_id long, query string")), L.LexicalIndex(spark, str(tmp_path / "index")))
    cells = search.cells()
    held = sum(1 for c, text in corpus.items() for t in ("wak", "wbm") if t in {w for _, w in words_of(text)})
    size = cells.agg(F.sum("size")).first()[0]
    assert 100 < size <= held
    plan = search.scores(cells)._jdf.queryExecution().toString()
    assert "hashpartitioning(query_id#" in plan and f", {size // 50 + 1}), REPARTITION_BY_NUM" in plan


def test_blocks_are_scored_whole_and_some_at_a_time(spark, corpus, tmp_path, monkeypatch):
    """A cell's blocks over several batches, a word twice in a phrase, and few cells for a single term; no row for each posting is dealt out."""
    for name, value in {"CELL": 16, "BLOCK": 5, "SCORED": 7}.items():
        monkeypatch.setattr(L, name, value)
    queries = QUERIES | {9: ('"wak wak"', [([], [["wak", "wak"]], [])]), 10: ('wfp or "wak wbm wak" or wck wam', [(["wfp"], [], []), ([], [["wak", "wbm", "wak"]], []), (["wck", "wam"], [], [])])}
    L.LexicalIndex.write(spark.createDataFrame([*corpus.items()], "chunk_id long, content string"), str(tmp_path / "index"))
    parsed = L.parse_query(spark.createDataFrame([(q, text) for q, (text, _) in queries.items()], "query_id long, query string"))
    search = L.Search(parsed, L.LexicalIndex(spark, str(tmp_path / "index")))
    want = {q: [(c, round(s, 9)) for c, s in rows] for q, rows in plain_search(corpus, {q: g for q, (_, g) in queries.items()}, 400).items() if rows}
    cells = search.cells()
    every = {q: [] for q in want}
    for r in search.scores(cells).collect():
        every[r.query_id].append((r.chunk_id, round(r.score, 9)))
    assert {q: sorted(rows) for q, rows in every.items()} == {q: sorted(rows) for q, rows in want.items()}
    best, read = search.best(4, None, 1)
    got = {q: [] for q in want}
    for r in best.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, round(r.score, 9)))
    assert got == {q: rows[:4] for q, rows in want.items()}
    assert read.where("query_id = 1").count() < cells.where("query_id = 1").count() / 2
    assert "Generate" not in search.scores(cells, 4)._jdf.queryExecution().executedPlan().toString()


def test_window_scores_equal_the_plain_one():
    import numpy as np

    rng = random.Random(5)
    rows, needed, want = [], [], []
    for c in range(300):
        m = rng.randint(1, 4)
        terms = [*range(m), *(rng.randrange(m) for _ in range(rng.randrange(12)))]
        rng.shuffle(terms)
        places = sorted(rng.sample(range(60), len(terms)))
        rows += [(p, c, t) for p, t in zip(places, terms, strict=True)]
        needed.append(m)
        want.append(L.window_score(places, terms, m))
    assert L.window_scores(*map(np.array, zip(*rows, strict=True)), np.array(needed)).tolist() == want
