"""Operators on small tables: empty and null inputs, plans, and what SQL does not show."""

import datetime
import json
import random
import re
import shutil

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.operators import embedding as E
from lectern.operators import retrieval as R
from lectern.sources.files import scan_corpus, scan_text
from lectern.streaming import jobs as S


def test_filters_and_columns_reach_the_scan(spark):
    from lectern.plans.corpus import QUERIES

    plan = QUERIES["a14_table_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,5000)]" in plan and "text" not in plan.split("ReadSchema")[1]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), "id")
    assert "WindowGroupLimit" in R.ranked(df, "g", F.desc("id"), k=3)._jdf.queryExecution().executedPlan().toString()


def test_text_functions_take_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",), ("a-\nb",)], "text string")
    got = df.select(T.clean_text(F.col("text")).text.alias("t"), T.normalize_query(F.col("text")).alias("q"), T.is_conversational(F.col("text")).alias("c"), T.excerpt(F.col("text")).alias("e")).collect()
    assert [r.t for r in got] == [None, "", "", "ab"] and [r.q for r in got] == [None, "", "", "a- b"] and [r.c for r in got][1:] == [True, True, False]


def greedy(tokens, size, overlap):
    """Parts of units by a plain loop: (first, last + 1)."""
    parts, current = [], []
    for i, t in enumerate(tokens):
        if current and sum(tokens[j] for j in current) + t > size:
            parts.append((current[0], current[-1] + 1))
            carried, total = [], 0
            for j in reversed(current):
                if overlap <= 0:
                    break
                carried.insert(0, j)
                total += tokens[j]
                if total >= overlap:
                    break
            current = carried if len(carried) < len(current) else carried[1:]
        current.append(i)
    return [*parts, (current[0], current[-1] + 1)]


def test_division_equals_a_loop(spark):
    rng = random.Random(4)
    bodies = [(i, " ".join("W" + "x" * rng.randrange(1, 90) + "." for _ in range(rng.randrange(1, 60)))) for i in range(12)]
    df = spark.createDataFrame(bodies, "id long, body string")
    for size, overlap in ((40, 0), (40, 12), (15, 30)):
        got = {}
        for r in C.divide(df, size, overlap).collect():
            got.setdefault(r.id, []).append((r.part, r.content, r.char_start, r.char_end))
        for i, body in bodies:
            units = body.split(" ")
            tokens = [max(1, round(len(u) / 3.6)) for u in units]
            want = [" ".join(units[a:b]) for a, b in greedy(tokens, size, overlap)]
            assert [c for _, c, _, _ in sorted(got[i])] == want
            assert all(body[a:b] == c for _, c, a, b in got[i])


def test_headings(spark):
    rows = [(1, "ARTÍCULO 15A. Uno"), (2, "Art. 7. Dos"), (3, "en el artículo 5 se dice"), (4, "\n\nPARÁGRAFO 1. Tres"), (5, "CONSIDERANDO:\ntexto\nRESUELVE\nPRIMERO.- Negar"), (6, "En 1991. Algo"), (7, "")]
    got = {}
    for r in C.find_sections(spark.createDataFrame(rows, "id long, text string")).orderBy("id", "i").collect():
        got.setdefault(r.id, []).append((r.kind, r.number, r.start))
    assert got == {1: [("ARTICULO", "15A", 0)], 2: [("ARTICULO", "7", 0)], 4: [("PARAGRAFO", "1", 0)], 5: [("CONSIDERANDO", None, 0), ("RESUELVE", None, 20), ("NUMERAL", "PRIMERO", 29)]}


def test_a_line_that_fits_several_headings_is_of_the_outermost_kind(spark):
    lines = ["PRIMERO. Uno", "PARTE SEGUNDA", "c. Texto", "ARTÍCULO I. Algo", "PAR. 1. Algo", "SUBSECCIÓN 1", "DECIDE", "3.1. Texto", "PARÁGRAFO. Solo"]
    got = {r.id: (r.kind, r.depth) for r in C.find_sections(spark.createDataFrame([*enumerate(lines)], "id long, text string")).collect()}
    for i, line in enumerate(lines):
        fits = [(depth, k, kind) for k, (kind, _, depth, pattern) in enumerate(C.HEADINGS) if re.search(pattern.replace("(?iu)", "(?i)"), line)]
        assert got[i] == (min(fits)[2], min(fits)[0])


def test_nearest_by_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)] + [(900, [0.0] * 16), (901, None)]
    base = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = base.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    whole = {(r.query_id, r.id): r.rank for r in E.nearest(base, queries, 10, 0.0).collect()}
    assert all(whole[q, q] == 1 for q in range(0, 300, 50))
    monkeypatch.setattr(E, "BROADCAST_BYTES", -1)  # query blocks meet base blocks without a broadcast
    assert whole == {(r.query_id, r.id): r.rank for r in E.nearest(base.repartition(5), queries.repartition(3), 10, 0.0).collect()}
    odd = base.withColumn("facts", F.array((F.col("id") % 2).cast("string")))
    asked = queries.withColumn("demands", F.array((F.col("query_id") % 100 == 0).cast("string")))
    mask = lambda rows, asked: np.array([[r[0] == "1" or a[0] == "true" for a in asked] for r in rows])
    got = E.nearest(odd, asked, 10, -1.0, "facts", "demands", mask).collect()
    assert all(r.id % 2 == 1 for r in got if r.query_id % 100) and any(r.id % 2 == 0 for r in got) and {r.rank for r in got} == set(range(1, 11))
    assert E.nearest(base.limit(0), queries, 10, 0.0).count() == E.nearest(base, queries.limit(0), 10, 0.0).count() == 0


def test_filters_come_before_the_limit(spark):
    rows = [(i, "m" if i % 3 else "old", i % 5 > 0, "CIVIL" if i % 2 else None, "en", None, "LEY", "VIGENTE", None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "document_id long, embedding_model string, has_vector boolean, legal_area string, jurisdiction string, court string, document_type string, status string, publication_date date")
    lists = "array<string>"
    shape = f"query_id long, areas {lists}, jurisdictions {lists}, courts {lists}, types {lists}, statuses {lists}, document_ids array<long>, published_after date, published_before date"
    asked = [(1, ["CIVIL"], None, None, None, None, None, None, None), (2, [], [], [], [], [], [7, 8, 9, 11], None, None), (3, None, None, ["x"], None, None, None, None, None)]
    filters = spark.createDataFrame(asked, shape)
    pairs = chunks.crossJoin(spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long"))
    got = {(r.query_id, r.document_id) for r in R.apply_filters(pairs, filters, "m").collect()}
    live = {i for i in range(40) if i % 3 and i % 5 > 0}
    assert got == {(1, i) for i in live if i % 2} | {(2, i) for i in live & {7, 8, 9, 11}} | {(4, i) for i in live}
    pairs = chunks.select("document_id", R.facts(F.col).alias("f")).where("document_id in (%s)" % ",".join(map(str, live))).collect()
    wanted = filters.select("query_id", R.demands(F.col).alias("d")).collect()
    mask = R.block_mask([r.f for r in pairs], [r.d for r in wanted])
    assert {(w.query_id, r.document_id) for i, r in enumerate(pairs) for j, w in enumerate(wanted) if mask[i, j]} == {x for x in got if x[0] < 4}


def test_block_mask_takes_any_number_of_distinct_filters(spark):
    """20,000 queries, each with filters of its own, against every row of a block, by plain comparison."""
    rng = random.Random(4)
    pick = lambda values: rng.choice(values)
    rows = [[pick(["CIVIL", "PENAL", None]), pick(["en", "fr"]), pick(["a", None]), pick(["LEY", "AUTO"]), "VIGENTE", str(rng.randrange(500)), pick([None, f"20{rng.randrange(10, 30)}-01-05"])] for _ in range(60)]
    asked, wanted = [], []
    for q in range(20_000):
        lists = [rng.sample(v, rng.randrange(0, 2)) for v in (["CIVIL", "PENAL"], ["en", "fr"], ["a", "b"], ["LEY"], ["VIGENTE", "DEROGADO"])] + [[str(q % 500), str(q // 40)] if q % 3 else []]
        days = [pick([None, f"20{rng.randrange(10, 30)}-01-05"]), pick([None, f"20{rng.randrange(10, 30)}-01-05"])]
        wanted.append((lists, days))
        asked.append([json.dumps([*lists, days])])
    mask = R.block_mask(rows, asked)
    for j in rng.sample(range(20_000), 500):
        lists, (after, before) = wanted[j]
        for i, row in enumerate(rows):
            ok = all(not own or v in own for own, v in zip(lists, row[:6], strict=True)) and (row[6] is None or (not after or row[6] >= after) and (not before or row[6] <= before))
            assert mask[i, j] == ok


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, 1, 11, 50), (1, 2, 12, 70), (1, 3, 13, 40), (2, 1, 21, 500), (2, 2, 22, 1)]
    got = R.pack_context(spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, cost long"), 100).collect()
    assert sorted(tuple(r) for r in got) == [(1, 11, 1), (1, 13, 2), (2, 21, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿año".encode())
    (tmp_path / "b.txt").write_bytes("año".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b" \n")
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "e.bin").write_text("x")
    found, rejected = scan_text(spark, str(tmp_path))
    texts = {r.path[-5:]: (r.text, r.encoding) for r in found.collect()}
    assert texts["a.txt"] == ("año", "utf-8-sig") and texts["b.txt"] == ("año", "cp1252") and {r.path[-5:]: r.reason for r in rejected.collect()}["c.txt"] == "no text"
    kept, skipped = scan_corpus(spark, str(tmp_path))
    assert kept.count() == 3 and {r.path.rsplit("/", 1)[1]: r.reason for r in skipped.collect()} == {"README.md": "documentation", "e.bin": "suffix"}


def test_ingest_stream_skips_what_it_has(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("uno-\ndos")
    (tmp_path / "in/b.txt").write_text("tres")
    (tmp_path / "in/e.txt").write_text(" \n")
    run = lambda: S.ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state", most=30)
    run()
    old = {r.path[-5:] for r in spark.read.parquet(f"file://{tmp_path}/out/rows").collect()}
    assert old == {"a.txt", "b.txt"}
    shutil.move(tmp_path / "out/rows", tmp_path / "elsewhere")  # what is stored is known by state, not by reading all of it again
    (tmp_path / "in/c.txt").write_text("tres")
    (tmp_path / "in/d.txt").write_text("cuatro")
    (tmp_path / "in/f.txt").write_text("x" * 31)
    (tmp_path / "in/g.txt").write_text("cuatro")
    run()
    rows = spark.read.parquet(f"file://{tmp_path}/out/rows").collect()
    assert sorted((r.path[-5:], r.action, r.text) for r in rows) == [("c.txt", "UNCHANGED", None), ("d.txt", "NEW", "cuatro"), ("g.txt", "UNCHANGED", None)]
    assert {(r.path[-5:], r.reason) for r in spark.read.parquet(f"file://{tmp_path}/out/rejects").collect()} == {("e.txt", "no text"), ("f.txt", "too large")}


def test_months_close_and_leave_the_state(spark, tmp_path):
    def add(name, *rows):
        frame = spark.createDataFrame([(u, datetime.datetime.fromisoformat(t), n) for u, t, n in rows], "user_id long, ts timestamp, n long")
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        shutil.copy(next((tmp_path / name).glob("part-*.parquet")), tmp_path / "in" / f"{name}.parquet")

    (tmp_path / "in").mkdir()
    def run():
        stream = spark.readStream.schema("user_id long, ts timestamp, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        S.run_latest(S.quota_stream(stream, F.col("n")), str(tmp_path / "out"), "user_id", "month")
        return spark.read.parquet(f"{tmp_path}/out/rows").collect()

    add("a", (1, "2024-01-10", 5), (1, "2024-01-20", 7), (2, "2024-01-31", 1))
    assert {(r.user_id, r.tokens, r.closed) for r in run()} == {(1, 12, False), (2, 1, False)}
    add("b", (1, "2024-02-02", 3), (1, "2024-01-31T12:00:00", 2))  # late, but waited for
    assert {(r.user_id, r.month.month, r.tokens) for r in run()} >= {(1, 1, 14), (1, 2, 3)}
    add("c", (2, "2024-02-20", 9))
    rows = run()
    assert {(r.user_id, r.month.month, r.tokens) for r in rows if r.closed} == {(1, 1, 14), (2, 1, 1)}
    add("d", (1, "2024-01-15", 100), (1, "2024-02-21", 4))  # its month is closed
    rows = run()
    assert max(r.tokens for r in rows) == 14 and (1, 2, 7) in {(r.user_id, r.month.month, r.tokens) for r in rows}


def test_composed_forms(spark):
    """Every character that is passed through is composed and combines with none; the rest is composed as Unicode has it."""
    import unicodedata

    passed = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.fullmatch("[\\u0000-\\u02ff\\u2002-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\u2122\\ufeff]", chr(c))]
    assert all(unicodedata.normalize("NFC", c) == c and unicodedata.combining(c) == 0 for c in passed)
    texts = ["a\u030a s\u030c a\u0304", "\u1112\u1161\u11ab", "\u212b", "q\u0323\u0307", "e\u0301", "plain", None, "e\u0301\u2014"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.composed(F.col("t")).alias("c")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_embedding_seam_refuses(spark):
    import numpy as np
    import pytest

    from lectern.operators import embedding as E

    rows = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string")
    assert E.embed(rows(), E.HashVectors(8), 8).count() == 0
    assert E.embed(rows("uno", "dos"), E.HashVectors(8), 8).count() == 2
    for texts, model, message in ((("a", "  "), E.HashVectors(8), "empty text"), (("a", None), E.HashVectors(8), "empty text"), (("a", "b"), lambda t: np.zeros((1, 8)), "1 vectors for 2 inputs"), (("a",), lambda t: np.zeros((1, 9)), "dimension"), (("a",), lambda t: np.full((1, 8), np.nan), "finite")):
        with pytest.raises(Exception, match=message):
            E.embed(rows(*texts).coalesce(1), model, 8).count()


def test_window_score():
    from lectern.operators.lexical import window_score

    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 4)
        spots = sorted((p, rng.choice("abc"[:n])) for p in rng.sample(range(30), rng.randrange(1, 12)))
        windows = []
        for p, _ in spots:
            last = {t: q for q, t in spots if q <= p}
            if len(last) == n:
                windows.append((min(last.values()), p))
        minimal = [(a, b) for i, (a, b) in enumerate(windows) if not i or a > windows[i - 1][0]]
        want = sum(1 / (1 + b - a + 1 - n) for a, b in minimal)
        assert abs(window_score(*zip(*spots), n) - want) < 1e-9


def test_containing(spark):
    from lectern.operators.evaluation import containing

    docs = [(1, "xone two three four fivey"), (2, "one two  three four five"), (3, "zero one two three four five six"), (4, "short a b c"), (5, None)]
    items = [(10, "one two three four five"), (11, "a b"), (12, "ero one two three four fi"), (13, None)]
    got = containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, wanted string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, q) for d, t in docs for q, w in items if t and w and w in t)


def test_written_texts_keep_to_the_guard(spark, tmp_path):
    """One slug with most of all documents, in parts of bounded size that follow each other in order."""
    from lectern.sources.files import write_corpus

    rng = random.Random(6)
    rows = [("hot" if i % 10 else f"s{i % 3}", i, "n", str(i), "x", "v", "u", "t" * rng.randrange(300)) for i in range(400)]
    docs = spark.createDataFrame(rows, "slug string, document_id long, name string, number string, issuer string, status string, url string, text string").repartition(5)
    write_corpus(docs, str(tmp_path / "out"), most=4000)
    written = {(f.parent.parent.name, int(f.parent.name[5:])): f.read_text() for f in (tmp_path / "out").rglob("part-*.txt")}
    assert len(written) > 30 and max(map(len, written.values())) <= 4000
    for slug in ("hot", "s0"):
        whole = "".join(t for (s, _), t in sorted(written.items()) if s == f"slug={slug}")
        assert re.findall(r"Identificador Oficial: (\d+)", whole) == [str(i) for s, i, *_ in rows if s == slug]


def test_short_items_are_spotted_in_groups(spark):
    from lectern.operators.evaluation import containing, spotted

    rng = random.Random(2)
    docs = [(i, None if i == 3 else "".join(rng.choices("ab c", k=rng.randrange(40)))) for i in range(60)]
    items = [(100 + j, "".join(rng.choices("ab c", k=rng.randrange(5)))) for j in range(80)]
    want = sorted((d, q) for d, t in docs for q, w in items if t is not None and w in t)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, wanted string")
    for group in (7, 1000):
        assert sorted(map(tuple, spotted(frame, asked, group).collect())) == want
    both = containing(frame, asked)
    assert sorted(map(tuple, both.collect())) == want and "NestedLoop" not in both._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_titles_try_few_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(150)]
    titles = [(i, " ".join(["ley general", *rng.sample(vocabulary, rng.randrange(1, 5))])) for i in range(300)] + [(900, ""), (901, None)]
    grams = lambda t: {("  " + w + " ")[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    t = spark.createDataFrame(titles, "title_id long, title string")
    q = t.where("title_id % 20 = 0").withColumnRenamed("title_id", "query_id")
    likeness = lambda a, b: round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6)
    for threshold in (0.3, 0.6):
        want = {}
        for i, a in titles[:300:20]:
            alike = sorted((-likeness(a, b), j) for j, b in titles[:300] if likeness(a, b) >= threshold)[:5]
            want |= {(i, j): (-s, r + 1) for r, (s, j) in enumerate(alike)}
        got = {(r.query_id, r.title_id): (r.similarity, r.rank) for r in R.fuzzy_title(q, t, threshold).collect() if r.query_id < 900 and r.title_id < 900}
        assert got == want
    assert R.title_pairs(q, t, 0.6).count() < 0.2 * 15 * 300 and R.title_pairs(q, t, 0.6).count() < R.title_pairs(q, t, 0.3).count()


def test_a_merge_leaves_untouched_buckets_alone(spark, tmp_path):
    from lectern.operators import corpus

    store = corpus.BucketStore(spark, str(tmp_path / "store"), buckets=16)
    store.write(spark.createDataFrame([(i, f"t{i}", "VIGENTE", f"u{i}") for i in range(200)], "document_id long, title string, status string, source_url string"))
    files = lambda: {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("part-*.parquet")}
    before = files()
    new = [(7, "new", "DESCONOCIDO", ""), (9000, "fresh", "DEROGADO", "v")]
    touched = {f"bucket={r.bucket}" for r in store.bucketed(spark.createDataFrame([(i,) for i, *_ in new], "document_id long")).collect()}
    for _ in range(2):  # the same once more changes nothing
        store.merge(spark.createDataFrame(new, "document_id long, title string, status string, source_url string"), corpus.upsert_documents)
        after = files()
        kept = {f: t for f, t in before.items() if f.parent.name not in touched}
        assert kept.items() <= after.items() and not {f for f in before if f.parent.name in touched} & set(after)
        rows = {r.document_id: tuple(r)[1:] for r in store.read().collect()}
        assert rows == {i: (f"t{i}", "VIGENTE", f"u{i}") for i in range(200)} | {7: ("new", "VIGENTE", "u7"), 9000: ("fresh", "DEROGADO", "v")}


def test_a_thread_of_a_million_turns(spark):
    from lectern.operators.threads import thread_detail

    turns = spark.range(1_000_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    few = spark.createDataFrame([(2, 1, "user", "b"), (2, 0, "user", "a")], "conv_id int, turn long, role string, text string")
    parts = thread_detail(turns.unionAll(few), 1 << 20).cache()
    assert parts.agg(F.sum("turns")).first()[0] == 1_000_002 and parts.where("conv_id = 1").count() > 12
    assert parts.agg(F.max(F.octet_length("transcript"))).first()[0] <= (1 << 20) + 20
    assert parts.where("conv_id = 2").first().transcript == "user: a\nuser: b"
    ends = parts.where("conv_id = 1").select("part", F.regexp_extract("transcript", r"^user: t(\d+)", 1).cast("long").alias("a"), F.regexp_extract("transcript", r"t(\d+)$", 1).cast("long").alias("b"), "turns").orderBy("part").collect()
    assert [r.b - r.a + 1 for r in ends] == [r.turns for r in ends] and all(x.b + 1 == y.a for x, y in zip(ends, ends[1:]))


def test_sketches_of_days_merge_within_the_bound(spark):
    from lectern.operators import telemetry

    rng = random.Random(3)
    rows = [(datetime.datetime(2024, 1, 1 + i % 20), *(int(rng.paretovariate(1.2) * 10) for _ in telemetry.STAGES)) for i in range(8000)]
    logs = spark.createDataFrame(rows, "created_at timestamp, " + ", ".join(f"{s}_latency_ms long" for s in telemetry.STAGES))
    one_by_one = [telemetry.latency_sketches(logs.where(F.dayofmonth("created_at") == d)) for d in (3, 7, 11)]
    days = one_by_one[0].unionAll(one_by_one[1]).unionAll(one_by_one[2])
    got = {r.stage: r for r in telemetry.latency_from_sketches(days, {"q10": 0.1, "median": 0.5, "p99": 0.99}).collect()}
    for i, stage in enumerate(telemetry.STAGES):
        own = sorted(r[1 + i] for r in rows if r[0].day in (3, 7, 11))
        assert got[stage].n == len(own) and abs(got[stage].mean - sum(own) / len(own)) < 1e-5
        for name, rank in (("q10", 0.1), ("median", 0.5), ("p99", 0.99)):
            value = got[stage][name]
            assert sum(x < value for x in own) / len(own) <= rank + 0.02 and sum(x <= value for x in own) / len(own) >= rank - 0.02


def test_equal_titles_are_compared_once(spark):
    names = [f"{a} {b}" for a in ("blue", "old", "cold") for b in ("ring", "plate", "bolt")]
    titles = [(i, names[i % 9]) for i in range(900)] + [(900, None), (901, "")]
    grams = lambda t: {("  " + w + " ")[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    t = spark.createDataFrame(titles, "title_id long, title string")
    q = t.where("title_id % 50 = 0").withColumnRenamed("title_id", "query_id")
    want = set()
    for i, a in titles[:900:50]:
        alike = sorted((-round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6), j) for j, b in titles[:900])
        want |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(alike[:5]) if -s >= 0.3}
    shown = []
    whole = R.title_pairs
    R.title_pairs = lambda *given: shown.append(whole(*given)) or shown[-1]
    try:
        got = R.fuzzy_title(q, t)
    finally:
        R.title_pairs = whole
    assert {(r.query_id, r.title_id, r.similarity, r["rank"]) for r in got.collect() if r.query_id < 900} == want
    assert shown[0].count() <= 81


def test_hashed_vectors_and_best_of_blocks_equal_plain_ones(monkeypatch):
    import hashlib

    def plain(text, dim):
        row = np.zeros(dim)
        for w in re.findall(r"\w+", text):
            h = hashlib.sha256(w.encode()).digest()
            for o in (0, 4, 8, 12):
                row[(h[o] << 8 | h[o + 1]) % dim] += 1 if h[o + 2] & 1 else -1
        norm = np.sqrt(row @ row)
        return row / norm if norm else np.eye(dim)[0]

    rng = random.Random(2)
    texts = [" ".join(f"é{rng.randrange(50)}" if i % 3 else f"w_{rng.randrange(200)}" for _ in range(rng.randrange(0, 40))) for i in range(80)] + ["", "..."]
    monkeypatch.setattr(E, "WORD_MEMORY", 60)  # forgets words within a text
    model = E.HashVectors(16)
    assert np.array_equal(model(texts), [plain(t, 16) for t in texts]) and len(model.known) <= 60

    cos, ids = np.random.default_rng(1).integers(-3, 4, (50, 9)) / 3, np.random.default_rng(2).permutation(50)
    cos[4, 3], cos[:, 8] = np.nan, np.nan
    for k in (1, 5, 50, 70):
        want = [(q, r, cos[r, q]) for q in range(9) for r in sorted((r for r in range(50) if cos[r, q] >= 0.1), key=lambda r: (-cos[r, q], ids[r]))[:k]]
        assert [*zip(*E.best_of_block(cos, ids, k, 0.1), strict=True)] == want


def test_truncated_vectors_equal_their_sql_bit_for_bit(spark, tmp_path):
    import duckdb

    from lectern.plans import search

    rows = [(0, [1.0, -3e-7, 3e-7, -0.0, 0.0, -6e-7, *[0.0] * 20]), (1, [-0.5] * 64), (2, None), (3, [2.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {k: repr(v) for k, v in con.execute(search.ORACLE["c12_truncate_vector"]).fetchall()}
    assert {r.vec_id: repr(r.vector) for r in search.QUERIES["c12_truncate_vector"](spark, str(tmp_path)).collect()} == want
    assert want[0].startswith("[1.0, -0.0, 0.0, -0.0, 0.0, -1e-06")


def test_items_are_contained_alike_by_automaton_and_by_runs_of_words(spark):
    from lectern.operators.evaluation import containing

    rng = random.Random(8)
    docs = [(i, None if i == 3 else " ".join(rng.choices(["a", "bc", "bcd", "ñe"], k=rng.randrange(30)))) for i in range(80)]
    items = [(100 + j, " ".join(rng.choices(["a", "bc", "bcd", "ñe"], k=rng.randrange(1, 8)))) for j in range(60)] + [(990, None), (991, "")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, wanted string")
    want = sorted((d, q) for d, t in docs for q, w in items if t is not None and w is not None and w in t)
    one, runs = containing(frame, asked), containing(frame, asked, chars=0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, runs.collect())) == want
    assert "Generate" not in one._jdf.queryExecution().executedPlan().toString()  # no row for each run of words
