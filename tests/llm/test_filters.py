import random

import duckdb

from lectern.llm import decontamination, licenses, url_filter


def shingles(text, size=5):
    w = [x for x in (text or "").encode().lower().split()]
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def contains(doc, item):
    want = shingles(item)
    if not want:
        return 0.0
    k = len(next(iter(want)))
    w = (doc or "").encode().lower().split()
    return len(want & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) / len(want)


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 5, 6, 14, 40, 70)))), "x") for i in range(40)] + [(90, None, "x"), (91, "  ", "x"), (None, "w1 w2", "x"), (92, items_text := "W9 W8 w7", "x"), (93, items_text, "x")]
    docs = []
    for i in range(120):
        body = rng.choices(vocabulary, k=rng.randrange(300))
        if i % 3:
            part = rng.choice(items[:40])[1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            body[len(body) // 2 : len(body) // 2] = part
        docs.append((i, "\t ".join(body), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, "a w9 w8 W7 b", "x"), (502, "w9 w8 w7", "x"), (7, docs[7][1], "x")]
    want = {(d, i): c for d, t, _ in docs for i, s, _ in items if i is not None and (c := contains(t, s)) >= 0.8}
    a, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    for rows in (1_000_000, 0):  # broadcast, and by shuffle
        got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contained_items(a, b, broadcast_rows=rows).collect()}
        assert got == want and len(want) > 40
    kept = decontamination.decontaminated(a, b)
    assert kept.columns == a.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, _, _ in docs if d not in {d for d, _ in want})
    split = [(None, "w9 w8 x"), (None, "x w8 w7"), (600, "p1 p2 p3 p4 p5 p6"), (600, "p5 p6 p7 p8 p9")]  # rows without an id don't add up, rows of one id do
    whole = spark.createDataFrame([(1, "w9 w8 w8 w7"), (2, "p1 p2 p3 p4 p5 p6 p7"), (3, "p5 p6 p7 p8 p9 q1"), (4, "p5 p6 p7 p8 p9")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contained_items(spark.createDataFrame(split, "doc_id long, text string"), whole).collect()] == [(600, 4)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(a, none).count() == 0
    assert decontamination.contained_items(a.limit(0), b).count() == 0


def test_only_candidates_are_verified(spark):
    """Verification reads the pairs that the sketches found; others that share shingles with an item never reach it."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(30)]
    docs = [(i, " ".join([*rng.choices(vocabulary, k=200), *items[i % 30][1].split()[: 60 if i < 40 else 12]])) for i in range(400)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted, sizes, few = decontamination.item_shingles(b), [5], lambda df: df
    texts = decontamination.worded(a.withColumn("id", a.doc_id.cast("string")), "id", "text").withColumnRenamed("id", "key")
    pairs = decontamination.candidates(texts, wanted, sizes, few).cache()
    sharing = {(d, i) for d, t in docs for i, s in items if shingles(t) & shingles(s)}
    right = {(d, i) for d, t in docs for i, s in items if contains(t, s) >= 0.8}
    found = {(int(r.key), r.item_id) for r in pairs.collect()}
    assert right <= found < sharing and len(right) == 40
    one = pairs.where("key = '0'")
    assert {r.key for r in decontamination.verified(texts, one, wanted, sizes, few).collect()} == {"0"}


def test_url_rules_and_sql(spark):
    rows = [(1, "http://Www.Example.com/en/9?x#y"), (2, "https://example.com/en/9"), (3, "http://a.example.com/de/9"), (4, "ftp://x.net/es/"), (5, "http://x.net/esx"), (6, None), (7, "no scheme"), (8, "http://com"), (9, "http://com/"), (10, "http://h.org?q"), (11, "http://notexample.com/en/1"), (None, "http://h.org//a//b/c/d/e/f"), (1, "http://Www.Example.com/en/9?x#y"), (12, "a://b://c/d")]
    deep = random.Random(8)
    rows += [(1000 + i, "http://deep.org/" + "/".join(deep.choice(("a", "b", f"v{deep.randrange(40)}")) for _ in range(deep.randrange(12)))) for i in range(300)] + [(1500, "http://deep.org/" + "x/" * 300)]
    rows += [(2000 + i, "http://hot.org/same/page?" + str(i)) for i in range(400)]
    rows += [(100 + i, f"http://site.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(80)] + [(300 + i, f"http://site.org/bad/page{i}.html") for i in range(10)]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    labels = [(100 + i, 0 if i % 2 else 1, 0) for i in range(80)] + [(1000 + i, i * i % 7 % 2, 0) for i in range(0, 300, 2)] + [(100, None, None), (None, 0, 1)]
    table = spark.createDataFrame(labels, "page_id long, quality int, toxic int")
    marks = table.selectExpr("page_id", "(quality = 0 or toxic = 1) as bad")
    got = {r.page_id: r for r in url_filter.judge(pages, marks).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block")] and got[5].rule is None
    assert (got[6].host, got[6].path, got[7].host, got[8].path, got[8].rule, got[9].rule, got[10].host, got[12].host) == ("", "", "", "", None, "com/", "h.org", "b:")
    assert got[11].rule == "com/" and got[None].template == "/a/b/c/d/e/f" and got[1500].template.endswith("/x" * 280) and got[1500].template.count("/") == 300
    assert {got[100 + i].verdict for i in range(80) if i % 2} == {"block"} and {got[100 + i].verdict for i in range(80) if not i % 2} == {"allow"}
    assert got[305].template == "/bad/*" and got[305].verdict == "block"
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    con.register("labels", table.withColumnRenamed("page_id", "doc_id").toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    sql = con.execute(url_filter.oracle()).fetchall()
    ours = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.template, r.purity) for r in url_filter.judge(pages, marks).collect()]
    assert sorted(map(repr, sql)) == sorted(map(repr, ours))
    assert url_filter.judge(pages.limit(0), marks).count() == 0 and url_filter.judge(pages, marks.limit(0)).count() == len(rows)


def test_licenses(spark):
    notice = licenses.TEMPLATES["gpl-or-later-notice"]
    changed = notice.replace("version 3", "version 2").replace("redistribute it and/or", "share it or")
    filler = "some ordinary words about nothing at all " * 40
    rows = [(1, filler + notice + filler), (2, changed), (3, "Released under the MIT License."), (4, filler), (5, None), (6, ""), (None, filler * 50 + "All rights reserved."), (7, "a license is a thing"), (3, "Released under the MIT License.")]
    got = licenses.scan_documents(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, template string")).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert set(by_id) == {1, 2, 3, None} and len(by_id[3]) == 2
    assert (by_id[1][0].template, by_id[1][0].verdict) == ("gpl-or-later-notice", "exact")
    assert rows[0][1][by_id[1][0].start : by_id[1][0].end] == notice.rstrip(".")
    r = by_id[2][0]
    assert (r.template, r.verdict) == ("gpl-or-later-notice", "modified") and "3" in r.missing.split() and "2" in r.added.split() and r.reduction > 0.3
    assert by_id[None][0].template == "all-rights-reserved"


def test_every_template_is_found_exactly_and_ranked_first():
    chosen = tuple(sorted(licenses.TEMPLATES.items()))
    for name, text in chosen:
        found = licenses.scan("before it. " + text + " after it.", chosen)
        assert any(f["template"] == name and f["verdict"] == "exact" for f in found), (name, found)
