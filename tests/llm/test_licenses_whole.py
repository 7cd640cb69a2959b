import random

from pyspark.sql import functions as F

from lectern.llm import licenses

CHOSEN = tuple(sorted(licenses.TEMPLATES.items()))


def test_every_notice_of_a_block():
    text = " and then. ".join(licenses.TEMPLATES.values())
    found = licenses.scan(text, CHOSEN)
    assert sorted(f["template"] for f in found) == sorted(licenses.TEMPLATES)
    assert all(f["verdict"] == "exact" for f in found)
    twice = "All rights reserved. Header and footer. Released under the MIT License. All rights reserved."
    assert [f["template"] for f in licenses.scan(twice, CHOSEN)] == ["all-rights-reserved", "mit-line", "all-rights-reserved"]


def test_altered_notice_in_a_long_block():
    altered = licenses.TEMPLATES["gpl-or-later-notice"].replace("This program is", "The thing is")
    filler = "the license of the terms of that software " * 900
    for text in (altered, filler + altered + " " + filler):
        places = [(text[f["start"] : f["end"]], f["missing"]) for f in licenses.scan(text, CHOSEN) if f["template"] == "gpl-or-later-notice"]
        assert [m for t, m in places if t.endswith("any later version")] == ["this program"]


def test_wrapped_cues(spark):
    rows = [(1, "x All rights\nreserved. y"), (2, licenses.TEMPLATES["bsd-redistribution"].replace("Redistribution and use", "Redistribution\n * and use")), (3, "This is free and unencumbered software released into the public domain.")]
    got = licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.template, r.verdict) for r in got) == [(1, "all-rights-reserved", "exact"), (2, "bsd-redistribution", "exact"), (3, "unlicense", "exact")]


def test_no_place_is_lost():
    """Every place that plain alignment of every template at every word confirms is reported, or shares words with one that is."""
    t, rng = licenses.prepared(CHOSEN), random.Random(3)
    filler = "lorem the of software use you any license source terms public free work under is in and ipsum 4.0".split()
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = list(t.words[rng.choice(list(t.words))])
            for _ in range(rng.randint(0, len(words) // 4)):
                i = rng.randrange(len(words))
                words[i : i + rng.randint(0, 1)] = rng.choices(filler, k=rng.randint(0, 1))
            parts += [*rng.choices(filler, k=rng.randint(0, 30)), *words]
        text = " ".join(parts)
        reported = set()
        for f in licenses.scan(text, CHOSEN):
            assert reported.isdisjoint(range(f["start"], f["end"]))
            reported.update(range(f["start"], f["end"]))
        placed = licenses.normal_words(text)
        for words in t.words.values():
            for _, a, b, _, _ in licenses.confirmed([w for w, _, _ in placed], words):
                assert not reported.isdisjoint(range(placed[a][1], placed[b - 1][2]))


def test_edges(spark):
    long = "filler words stand here " * 200_000
    assert [f["template"] for f in licenses.scan(long + "All rights reserved. " + long, CHOSEN)] == ["all-rights-reserved"]
    many = "Released under the MIT License. x " * 300
    assert len(licenses.scan(many, CHOSEN)) == 300
    assert licenses.scan(None, CHOSEN) == licenses.scan("", CHOSEN) == licenses.scan("All rights reserved.", ()) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_documents(empty).count() == 0
    rows = spark.createDataFrame([(1, "All rights reserved.", 5)], "doc_id long, text string, start int")
    assert licenses.scan_documents(rows, {}).count() == 0
    same = {"b": "This is one wording here.", "a": "This is one wording here."}
    assert [r.template for r in licenses.scan_documents(rows.withColumn("text", F.lit("This is one wording here.")), same).collect()] == ["a"]
