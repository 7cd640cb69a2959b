import random

import pytest
from test_filters import contains
from test_near_copies import slow_least
from test_packing import packing

import corpus_pipeline

WORDS = {"en": "the of and house water light stone river".split(), "de": "der und das haus wasser licht stein fluss".split()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(12), str(tmp_path_factory.mktemp("sf"))
    items = [(i, " ".join(rng.choice(WORDS["en"]) + str(rng.randrange(500)) for _ in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        lang = ("en", "de")[i % 2]
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randrange(20, 90))]
        if i % 5 == 2:
            words.insert(3, "vilewretch")
        if i % 40 == 8:
            words[5:5] = items[i % 5][1].split()
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(i % 5 == 2)))
    docs += [(400, docs[10][1], "en", "s", 0), (401, docs[10][1].upper(), "en", "s", 0), (402, "12 34", None, None, None), (403, None, "en", "s", 0), (405, docs[30][1], "en", "s", 0), (405, docs[30][1], "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, items


def test_stages_against_plain_versions(spark, tables):
    at, rows, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), before.schema)
        assert docs.columns == before.columns
        got[name] = (sorted(before.collect(), key=repr), sorted(docs.collect(), key=repr))
    before, after = got["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {402, 403}
    before, after = got["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    truly = {i for i in range(400) if i % 5 == 2}
    assert len(gone & truly) >= 0.97 * len(truly) and len(gone - truly) <= 4
    before, after = got["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(set(slow_least([(r.doc_id, r.text) for r in before]).values()))
    before, after = got["decontamination"]
    bad = {r.doc_id for r in before if any(contains(r.text, s) >= 0.8 for _, s in items)}
    assert bad and {r.doc_id for r in after} == {r.doc_id for r in before} - bad
    pieces = corpus_pipeline.packed(spark, docs, at).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in after}
    total = sum(r.length for r in pieces)
    assert len({r.sequence_id for r in pieces}) <= total / packing.SEQUENCE + 2


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert got.count() > 100 and "sequence_id" in got.columns


def test_empty_input(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).count() == 0


def test_all_stages_take_texts_in_small_batches(spark, tables, monkeypatch):
    """No stage hands a worker more than ROWS texts at once, and the session's own setting holds again afterwards."""
    name, seen, made = "spark.sql.execution.arrow.maxRecordsPerBatch", [], corpus_pipeline.written
    before = spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, tag: (seen.append(int(spark.conf.get(name))), made(df, tag))[1])
    corpus_pipeline.run(spark, tables[0])
    assert len(seen) == len(corpus_pipeline.STAGES) and max(seen) <= corpus_pipeline.ROWS < int(before) and spark.conf.get(name) == before
