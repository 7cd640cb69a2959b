import random

import numpy as np

from lectern.llm import language_id, toxicity

WORDS = {"aa": "the of and house water light stone".split(), "bb": "der und das haus wasser licht stein".split(), "cc": "les des une maison eau lumière pierre".split()}


def texts(n, seed=0):
    rng = random.Random(seed)
    for i in range(n):
        lang = "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]
        toxic = int(i % 4 == 1)
        words = rng.choices(WORDS[lang], k=rng.randrange(5, 60))
        if toxic:
            words.insert(rng.randrange(len(words)), {"aa": "vilewretch", "bb": "boesewichtel", "cc": "malotruque"}[lang])
        yield i, " ".join(words), lang, toxic


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9):
        codes = language_id.codewords(n)
        assert min(int((a != b).sum()) for i, a in enumerate(codes) for b in codes[:i]) >= max(1, codes.shape[1] // 4)


def test_language(spark):
    rows = [(i, t, lang, 1) for i, t, lang, _ in texts(300)] + [(1000, None, "aa", 1), (1001, "123 ...", "aa", 1), (None, "das wasser und das licht", None, 1), (1002, "", None, 1), (7, "der und", None, 1)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[None].lang_pred == "bb" and by_id[None].held_out
    assert np.mean([by_id[i].lang_pred == lang for i, _, lang, _ in texts(300) if by_id[i].held_out]) > 0.95
    empty = language_id.identify(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.count() == 0
    one = language_id.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert one.lang_pred == "und"


def test_toxicity(spark):
    rows = [(i, t, lang, "s") for i, t, lang, _ in texts(900)] + [(2000, None, None, None), (2001, "", "aa", "s"), (None, "the house", "aa", "s")]
    labels = [(i, y, 1) for i, _, _, y in texts(900)] + [(3, None, 1), (None, 1, 1), (5, 1, 0)]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by_id[2000].score == by_id[2001].score < 0.5
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    right = [by_id[i].predicted == y for i, _, _, y in texts(900) if by_id[i].held_out]
    assert np.mean(right) > 0.97
    blank = toxicity.score_documents(spark.createDataFrame(rows[:3], "doc_id long, text string, lang string, score string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in blank.collect()} == {0}


def test_long_text_is_scored_like_its_words_together():
    net = toxicity.Network()
    long = "word " * 200_000 + "other thing"
    scorer = toxicity.Scorer(net)
    at = scorer.indices(toxicity.text_words(long))
    assert np.allclose(net.best(scorer.vectors[at]), net.pooled(scorer.vectors[at])[0], atol=1e-5)


def plain_score(net, text):
    """Forward pass word by word and window by window, without stretches or remembered words."""
    rows = [sum(net.emb[b].astype(float) for b in toxicity.word_buckets(w)) for w in toxicity.text_words(text)]
    z = float(net.bias)
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            acts = [float(np.concatenate(rows[a : a + width]) @ net.filters[i][:, f]) + float(net.shift[i][f]) for a in range(len(rows) - width + 1)]
            z += max([0.0, *acts]) * float(net.out[i * toxicity.FILTERS + f])
    seen = [int(net.language[toxicity.word_buckets(w)[0]]) for w in toxicity.text_words(text)]
    counts = [seen.count(g) for g in range(1, len(net.thresholds))]
    guess = 1 + counts.index(max(counts)) if any(counts) else 0
    return 1 / (1 + np.exp(-(z - net.thresholds[guess])))


def test_scores_against_a_plain_forward_pass():
    rng, net = np.random.default_rng(3), toxicity.Network()
    net.emb = rng.normal(0, 0.4, net.emb.shape).astype(np.float32)
    net.language = rng.integers(0, 3, net.language.shape).astype(np.int8)
    net.thresholds = np.array([0.1, -0.3, 0.4])
    scorer = toxicity.Scorer(net)
    for text in (None, "", "...", "one", "one two", "a b c", *(t for _, t, _, _ in texts(60, 4))):
        assert abs(scorer.score(text) - plain_score(net, text)) < 1e-4


def test_sample_is_bounded_by_words(spark):
    rows = [(i, " ".join(["plain"] * 50 + ["vilewretch"] * (i % 2)), "aa") for i in range(200)] + [(500, "huge " * 50_000, "aa")] * 3
    labels = [(i, i % 2) for i in range(200)] + [(500, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(docs, marks, words=6000)
    scorer = toxicity.Scorer(net)
    assert scorer.score("plain plain") < 0.5 < scorer.score("plain vilewretch plain")
    assert not net.emb[toxicity.word_buckets(b"huge")].any()


def test_all_labelled_texts_are_learned_from(spark):
    """Far more than any former sample; what only a few texts of each stretch of ids tell is known as well."""
    n = 9000
    rows = [(i, f"plain words here {'vilewretch' if i % 2 else 'nothing'} " + (f"scarce{i // 3000} " * (i % 3000 < 6)), "aa") for i in range(n)] + [(n, "long " * 300_000, "aa"), (n, "long " * 300_000, "aa"), (n, "long " * 300_000, "aa")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame([(i, i % 2) for i in range(n)] + [(n, 0)], "doc_id long, toxic int")
    held_by, names, language = toxicity.counted(docs)
    at = lambda w: toxicity.word_buckets(w)[0]
    assert held_by[at(b"plain")] == n and held_by[at(b"long")] == 3 and [held_by[at(b"scarce%d" % k)] for k in range(3)] == [6] * 3
    assert names == ["aa"] and language[at(b"plain")] == 1
    net = toxicity.fit(docs, marks)
    assert net.emb[toxicity.word_buckets(b"long")].any(axis=1).all() and net.emb[toxicity.word_buckets(b"scarce0")].any()
    scorer = toxicity.Scorer(net)
    assert scorer.score("plain words here nothing") < 0.5 < scorer.score("plain words here vilewretch")


def test_no_labelled_row_is_left_out_before_the_join(spark):
    for ids in ([], [7], [*range(0, 3000, 3)], [k * 10**14 - 5 * 10**17 for k in range(2000)]):
        docs = spark.createDataFrame([(i,) for i in [*range(6000), *ids, *ids, None]], "doc_id long")
        got = [r.doc_id for r in toxicity.perhaps_labelled(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long"), len(ids)).collect()]
        own = set(ids)
        assert sorted(i for i in got if i in own) == sorted(r.doc_id for r in docs.collect() if r.doc_id in own)
        assert sum(i not in own for i in got) < 6000 / 20


def test_training_rounds_read_buckets_instead_of_texts(spark):
    """Texts are cut once, before the rounds; what is kept of them is what they give."""
    words, texts_ = toxicity.Buckets(), [None, "", " . ", "One two ONE", "é ñandú 漢字", "word other " * 30000]
    docs = spark.createDataFrame([(t, "x", i % 2, i == 3) for i, t in enumerate(texts_)], "text string, lang string, y int, later boolean").coalesce(1)
    got = toxicity.with_buckets(docs).collect()
    assert [r.text for r in got] == [None] * 3 + [texts_[3]] + [None] * 2 and [r.y for r in got] == [0, 1] * 3
    for text, r in zip(texts_, got, strict=True):
        own = [*words.of(text)]
        assert len(own) == len(r.words) and all(np.array_equal(toxicity.taken_up(b), a) for a, b in zip(own, r.words))
    assert len(got[-1].words) == 3 and sum(map(len, got[-1].words)) < len(texts_[-1])  # repeated words take less room than the text


def test_a_step_against_slopes_by_differences():
    """The loss of a batch falls along what a step takes away, weight by weight; empty, short and long texts."""
    rng, net, words = np.random.default_rng(2), toxicity.Network(), toxicity.Buckets()
    net.emb = rng.normal(0, 0.4, net.emb.shape).astype(np.float32)
    said, y = ["", "one", "one two", "a b c d one", "word " * 140_000 + "other a thing"], np.array([0, 1, 1, 0, 1])
    texts, weight, sums = [[*words.of(t)] for t in said], np.array([1, 2, 1, 1, 3.0]), np.full(net.emb.shape, 100, np.float32)
    assert len(texts[-1]) > 1
    flat = toxicity.dense(net)
    own = toxicity.Trainer(net, sums, np.full(len(flat), 100, np.float32), np.ones(toxicity.BUCKETS, bool))

    def loss(emb, flat):
        at = toxicity.Network()
        at.emb = emb
        toxicity.put_back(at, flat)
        z = np.array([np.log(p / (1 - p)) for p in (plain_score(at, t if len(t) < 1000 else "word word word other a thing") for t in said)])
        return float((weight * (np.log1p(np.exp(z)) - y * z)).mean())

    own.step(texts, y, weight)
    for k in [*range(len(flat) - 49, len(flat)), *rng.choice(24 * 8, 40, replace=False)]:
        up, down = flat.copy(), flat.copy()
        up[k] += 0.01
        down[k] -= 0.01
        slope = (loss(net.emb, up) - loss(net.emb, down)) / 0.02 + (1e-4 * flat[k] if k < len(flat) - 49 else 0)
        assert abs(slope - (flat[k] - own.other[k]) * np.sqrt(own.other_sums[k]) / toxicity.RATE) < 0.01
    for k in toxicity.word_buckets(b"one"):
        up, down = net.emb.copy(), net.emb.copy()
        up[k, 0] += 0.01
        down[k, 0] -= 0.01
        slope = (loss(up, flat) - loss(down, flat)) / 0.02
        assert abs(slope - (net.emb[k, 0] - own.emb[k, 0]) * np.sqrt(own.sums[k, 0]) / toxicity.RATE) < 0.01


def plain_language(model, text):
    """Codeword of least weighted exponential loss, bit by bit over the text's trigrams."""
    b = (" " + text.lower() + " ").encode().translate(language_id._SPACED)
    buckets = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> (32 - language_id.BUCKET_BITS) for i in range(len(b) - 2)]
    losses = []
    for code, weights in zip(model.codes, model.weights, strict=True):
        loss = 0.0
        for j, bit in enumerate(code):
            margin = sum(float(model.w[k, j]) for k in buckets) / len(buckets)
            loss += weights[j] * np.exp(-min(6, max(-6, bit * margin / model.scale[j])))
        losses.append(loss)
    p = [np.exp(-3 * (x - min(losses))) for x in losses]
    best = p.index(max(p))
    return model.languages[best], p[best] / sum(p)


def test_language_against_plain_decoding():
    rng = np.random.default_rng(1)
    rows = list(texts(200, 6))
    profiles = {}
    for _, t, lang, _ in rows:
        at = language_id.trigram_buckets(t)
        profiles[lang] = profiles.get(lang, 0) + np.bincount(at, minlength=1 << language_id.BUCKET_BITS) / at.size
    names = sorted(profiles)
    model = language_id.Model(names, np.array([profiles[x] for x in names]))
    model.weigh(np.array([names.index(lang) for _, _, lang, _ in rows]), np.array([model.margins(t) for _, t, _, _ in rows]))
    long = "das wasser und der stein " * 8000
    for text in [t for _, t, _, _ in rows[:60]] + ["x", "der the les", "日本 und", long]:
        want, p = plain_language(model, text)
        got, score, _ = model.predict(text)
        assert got == want and abs(score - p) < 1e-6
    same = language_id.Model(["b", "a"], np.ones((2, 1 << language_id.BUCKET_BITS)) * rng.random())
    assert same.predict("abc")[0] == "b" and same.predict("abc")[2]  # a tie goes to the first codeword, flagged
