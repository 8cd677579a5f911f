"""Language, quality and leaks: held-out accuracy, brute force, and awkward rows."""

from __future__ import annotations

import random

from hushgrid.llm import decontaminate as DC
from hushgrid.llm import language_id as LID
from hushgrid.llm import quality as Q

VOCAB = {"en": "the of and with this that from river stone", "de": "der die und mit nicht fluss stein über schön", "fr": "le la et avec pas fleuve pierre été où"}


def sentence(lang, seed, n=25):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(VOCAB[lang].split()) for _ in range(n))


def corpus(spark, n=30):
    rows = [(k * 3 + j, sentence(lang, k), lang) for k in range(n) for j, lang in enumerate(VOCAB)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language(spark, docs, rows, nothing):
    model = LID.train(corpus(spark))
    for lang in VOCAB:
        assert model.predict(sentence(lang, 999))[0] == lang
    assert model.predict("flussstein nichtschön")[0] == "de"  # unseen words back off to n-grams
    for text in (None, "", "123 !!", "\u00b2\u00b2"):
        assert model.predict(text) == ("und", 0.0)
    got = LID.predict_language(docs, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert LID.predict_language(nothing, model).count() == 0
    blank = LID.train(nothing)
    assert blank.predict("any words")[0] == "und"


def test_quality(spark, docs, rows, nothing):
    r = random.Random(5)
    good = [(k, sentence("en", k, 60).capitalize() + ".", 1) for k in range(60)]
    bad = [(100 + k, " ".join(w.upper() + "!!" for w in sentence("en", k, 40).split()), 0) for k in range(30)] + [(200 + k, " ".join([r.choice("river stone the".split())] * 50), 0) for k in range(30)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(7, None)], "doc_id bigint, quality int")
    model = Q.train(df, labels)
    test = spark.createDataFrame([(1, sentence("en", 999, 60).capitalize() + "."), (2, " ".join(w.upper() + "!!" for w in sentence("en", 998, 40).split())), (3, "stone " * 60)], "doc_id bigint, text string")
    assert [x.predicted for x in Q.classify(test, model).orderBy("doc_id").collect()] == [1, 0, 0]
    got = Q.classify(docs, model).select("text", "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    same = {}
    for x in got:
        assert same.setdefault(x.text, x.score) == x.score
    assert Q.classify(nothing, model).count() == 0
    assert Q.classify(docs, Q.train(nothing, labels)).filter("score <> 0.5").count() == 0


def test_score_against_its_definition(monkeypatch):
    """From texts to scores: terms, TF-IDF, singular vectors, cosines and votes, each by its plain definition."""
    import numpy as np

    texts = [sentence(lang, k, 10 + k % 40) + (" OK?? --" if k % 3 else ".") for k in range(60) for lang in ("en", "de")]
    labels = np.array([k % 2 for k in range(len(texts))], dtype=float)
    rows = [Q.features(t) for t in texts]
    idf, basis = Q.decompose(rows, 12, rounds=60)
    dense = np.zeros((len(texts), Q.TERMS))
    for k, t in enumerate(texts):
        words = t.split()
        for w in words:  # words and their shapes, as shares
            dense[k, Q.word_column(w)] += 1 / len(words)
            dense[k, Q.form_column("s:" + Q.shape(w))] += 1 / len(words)
        got = np.zeros(Q.TERMS)
        got[rows[k][0]] = rows[k][1]
        only = dense[k] > 0
        assert (got[only] ** 2 >= dense[k][only] - 1e-6).all() and (np.diff(rows[k][0]) > 0).all()
        dense[k] = got
    assert np.allclose(idf, np.log((1 + len(texts)) / (1 + (dense > 0).sum(axis=0))) + 0.5, atol=1e-5)
    values, right = np.linalg.svd(dense * idf, full_matrices=False)[1:]
    # the same space: projections on it agree wherever the singular values part it from the rest
    assert values[11] > values[12] and np.allclose(basis @ (basis.T @ right[:8].T), right[:8].T, atol=1e-2)
    model = Q.Model(idf, basis, np.zeros((0, 1)), labels, 5)
    model.vectors = model.embed(rows)
    plain = (dense * idf) @ basis
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert np.allclose(model.vectors, plain, atol=1e-4)
    cosine = np.round(model.vectors @ model.vectors.T, 5)
    want = []
    for c in cosine:
        near = sorted(range(len(texts)), key=lambda j: (-c[j], j))[:5]  # ties: the first in the fitted order
        w = np.array([max(0.0, float(c[j])) ** 2 for j in near])
        want.append((w * labels[near]).sum() / w.sum())
    assert np.allclose(model.score(rows), want, atol=1e-6)
    monkeypatch.setattr(Q, "BLOCK", 7)
    assert np.allclose(model.score(rows), want, atol=1e-4)
    assert model.score([Q.features(None)])[0] == labels.mean()


def test_ties_of_neighbours_go_by_fitted_order():
    import numpy as np

    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.5, 0.1], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.2] * 6])
    labels = np.array([1.0, 0, 0, 1, 1, 1])
    assert np.allclose(Q.vote(cosine, labels, 3, 0.7), [0.25 / (0.81 + 0.5), 0.7, 1 / 3])


def test_quality_sample_is_bounded(spark):
    df = spark.createDataFrame([(k % 7, f"text {k} " * 5) for k in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k % 7, k % 2) for k in range(300)] + [(None, 1)], "doc_id bigint, quality int")
    assert len(Q.train(df, labels, max_labelled=40).labels) == 40
    assert len(Q.train(df, labels, max_labelled=4).labels) == 4


def test_words_tell_quality_where_forms_do_not(spark):
    r = random.Random(9)
    say = lambda words: " ".join(r.choice(words.split()) for _ in range(40))
    rows = [(k, say("gravel window harbour meadow") if k % 2 else say("casino jackpot roulette winning"), k % 2) for k in range(80)]
    model = Q.train(spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string"), spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id bigint, quality int"))
    assert [s >= 0.5 for s in model.score([Q.features(say("harbour meadow gravel")), Q.features(say("roulette winning casino"))])] == [True, False]


def test_language_ties_and_bounds(spark):
    same = "la mer et le soleil " * 5
    model = LID.train(spark.createDataFrame([(k, f"{same} {k}", lang) for k in range(20) for lang in ("xx", "aa")], "doc_id bigint, text string, lang string"))
    assert model.predict("la mer") == ("aa", 0.5)  # the first by name
    letters = lambda n: chr(97 + n // 26) + chr(97 + n % 26)
    many = [(k, " ".join(f"w{letters(k)}x{letters(j)}" for j in range(40)) + " common", "en") for k in range(60)]
    df = spark.createDataFrame(many, "doc_id bigint, text string, lang string")
    small = LID.train(df, max_words=7, max_grams=50)
    assert len(small.words) == 7 and "common" in small.words and len(small.grams) <= 50
    assert "waaxaa" in LID.train(df).words  # words seen once are learned where there is room
    copies = spark.createDataFrame([(k, "one text that is all there is", "en") for k in range(300)] + many, "doc_id bigint, text string, lang string")
    assert LID.train(copies, max_docs_per_lang=10).words.keys() <= LID.train(copies).words.keys()


ITEMS = [(1, "What is the name of the old river near the northern stone market. It is the Wend."), (2, "Single short line"), (3, None), (4, ""), (5, " ".join(f"word{k}" for k in range(150)) + ". The answer is seven.")]


def brute(text, overlap=0.8):
    have = DC.tokens(text)
    out = []
    for i, item in ITEMS:
        grams = DC.ngrams(DC.tokens(item))
        if grams and sum(any(tuple(have[k : k + len(g)]) == g for k in range(len(have))) for g in grams) / len(grams) >= overlap:
            out.append(i)
    return out


def test_leaks(spark, docs, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    filler = sentence("en", 3, 300)
    cases = {1: filler + " " + ITEMS[0][1] + " " + filler, 2: ITEMS[0][1].upper().replace(".", " !"), 3: filler, 4: "so: single, short line?", 5: filler + ITEMS[4][1] + filler, 6: "the name of the old river", 7: None, 8: ""}
    df = spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in DC.contaminated(df, bench).collect()}
    assert got == {(k, i) for k, t in cases.items() for i in brute(t)} == {(1, 1), (2, 1), (4, 2), (5, 5)}
    assert {(r.doc_id, r.item_id) for r in DC.contaminated(df, bench, max_postings=1).collect()} == got
    assert DC.contaminated(nothing, bench).count() == 0 and DC.contaminated(df, bench.limit(0)).count() == 0
    assert DC.contaminated(docs, bench).count() == 0


def plain_retrieval(index, words):
    """(passage, item, score) of every passage against every part of an item, without bounds or cursors."""
    out = set()
    for k, a in enumerate(range(0, len(words), DC.STEP)):
        own = sorted({index.terms[w] for w in words[a : a + DC.WINDOW] if w in index.terms})
        for part in range(len(index.needed)):
            score = sum(index.gain[j] for t in own for j in range(index.first[t], index.first[t + 1]) if index.part[j] == part)
            if score >= index.needed[part] * (1 - 1e-9):
                out.add((k, index.owner[part], round(score, 6)))
    return out


def test_retrieval_equals_brute_force(monkeypatch):
    r = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([3, 12, 40, 150])))) for k in range(60)]
    lists = [[random.Random(seed).choice(words) for _ in range(n)] for seed, n in enumerate([400, 1, 0, 63, 64, 65, 129, 900] * 4)]
    for block, bounds, share in ((2, 4_000_000, 0.5), (16, 100, 0.5), (7, 1, 0.3)):
        monkeypatch.setattr(DC, "BLOCK", block)
        monkeypatch.setattr(DC, "BOUNDS", bounds)
        index = DC.Index(items, share)
        got = list(index.retrieve(lists, [-(-len(w) // DC.STEP) for w in lists]))
        want = {(k, *x) for k, own in enumerate(lists) for x in plain_retrieval(index, own)}
        assert len(got) == len(set(got)) and {(k, p, i, round(s, 6)) for k, p, i, s in got} == want


def test_leaks_equal_brute_force_on_many_texts():
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(18)) + "? " + " ".join(say(9)) + ".") for k in range(120)]
    index = DC.Index(items, 0.5)
    texts, planted, damaged = [], {}, {}
    for k in range(1_000):
        own = say(r.choice([0, 20, 200, 700]))
        if k % 4 == 0:
            i = r.randrange(len(items))
            words = DC.tokens(items[i][1])
            if k % 8 == 0:  # cut at one end, or a word replaced
                words = words[2:] if k % 16 else [*words[:12], "other", *words[13:]]
                damaged[k] = i
            else:
                planted[k] = i
            at = r.randrange(len(own) + 1)
            own[at:at] = words
        texts.append(" ".join(own))
    got = [{x["item_id"] for x in found} for found in DC.leaks([index], texts, 0.8)]

    def plain(words, i):
        have = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        q, a, whole = (sum(g in have for g in grams) / len(grams) for grams in map(DC.ngrams, (*DC.question_and_answer(items[i][1]), DC.tokens(items[i][1]))))
        return whole >= 0.8 and q >= 0.8 and a >= 0.5

    want = [{i for i in range(len(items)) if plain(DC.tokens(t), i)} for t in texts]
    assert got == want
    assert all(i in got[k] for k, i in planted.items())
    cut = [i in got[k] for k, i in damaged.items() if k % 16]
    assert sum(cut) / len(cut) >= 0.9


def test_long_texts_go_by_in_pieces(monkeypatch):
    monkeypatch.setattr(DC, "CHARS", 700)
    monkeypatch.setattr(DC, "WORDS", 4 * DC.STEP)
    item = "What is the name of the old river near the northern stone market. It is the Wend."
    index = DC.Index([(1, item)], 0.5)
    words = sentence("en", 1, 5_000).split()
    for at in (0, 60, 190, 250, 257, 2_011, 5_000):
        text = " ".join(words[:at]) + " " + item + " " + " ".join(words[at:])
        cut = DC.Text(text)
        passages = [(first + k, own[k * DC.STEP : k * DC.STEP + DC.WINDOW]) for first, own, n in cut.pieces() for k in range(n)]
        all_ = DC.tokens(text)
        assert passages == [(k, all_[k * DC.STEP : k * DC.STEP + DC.WINDOW]) for k in range(-(-len(all_) // DC.STEP))]
        assert cut.stretch(at - 30, at + 40) == all_[max(0, at - 30) : at + 40] or at < 30
        assert [x["item_id"] for x in DC.leaks([index], [text], 0.8)[0]] == [1]
    # pieces of an item all over a long text are no leak: they are not in one place
    halves = DC.tokens(item)
    scattered = " ".join(" ".join(halves[k : k + 5]) + " " + " ".join(words[k * 200 : k * 200 + 200]) for k in range(len(halves) - 4))
    assert DC.leaks([index], [scattered], 0.8) == [[]]


def test_ids_of_any_type(spark):
    bench = spark.createDataFrame([("b", ITEMS[0][1]), (None, ITEMS[4][1]), ("b", ITEMS[0][1])], "item_id string, text string")
    df = spark.createDataFrame([("x", f"so {ITEMS[0][1]} {ITEMS[4][1]}")], "doc_id string, text string")
    assert sorted((r.doc_id, str(r.item_id)) for r in DC.contaminated(df, bench).collect()) == [("x", "None"), ("x", "b")]


def test_items_of_one_id_or_none_are_each_found():
    items = [(7, "What flows past the old northern stone market in winter? The river Wend flows there."), (7, "Who wrote the long letter about the harbour wall? It was the young clerk of the town."), (None, "Which road leads over the hill to the garden by the lake? It is the narrow mill road.")]
    index = DC.Index([*items, items[0]], 0.5)
    assert [[x["item_id"] for x in found] for found in DC.leaks([index], [f"before {t} after" for _, t in items], 0.8)] == [[7], [7], [None]]
