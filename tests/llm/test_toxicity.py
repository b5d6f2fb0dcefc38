import random
import zlib

import numpy as np
import pytest

from assay.llm import toxicity
from tests.llm import data

INSULTS = ["grobnik", "shalvet", "muntrop"]
HIDDEN = {"grobnik": ["gr0bnik", "gr.o.b.n.i.k".replace("gr.", "g.r."), "g r o b n i k", "grooobnik"], "shalvet": ["$halvet", "sh@lvet", "s-h-a-l-v-e-t"], "muntrop": ["muntr0p", "m u n t r o p"]}


def corpus(n=600):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        words = data.text(10_000 + i, 40).split()
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(INSULTS, rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def fitted(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    train = docs.where(~toxicity.held_out(3)).join(marks, "doc_id").select("text", "toxic")
    return docs, marks, toxicity.fit(train, 4)


def test_held_out_rows(fitted):
    docs, marks, _ = fitted
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    got = toxicity.toxicity(docs, marks, ["doc_id"]).collect()
    held = [g for g in got if zlib.crc32(str(g.doc_id).encode()) % 3 == 1]
    assert len(got) == 600 and all(g.predicted == truth[g.doc_id] for g in held)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)


def test_hidden_insults_are_restored(spark, fitted):
    model = fitted[2]
    texts = [f"{data.text(i, 10)} {h} {data.text(i + 1, 8)}" for i, h in enumerate(h for hs in HIDDEN.values() for h in hs)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all(got[i] >= 0.7 for i in range(len(texts))), [(texts[i], got[i]) for i in got if got[i] < 0.7]


def test_viterbi_against_all_paths(fitted):
    language = toxicity.Language(np.frombuffer(fitted[2].language).reshape(toxicity.ALPHABET, toxicity.ALPHABET, toxicity.ALPHABET))

    def all_paths(choices, a=0, b=0):
        if not choices:
            return [(0.0, "")]
        out = []
        for piece, cost in choices[0]:
            x, y, total = a, b, cost
            for c in piece:
                z = toxicity.symbol(c)
                total += language.three[x, y, z]
                x, y = (y, z) if z else (0, 0)
            out += [(total + s, piece + t) for s, t in all_paths(choices[1:], x, y)]
        return out

    for core, spaced in (("gr0bn1k", False), ("$h@lvet", False), ("muuuntr0p", False), ("grob", True), ("1d10t", False)):
        best = max(all_paths([*toxicity.lattice(core, spaced), [(" ", 0.0)]]))
        got = toxicity.decode(core, language, spaced)
        assert got == best[1].strip()


def test_odd_cases(spark, fitted):
    got = toxicity.score(data.frame(spark), fitted[2], ["doc_id", "kept"]).collect()
    assert len(got) == len(data.rows()) and all(0 <= g.score <= 1 for g in got)
    assert next(g for g in got if g.doc_id == 0).score == next(g for g in got if g.doc_id == 1).score < 0.7
    assert toxicity.toxicity(data.empty(spark), fitted[1], ["doc_id"]).collect() == []


def test_without_labels(spark, fitted):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(fitted[0], none, ["doc_id"]).collect()} == {(0.0, 0)}


def test_causes_alone_suffice():
    rows = [([0, 1], 1)] * 40 + [([0], 1)] * 3 + [([2], 0)] * 60 + [([1, 2], 0)] * 5 + [([], 0)] * 50
    weights, bias = toxicity.fit_weights(rows, 3)
    assert 1 - np.exp(-weights[0]) > 0.95 and weights[1] < 0.3 and weights[2] < 0.05 and bias < 0.01


def test_every_labelled_row_and_feature_counts(spark):
    """25,000 rows of their own words; five words stand in five toxic texts each, and 6,000 more tell the labels apart."""
    rare = ["quibzor", "wexplim", "dvorniq", "zkabluf", "hjemtod"]
    rows = [(f"{w} plain{i} other words", 1) for w in rare for i in range(5)]
    rows += [(" ".join(f"x{k}q" for k in range(a, a + 200)) + f" y{i}", 1) for a in range(0, 6000, 200) for i in range(8)]
    rows += [(f"plain{i} other words", 0) for i in range(25_000)]
    train = spark.createDataFrame(rows, "text string, toxic int")
    model = toxicity.fit(train, 4)
    assert len(model.keys) >= 6_000
    docs = spark.createDataFrame([(i, f"some {w} here") for i, w in enumerate([*rare, "nothing"])], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_slopes_of_tasks_and_driver_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(np.flatnonzero(rng.random(12) < 0.3).astype(np.int32).tobytes(), int(rng.integers(1, 5))) for _ in range(300)]
    sets = spark.createDataFrame(rows, "key binary, n long").repartition(5)
    theta = np.r_[rng.random(12), 0.01]
    spread = toxicity.spread_slopes(sets)(theta)
    assert np.allclose(spread, toxicity.toxic_slopes(theta, *toxicity.sets_of(*map(list, zip(*rows)))), rtol=1e-12)


def test_every_hidden_form_is_restored(spark, fitted):
    """Signs at the ends, few letters, separators among look-alikes, spaced look-alikes, doubled letters, long words."""
    hidden = ["grobnik!", "(grobnik", "+grobnik", "munt.r.0.p", "m.u.n.t.r.0.p", "m u n t r 0 p", "$ h @ l v e t", "shalve+", "$h@1v3+", "$halve+!",
              "ggrroobbnniikk", "mmuunnttrroopp", "grob" + "." * 50 + "nik", "$-h-@-l-v-e-+"]
    docs = spark.createDataFrame([(i, f"{data.text(i, 10)} {h} {data.text(i + 1, 8)}") for i, h in enumerate(hidden)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, fitted[2], ["doc_id"]).collect()}
    assert all(got[i] >= 0.7 for i in got), [(hidden[i], got[i]) for i in got if got[i] < 0.7]


def test_which_words_are_decoded():
    for word in ("a$$", "a55", "5h17", "@$$", "4$$", "idio+", "!diot", "|diot", "(lown", "1.d.1.0.t", "iidioott", "i" + "." * 60 + "diot"):
        assert toxicity.suspicious(toxicity.outer_of(word)), word
    for word in ("100", "24/7", "$100", "1,000.50", "50€", "3+4", "$5-$10", "1.2.3", "plain", "!!!", "|", "word."):
        assert not toxicity.suspicious(toxicity.outer_of(word)), word
    assert all(map(toxicity.single, "1d0@$!"))


def test_a_long_word_takes_linear_time(fitted):
    language = toxicity.Language(np.frombuffer(fitted[2].language).reshape(toxicity.ALPHABET, toxicity.ALPHABET, toxicity.ALPHABET))
    assert len(toxicity.decode("gr0bnik" * 10_000, language)) > 50_000
