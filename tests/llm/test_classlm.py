import math
import random
import zlib
from collections import Counter

import numpy as np

from assay.llm import classlm
from tests.llm import data


def words(t):
    return [*(t or "").encode().lower().split(), b""]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def test_base_against_brute_force(spark):
    rows = data.rows()
    counts = Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    unit = math.log10(total + 0.5 * (distinct + 1))
    want = sorted((r[0] is None, r[0] or 0, held(r[0]), len(words(r[1])), sum(counts[w] > 0 for w in words(r[1])), total,
                   round(sum(math.log10(counts[w] + 0.5) - unit for w in words(r[1])), 4)) for r in rows)
    got = classlm.class_scores(data.frame(spark)).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4)) for g in got) == want
    assert all(g.score < 0 for g in got)


def test_rare_words_take_the_long_way(spark, monkeypatch):
    want = sorted(map(str, classlm.class_scores(data.frame(spark)).select("doc_id", "n_known", "base_score").collect()))
    monkeypatch.setattr(classlm, "FREQUENT", 8)
    monkeypatch.setattr(classlm, "CLUSTERED", 4)
    monkeypatch.setattr(classlm, "BATCH", 500)
    monkeypatch.setattr(classlm, "FLUSH", 20)
    got = classlm.class_scores(data.frame(spark)).select("doc_id", "n_known", "base_score").collect()
    number = lambda rows: sorted((str(r[0]), r[1], round(r[2], 6)) for r in rows)
    assert number(got) == number(classlm.class_scores(data.frame(spark)).select("doc_id", "n_known", "base_score").collect())
    assert len(want) == len(got)


def test_score_of_one_text_from_the_model(spark):
    docs = data.frame(spark)
    train = docs.where(~classlm.held_out(5))
    vocab = classlm.vocabulary(train, 3)
    model = classlm.fit(train, vocab)
    assert np.allclose((10 ** model.follows).sum(1), 1)
    counts = Counter(w for r in data.rows() if not held(r[0]) for w in words(r[1]))
    text = data.rows()[30][1]
    class_of = lambda w: int(model.words.classes_of(np.array([classlm.key_of(w)], np.uint64), model.of)[0])
    before, score = model.of[-1], 0.0
    for w in words(text):
        c = class_of(w)
        score += model.follows[before, c] + math.log10(counts[w] + 0.5) - model.emits[c]
        before = c
    got = classlm.score(docs.where("doc_id = 30"), model, vocab, 3).first()
    assert abs(got.score - score) < 1e-6


def likelihood(matrix, of):
    member = np.eye(of.max() + 1)[of]
    table = member.T @ matrix @ member
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(table) - f(table.sum(0)) - f(table.sum(1))


def test_exchange_raises_the_likelihood_and_finds_planted_classes():
    rng = np.random.default_rng(0)
    planted = np.arange(40) % 4
    matrix = rng.poisson(np.where((planted[:, None] + 1) % 4 == planted[None, :], 30, 1))
    start = np.r_[np.random.default_rng(1).permutation(40)]
    shuffled = np.zeros((41, 41), dtype=np.int64)
    shuffled[:40, :40] = matrix[np.ix_(start, start)]
    of = classlm.exchange(shuffled, 40, learned=4, rounds=30)
    first = np.r_[np.arange(40) % 4, 4]
    assert likelihood(shuffled, of) > likelihood(shuffled, first)
    assert len({(planted[s], o) for s, o in zip(start, of[:40])}) == 4


def test_frequent_words_join_the_class_of_their_neighbours(spark, monkeypatch):
    """Two kinds of words take turns; the rare ones of either kind, which exchange does not see, are told apart by their neighbours alone."""
    monkeypatch.setattr(classlm, "CLUSTERED", 12)
    monkeypatch.setattr(classlm, "LEARNED", 2)
    monkeypatch.setattr(classlm, "RANGE", 7)
    monkeypatch.setattr(classlm, "exchange", lambda matrix, clustered, exchange=classlm.exchange: exchange(matrix, clustered, 2))
    monkeypatch.setattr(classlm, "best_classes", lambda *a, best=classlm.best_classes: best(*a, learned=2))
    rng = random.Random(3)
    one, two = [[f"{c}{i}z" for i in range(30)] for c in "ab"]
    pick = lambda ws: ws[min(int(rng.expovariate(0.25)), 29)]
    rows = [(i, " ".join(pick(one) + " " + pick(two) for _ in range(80)), None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = classlm.fit(docs, classlm.vocabulary(docs, 3))
    class_of = lambda w: int(model.words.classes_of(np.array([classlm.key_of(w.encode())], np.uint64), model.of)[0])
    seen = {w for r in rows for w in r[1].split()}
    kinds = [{class_of(w) for w in ws if w in seen} for ws in (one, two)]
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1] and max(*kinds[0], *kinds[1]) < 2


def test_empty_table(spark):
    assert classlm.class_scores(data.empty(spark)).collect() == []


def test_no_training_rows(spark):
    rows = [r for r in data.rows() if r[0] is not None and held(r[0])]
    got = classlm.class_scores(data.frame(spark, rows)).collect()
    assert len(got) == len(rows) and {g.train_tokens for g in got} == {0} and {g.n_known for g in got} == {0}
