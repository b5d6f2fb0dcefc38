import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assay.llm import jaccard
from tests.llm import data


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n_shingles, component_id) of every row, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (i, s) in enumerate(sets):
        for b, (j, u) in enumerate(sets[:a]):
            if i is not None and j is not None and (i == j or (s and u and 100 * len(s & u) >= 80 * len(s | u))):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)].append(i)
    return sorted((str(i), len(s), str(min(least[find(a)], default=None))) for a, (i, s) in enumerate(sets))


def check(spark, rows):
    docs = spark.createDataFrame([r + ("clash",) for r in rows], "doc_id long, text string, tokens string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_components(docs).collect())
    assert got == brute(rows)


def test_odd_cases_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in data.rows()]
    check(spark, rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_of_near_copies_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = data.text(900 + seed, 60)
    rows = []
    for g in range(6):
        base = data.text(1000 * seed + g, rng.randint(40, 220))
        for k in range(rng.choice([3, 20, 60])):
            t = data.changed(base, rng.random(), rng.randint(0, max(1, len(base.split()) // 25)))
            if rng.random() < 0.3:  # some shorter or longer than their head, some of them copies of each other
                t = " ".join(t.split()[rng.randint(0, 12):]) if rng.random() < 0.5 else t + " " + data.text(rng.randint(1, 9), rng.randint(1, 14))
            rows.append(t)
    rows += [passage + " " + data.text(5000 + k, rng.randint(5, 80)) for k in range(60)] + [passage] * 5
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_ranges_and_batches_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BATCH", 2_000)
    monkeypatch.setattr(jaccard, "SMALL", 0)
    check(spark, [(r[0], r[1]) for r in data.rows()])


def test_chain_is_one_component(spark):
    words = data.text(77, 400).split()
    rows = [(i, " ".join(words[4 * i:4 * i + 120])) for i in range(40)]  # neighbours are similar, the ends share nothing
    check(spark, rows)


def test_empty_table(spark):
    assert jaccard.similar_components(data.empty(spark)).collect() == []


def test_keep_one(spark):
    docs = data.frame(spark)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    stay = {int(c) for i, _, c in brute([(r[0], r[1]) for r in data.rows()]) if c != "None"}
    assert {r.doc_id for r in out.collect()} - {None} == stay


def test_texts_of_one_doc_id_are_one_document(spark):
    a, b = data.text(31, 80), data.text(32, 90)
    rows = [(1, a), (1, b), (2, data.changed(a, 1, 1)), (3, data.changed(b, 2, 1)), (2, a), (3, b), (5, data.text(33, 40)), (5, data.changed(b, 3, 1)), (4, data.text(34, 50)), (4, "")]
    for order in (rows, rows[::-1]):
        check(spark, order)


@pytest.mark.parametrize("sizes", ["103", "95 + id % 20"])
def test_a_template_of_many_pages_is_linear(spark, sizes):
    """Sets that share 86 shingles of a template and are not similar: comparing them by two would take 800 million steps."""
    n = F.expr(f"CAST({sizes} AS INT)")
    heads = spark.range(40_000).select("id", n.alias("n")).withColumns({
        "tokens": F.expr("transform(sequence(1, 86), x -> CAST(x AS BIGINT))"), "need": (F.col("n") * 80).cast("long"), "least": F.ceil(F.col("n") * 0.78)})
    begin = time.time()
    jaccard.candidates(jaccard.stored(heads, "template"), 80).count()
    assert time.time() - begin < 40


def test_long_blocks_are_parted_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_BLOCK", 2)
    rng = random.Random(8)
    passage = data.text(700, 70)
    rows = [(k, passage + " " + data.text(7000 + k % 25, rng.randint(3, 60))) for k in range(90)]
    check(spark, rows)
