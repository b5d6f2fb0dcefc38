import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assay.llm import mixing
from tests.llm import data


def brute_fill(children, budget):
    """Whole-token targets: the least needy full child is set aside until no child is full."""
    targets, left, rest = {}, list(children), budget
    while left:
        left.sort(key=lambda c: (c[2] / c[1], c[0]))
        weights = sum(w for _, w, _ in left)
        name, weight, capacity = left[0]
        if rest * weight // weights >= capacity:
            targets[name] = capacity
            rest -= capacity
            left.pop(0)
        else:
            targets |= {n: rest * w // weights for n, w, _ in left}
            break
    return targets


def brute(leaves, budget, weights, epochs):
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    capacity = defaultdict(int)
    for (d, l, s), tokens in leaves.items():
        for node in ((), (d,), (d, l), (d, l, s)):
            capacity[node] += tokens * epochs
    target = {(): min(budget, capacity[()])}
    for depth, level in enumerate(mixing.LEVELS, 1):
        for parent in [n for n in list(target) if len(n) == depth - 1]:
            children = [(n, w(level, n[-1]), c) for n, c in capacity.items() if len(n) == depth and n[:-1] == parent]
            target |= brute_fill(children, target[parent])
    return {n: t for n, t in target.items() if len(n) == 3}


@pytest.mark.parametrize("seed", range(6))
def test_budgets_against_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = {(d, l, f"src{s}"): rng.choice([0, 3, 50, 700, 9000]) for d in ("web", "books", "code") for l in ("en", "de", "fr")
              for s in range(rng.randint(1, 4)) if rng.random() < 0.8}
    total = sum(leaves.values())
    df = spark.createDataFrame([(*k, 1, t) for k, t in leaves.items()], "domain string, lang string, source string, docs long, tokens long")
    for budget in (0, total // 7, total // 2, total, 3 * total):
        got = {(r.domain, r.lang, r.source): r.target for r in mixing.budgets(df, F.lit(budget).cast("long"), mixing.WEIGHTS, 2).collect()}
        assert got == brute(leaves, budget, mixing.WEIGHTS, 2)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [("a", "x", "s1", 1, 10), ("a", "x", "s2", 1, 1000), ("a", "y", "s3", 1, 1000), ("b", "x", "s4", 1, 1000)]
    df = spark.createDataFrame(rows, "domain string, lang string, source string, docs long, tokens long")
    got = {r.source: r.target for r in mixing.budgets(df, F.lit(800).cast("long"), {}, 1).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}  # s2 takes what s1 lacks; the language beside and the other domain give nothing
    rows[1] = ("a", "x", "s2", 1, 100)
    df = spark.createDataFrame(rows, "domain string, lang string, source string, docs long, tokens long")
    got = {r.source: r.target for r in mixing.budgets(df, F.lit(800).cast("long"), {}, 1).collect()}
    assert got == {"s1": 10, "s2": 100, "s3": 290, "s4": 400}  # only the language beside takes the rest


def test_selection_is_a_prefix_of_seeded_epochs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)  # many ranges
    docs = spark.createDataFrame([(i, " ".join("w" * (1 + i % 9))[:1 + 2 * (i % 9)], "en", f"src{i % 3}", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.selection(docs, share=1.3, epochs=3).collect()
    size = {r.doc_id: r.n_tokens for r in mixing.selection(docs, share=1.0, epochs=1).collect()}
    total = sum(1 + i % 9 for i in range(400))
    by_leaf = defaultdict(list)
    for r in got:
        assert 0 < r.taken <= r.n_tokens
        by_leaf[r.domain, r.lang, r.source].append(r)
    assert total * 1.3 - 20 <= sum(r.taken for r in got) <= total * 1.3
    for rows in by_leaf.values():
        assert sum(r.taken < r.n_tokens for r in rows) <= 1
        last = max(r.epoch for r in rows)
        for e in range(last):
            assert len({r.doc_id for r in rows if r.epoch == e}) == len([r for r in rows if r.epoch == e])
    assert size
    again = mixing.selection(docs, share=1.3, epochs=3).collect()
    key = lambda rows: sorted((r.doc_id, r.epoch, r.taken) for r in rows)
    assert key(got) == key(again) != key(mixing.selection(docs, share=1.3, epochs=3, seed=5).collect())


def test_odd_cases(spark, monkeypatch):
    docs = data.frame(spark)
    few = sorted(str(r) for r in mixing.selection(docs).drop("row").collect())
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(str(r) for r in mixing.selection(docs).drop("row").collect()) == few
    everything = mixing.selection(docs, share=1.0, epochs=1)
    assert everything.agg(F.sum("taken")).first()[0] >= sum(len((r[1] or "").encode().split()) for r in data.rows()) - 40
    assert mixing.mixed(docs, share=0.5, epochs=1).columns == docs.columns
    assert mixing.selection(data.empty(spark)).collect() == [] and mixing.selection(docs, tokens=0).collect() == []
    with pytest.raises(ValueError):
        mixing.selection(docs, weights={"lang": {"en": -1}}).collect()


def test_weight_zero_is_never_taken(spark):
    got = mixing.selection(data.frame(spark), share=1.0, weights={"lang": {"de": 0}}).collect()
    assert got and "de" not in {r.lang for r in got}


def test_plan_is_native(spark):
    plan = mixing.selection(data.frame(spark))._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan]
