"""Learnt matching weights, private exports, chunk plans for any key, reach through chains."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from assay.operators import govern, graph, matching, ordered
from assay.sources import readers


def people(seed, n, again):
    """n people, some of them entered twice with a field changed or lost; (id, name, town, born, phone), and who is who."""
    rng = random.Random(seed)
    rows = [(i, f"name{rng.randrange(n)}", f"town{rng.randrange(12)}", 1940 + rng.randrange(60), f"p{rng.randrange(10 * n)}") for i in range(n)]
    copies = []
    for i in rng.sample(range(n), again):
        r = list(rows[i])
        r[0] = 10_000 + i
        at = rng.randrange(1, 5)
        r[at] = None if rng.random() < 0.5 else ("other" if at != 3 else 1900)
        copies.append(tuple(r))
    return rows + copies


SCHEMA, FIELDS = "id int, name string, town string, born int, phone string", ["name", "town", "born", "phone"]


def patterns_of(rows):
    out = Counter()
    for a, b in combinations(rows, 2):
        out[sum(1 << i for i in range(4) if a[i + 1] is not None and a[i + 1] == b[i + 1])] += 1
    return dict(out)


def test_patterns_are_counted_without_pairs(spark):
    rows = people(1, 220, 60) + [(90_000 + i, None, "hot", None, None) for i in range(80)]
    got = {r.pattern: int(r.pairs) for r in matching.agreement_patterns(spark.createDataFrame(rows, SCHEMA), FIELDS).collect()}
    assert got == patterns_of(rows)
    assert matching.agreement_patterns(spark.createDataFrame([], SCHEMA), FIELDS).count() == 0


def slow_em(rows, start, rounds):
    """The same model over every single pair."""
    pairs = [[a[i + 1] is not None and a[i + 1] == b[i + 1] for i in range(4)] for a, b in combinations(rows, 2)]
    share, m, u = start.share, list(start.match), list(start.other)
    for _ in range(rounds):
        w = []
        for p in pairs:
            yes, no = share, 1 - share
            for i, agrees in enumerate(p):
                yes, no = yes * (m[i] if agrees else 1 - m[i]), no * (u[i] if agrees else 1 - u[i])
            w.append(yes / (yes + no))
        total = sum(w)
        share = total / len(w)
        m = [sum(x for x, p in zip(w, pairs) if p[i]) / total for i in range(4)]
        u = [sum(1 - x for x, p in zip(w, pairs) if p[i]) / (len(w) - total) for i in range(4)]
    return share, m, u


def test_learning_equals_a_loop_over_all_pairs():
    rows = people(2, 60, 20)
    counted = sorted(patterns_of(rows).items())
    start = matching.learn(counted, 4, rounds=0)
    model = matching.learn(counted, 4, rounds=15)
    share, m, u = slow_em(rows, start, 15)
    assert model.share == pytest.approx(share, rel=1e-6) and model.match == pytest.approx(tuple(m), rel=1e-6) and model.other == pytest.approx(tuple(u), rel=1e-6)


def test_learnt_weights_find_planted_duplicates_better_than_given_ones(spark):
    rows = people(3, 1500, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    true = {(r[0] - 10_000, r[0]) for r in rows if r[0] >= 10_000}

    def judged(entities):
        groups = {}
        for r in entities.collect():
            groups.setdefault(r.entity, []).append(r.id)
        joined = {p for g in groups.values() for p in combinations(sorted(g), 2)}
        return len(joined & true) / max(len(joined), 1), len(joined & true) / len(true)

    found, model = matching.match_learnt(df, "id", FIELDS)
    precision, recall = judged(found)
    assert precision > 0.95 and recall > 0.95
    given = judged(matching.match_entities(df, "id", {"name": 3, "town": 3, "born": 3, "phone": 3}, 6))
    assert min(given) < 0.5  # equal weights join everybody of one town and year
    assert model.other[1] > model.other[3] and model.share < 0.01


# --- private exports ------------------------------------------------------------------------------------------------------------------

def visits(seed=4):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), rng.choice("abcd"), rng.uniform(-5, 30)) for _ in range(500)]
    return rows + [(7, rng.choice("abcd"), 25.0) for _ in range(400)] + [(None, "a", 9.0)] * 5 + [(3, None, 2.0), (3, "a", None)]


def sums(df):
    return {r.g: (r.n, float(r.s or 0)) for r in df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}


def test_one_subject_moves_counts_and_sums_by_no_more_than_the_bound(spark):
    rows, bound, groups, each = visits(), 10.0, 2, 3
    df = spark.createDataFrame(rows, "who int, g string, v double")
    whole = sums(govern.bounded(df, "who", ["g"], "v", bound, groups, each, 5))
    for who in (7, 3, 11, 25):
        less = sums(govern.bounded(df.where(F.col("who") != who), "who", ["g"], "v", bound, groups, each, 5))
        moved = [(whole.get(g, (0, 0))[0] - less.get(g, (0, 0))[0], whole.get(g, (0, 0))[1] - less.get(g, (0, 0))[1]) for g in set(whole) | set(less)]
        assert 0 < sum(abs(n) for n, _ in moved) <= groups * each and sum(abs(s) for _, s in moved) <= groups * each * bound
        assert sum(n != 0 for n, _ in moved) <= groups


def test_noise_has_the_stated_scale_and_repeats(spark):
    df = spark.range(4000).selectExpr("id AS who", "id % 400 AS g", "1.0D AS v")
    out = govern.private_export(df, "who", ["g"], "v", eps=1.0, bound=1.0, min_n=-1e9, seed=1, max_groups=1, max_rows=3)
    again = govern.private_export(df.orderBy(F.desc("who")), "who", ["g"], "v", eps=1.0, bound=1.0, min_n=-1e9, seed=1, max_groups=1, max_rows=3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    off = [r.noisy_count - 10 for r in out.collect()]
    assert len(off) == 400 and 4 < sum(map(abs, off)) / 400 < 8  # mean of |Laplace| is its scale: 2 * 3 / 1


def test_the_threshold_is_on_the_noisy_count(spark):
    df = spark.range(4000).selectExpr("id AS who", "id % 400 AS g", "1.0D AS v")
    out = govern.private_export(df, "who", ["g"], "v", eps=1.0, bound=1.0, min_n=12, seed=1)
    n = out.count()
    assert 0 < n < 400 and out.agg(F.min("noisy_count")).first()[0] >= 12  # all groups hold ten


def test_ledger(spark, tmp_path):
    root = str(tmp_path)
    assert govern.spend(spark, root, "visits", "march", 0.4, 1.0) == pytest.approx(0.6)
    assert govern.spend(spark, root, "visits", "march", 0.4, 1.0) == pytest.approx(0.6)  # repeated
    assert govern.spend(spark, root, "visits", "april", 0.6, 1.0) == pytest.approx(0.0)
    with pytest.raises(ValueError):
        govern.spend(spark, root, "visits", "may", 0.1, 1.0)
    assert govern.spend(spark, root, "others", "may", 0.1, 1.0) == pytest.approx(0.9)
    with pytest.raises(ValueError):
        govern.spend(spark, root, "others", "june", 0.0, 1.0)


# --- chunk plans ----------------------------------------------------------------------------------------------------------------------

def plan_of(rows, size):
    rows = sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    return [(i // size, len(c), c[0], c[-1], i + len(c)) for i in range(0, len(rows), size) if (c := rows[i:i + size])]


@pytest.mark.parametrize("hot", [10**6, 5])
def test_chunk_plans_of_text_composite_null_and_skewed_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "B", "é", "hot", "hot", "hot"]), rng.choice([None, 1, 2, -3])) for _ in range(500)]
    df = spark.createDataFrame(rows, "t string, n int")
    got = sorted(map(tuple, readers.chunk_plan(df, "t", 64).select("chunk_id", "rows", "min_key", "max_key", "rows_done").collect()))
    assert got == [(a, b, c[0], d[0], e) for a, b, c, d, e in plan_of([(t,) for t, _ in rows], 64)]
    two = readers.chunk_plan(df, ["n", "t"], 64).select("chunk_id", "rows", "min_key", "max_key", "rows_done").collect()
    assert sorted((r[0], r[1], tuple(r[2]), tuple(r[3]), r[4]) for r in two) == plan_of([(n, t) for t, n in rows], 64)


def test_null_keys_are_planned(spark):
    df = spark.createDataFrame([(i,) for i in range(10)] + [(None,)] * 5, "k int")
    assert sorted(map(tuple, readers.chunk_plan(df, "k", 4).select("chunk_id", "rows", "min_key", "max_key").collect()), key=lambda r: r[0]) == [
        (0, 4, None, None), (1, 4, None, 2), (2, 4, 3, 6), (3, 3, 7, 9)]
    assert readers.chunk_plan(df.limit(0), "k", 4).count() == 0


def test_sampled_ranges_follow_each_other(spark):
    df = spark.range(5000).selectExpr("md5(CAST(id AS STRING)) AS k", "id % 3 AS n")
    lines = readers.sampled_ranges(df, ["k", "n"], 6).orderBy("range_id").collect()
    assert sum(r.rows for r in lines) == 5000 and max(r.rows for r in lines) < 2000
    assert all(a.max_k < b.min_k for a, b in zip(lines, lines[1:]))


# --- reach ----------------------------------------------------------------------------------------------------------------------------

def reach(edges, start):
    out, frontier = {n: 0 for n in start}, set(start)
    while frontier:
        new = {d for s, d in edges if s in frontier} - set(out)
        depth = max(out.values()) + 1
        out |= {n: depth for n in new}
        frontier = new
    return out


@pytest.mark.parametrize("condense_from", [0, 3])
def test_reach_through_chains_branches_and_rings(spark, condense_from):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 40)] + [(i, i + 1) for i in range(100, 130)] + [(130, 20), (5, 100), (40, 0), (200, 201), (201, 202), (202, 200), (40, 300), (300, 301)]
    edges += [(rng.randrange(400, 440), rng.randrange(400, 440)) for _ in range(60)] + [(10, 400), (300, 300)]
    for start in ([0, 202], [100, 35, 415], [999]):
        got = graph.impact(spark.createDataFrame(edges + edges[:5], "src int, dst int"), spark.createDataFrame([(s,) for s in start + start[:1]], "node int"), condense_from)
        rows = [tuple(r) for r in got.select("node", "depth").collect()]
        assert len(rows) == len(set(rows)) and dict(rows) == reach(edges, start), start


def test_a_chain_of_5000_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: rounds.append(1) or cut(df))
    n = 5000
    links = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    got = graph.impact(links, spark.createDataFrame([(0,)], "node long"), 3)
    line = got.agg(F.count("*"), F.max("depth"), F.sum(F.abs(F.col("node") - F.col("depth")))).first()
    assert tuple(line) == (n + 1, n, 0)
    assert len(rounds) <= 3 + math.ceil(math.log2(n)) + 8
