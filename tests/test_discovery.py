"""Inferred keys and mergeable profiles on small tables."""

import os
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from assay.operators import inclusion, profile, sketches


def brute_force(tables, t):
    cells = {}
    for name, (schema, rows) in tables.items():
        for i, part in enumerate(schema.split(", ")):
            c, kind = part.split()
            if kind in inclusion_kinds:
                cells[(name, c)] = (inclusion_kinds[kind], [r[i] for r in rows])
    out = []
    for a, b in permutations(cells, 2):
        (ka, va), (kb, vb) = cells[a], cells[b]
        mine, other = {v for v in va if v is not None}, {v for v in vb if v is not None}
        if ka == kb and mine and other and len(mine & other) >= t * len(mine):
            out.append((*a, *b, len(mine), len(mine & other), len(other), len(other) == len(vb)))
    return sorted(out)


inclusion_kinds = {"int": "i", "bigint": "i", "string": "s", "double": "n", "boolean": "b"}


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(1)
    long = "x" * 500
    return {
        "parent": ("p_id bigint, p_name string, p_value double", [(i, f"n{i}" if i else long, i / 4 if i % 5 else -0.0) for i in range(60)]),
        "child": ("c_id bigint, p_id int, c_name string, note string, flag boolean",
                  [(1000 + i, 7 if i % 3 == 0 else rng.randrange(60), long if i % 4 == 0 else f"n{i % 60}", None, i % 2 == 0) for i in range(300)]),
        "loose": ("c_id bigint, p_id bigint, v double", [(1000 + i, i if i < 95 else 5000 + i, 0.0) for i in range(100)]),
        "empty": ("c_id bigint, p_name string", []),
    }


def frames(spark, tables):
    return {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in tables.items()}


@pytest.mark.parametrize("t", [1.0, 0.55, 0.01])
@pytest.mark.parametrize("sample", [10**9, 40])
def test_inclusions_against_every_pair(spark, tables, t, sample):
    found = inclusion.inclusions(frames(spark, tables), t, sample)
    assert sorted(map(tuple, found.collect())) == brute_force(tables, t)


def test_inferred_keys_need_no_candidates(spark, tables):
    few = {n: df for n, df in frames(spark, tables).items() if n != "loose"}
    edges = inclusion.inferred_keys(inclusion.inclusions(few))
    named = {(r.child, r.child_column, r.parent, r.parent_column) for r in edges.collect()}
    assert named == {("child", "p_id", "parent", "p_id"), ("child", "c_name", "parent", "p_name")}
    many = inclusion.inferred_keys(inclusion.inclusions(frames(spark, tables)), same_name=False)
    assert named < {(r.child, r.child_column, r.parent, r.parent_column) for r in many.collect()}


def test_hopeless_columns_are_not_shuffled(spark, tables, monkeypatch):
    seen = []
    values = inclusion.Columns.values
    monkeypatch.setattr(inclusion.Columns, "values", lambda self, wanted, every=1: seen.append((len(wanted), every)) or values(self, wanted, every))
    far = {"a": spark.range(4000).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y")), "b": spark.range(10**9, 10**9 + 4000).select(F.col("id").alias("z"))}
    found = inclusion.inclusions(far, 1.0, 1000)
    assert found.count() == 0 and seen == [(3, 12)]  # the sample ruled out all pairs, so no column was read whole


def test_values_meet_as_bits_of_fixed_width(spark):
    """More columns than one whole number has bits; and no set is collected per value, which falls back to sorting all of them."""
    wide = spark.range(50).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(70)], *[(F.col("id") * 0.5 - 0.0 * i).alias(f"d{i}") for i in range(2)])
    found = {(r.child_column, r.parent_column) for r in inclusion.inclusions({"w": wide}, 0.98).collect()}
    assert found == {(f"c{a}", f"c{b}") for a in range(70) for b in range(70) if abs(a - b) == 1} | {("d0", "d1"), ("d1", "d0")}
    plan = []
    original = inclusion.cut
    inclusion.cut = lambda df: plan.append(df._jdf.queryExecution().executedPlan().toString()) or original(df)
    try:
        inclusion.inclusions({"w": wide})
    finally:
        inclusion.cut = original
    assert plan and not any("ObjectHashAggregate" in p for p in plan)


def test_nested_columns_are_left_out(spark):
    df = spark.createDataFrame([([1.0], "a")], "v array<float>, w string")
    assert inclusion.inclusions({"x": df, "y": df.select("w")}).count() == 2


def day(spark, d, n):
    rng = random.Random(d)
    return spark.createDataFrame([(f"2024-01-{d:02d}", i, None if i % 4 == 0 else rng.choice(["a", "b"]) if i % 3 else f"v{rng.random()}",
                                   round(rng.gauss(0, 50), 2), [float(i)]) for i in range(n)], "day string, id bigint, word string, amount double, v array<float>")


def test_merged_parts_equal_the_whole(spark):
    days = [day(spark, d, 200 + 40 * d) for d in range(1, 8)]
    whole = days[0]
    for d in days[1:]:
        whole = whole.unionByName(d)
    parts = sketches.parts_profile(whole, F.col("day"), scale=2)
    a = {r.column_name: r for r in sketches.report(sketches.merged(parts)).collect()}
    one = {r.column_name: r for r in sketches.report(sketches.parts_profile(whole, F.lit("all"), scale=2)).collect()}
    exact = {r.column_name: r for r in profile.profile_exact(whole.drop("v")).collect()}
    numeric = {r.column_name: r for r in profile.numeric_profile(whole, ["amount", "id"], scale=2).collect()}
    assert set(a) == {"day", "id", "word", "amount", "v"}
    for c, r in a.items():
        assert (r.rows, r.filled, r.mean, r.stddev, r.lo_number, r.hi_number, r.lo_text, r.hi_text) == (
            one[c].rows, one[c].filled, one[c].mean, one[c].stddev, one[c].lo_number, one[c].hi_number, one[c].lo_text, one[c].hi_text)
        if c in exact:
            assert abs(r.distinct_count - exact[c].distinct_count) <= max(2, 0.033 * exact[c].distinct_count)
            assert r.rows - r.filled == exact[c].nulls
    assert a["word"].top_values[0].item == exact["word"].top_value and abs(a["word"].top_values[0]["count"] - exact["word"].top_rows) <= a["word"].rows / 700
    assert abs(a["amount"].mean - numeric["amount"].mean) < 1e-9 and abs(a["amount"].stddev - numeric["amount"].stddev) < 1e-6
    values = sorted(r.amount for r in whole.select("amount").collect())
    assert abs(values.index(a["amount"].quantiles[1]) / len(values) - 0.5) < 0.02


def test_a_new_day_reads_one_day(spark, tmp_path):
    root = str(tmp_path)
    assert sketches.stored_parts(spark, root, "t") is None
    first = day(spark, 1, 50).unionByName(day(spark, 2, 60))
    assert sketches.store_parts(first, root, "t", F.col("day")) == 2
    files = {p: os.stat(p).st_mtime_ns for p, in ((os.path.join(d, f),) for d, _, fs in os.walk(root) for f in fs)}
    assert sketches.store_parts(first.unionByName(day(spark, 3, 70)), root, "t", F.col("day")) == 1
    assert sketches.store_parts(first.unionByName(day(spark, 3, 70)), root, "t", F.col("day")) == 0
    assert all(os.stat(p).st_mtime_ns == t for p, t in files.items())
    lines = sketches.stored_parts(spark, root, "t")
    assert {(r.part, r.rows) for r in lines.where("column_name = 'id'").collect()} == {("2024-01-01", 50), ("2024-01-02", 60), ("2024-01-03", 70)}
    assert sketches.report(sketches.merged(sketches.stored_parts(spark, root, "t", lambda p: p >= "2024-01-02"))).where("column_name = 'id'").first().rows == 130


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a double, b string")
    for r in sketches.report(sketches.merged(sketches.parts_profile(df, F.lit("x")))).collect():
        assert (r.rows, r.filled, r.null_pct, r.distinct_count, r.mean, r.quantiles, r.top_values) == (2, 0, 100.0, 0, None, None, [])
    assert sketches.merged(sketches.parts_profile(df.limit(0), F.lit("x"))).count() == 0


def test_fine_values_keep_their_digits(spark):
    df = spark.createDataFrame([(0.00002,), (0.00004,), (0.00001,)], "v double")
    r = profile.numeric_profile(df, ["v"], scale=6).first()
    assert r.mean == pytest.approx(7e-5 / 3) and r.stddev == pytest.approx(1.2472e-5, rel=1e-3)
