"""As-of, interval and box joins and changes by digest, against brute force."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.operators import digests, govern, meets

RNG = random.Random(11)
FACTS = [(i, RNG.choice([1, 1, 1, 2, 3, None]), RNG.choice([None] + list(range(0, 60)))) for i in range(300)]
VALUES = [(RNG.choice([1, 1, 2, 9, None]), RNG.choice([None] + list(range(5, 50))), RNG.randrange(5), RNG.choice(["x", "y", None])) for _ in range(120)]


def last_before(key, at):
    known = [v for v in VALUES if key is not None and at is not None and v[0] == key and v[1] is not None and v[1] <= at]
    return max(known, key=lambda v: (v[1], (v[2] is not None, v[2]), (v[3] is not None, v[3] or "")))[2:] if known else (None, None)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_as_of(spark, hot_rows):
    facts = spark.createDataFrame(FACTS, "id int, k int, at int")
    values = spark.createDataFrame(VALUES, "k int, since int, a int, b string")
    out = meets.as_of(facts, values, ["k"], "at", "since", ["a", "b"], hot_rows)
    assert out.columns == ["id", "k", "at", "a", "b"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, k, at, *last_before(k, at)) for i, k, at in FACTS), key=repr)


def test_as_of_without_values_or_facts(spark):
    facts, values = spark.createDataFrame(FACTS, "id int, k int, at int"), spark.createDataFrame(VALUES, "k int, since int, a int, b string")
    assert meets.as_of(facts, values.limit(0), ["k"], "at", "since", ["a"]).where("a IS NOT NULL").count() == 0
    assert meets.as_of(facts.limit(0), values, ["k"], "at", "since", ["a"]).count() == 0


SPANS = [(RNG.choice([1, 1, 2, None]), RNG.choice([None] + list(range(40))), RNG.choice([None] + list(range(50)))) for _ in range(150)]


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_open_at(spark, hot_rows):
    points = spark.createDataFrame(FACTS + FACTS[:9], "id int, k int, at int")
    spans = spark.createDataFrame(SPANS, "k int, s int, e int")
    out = meets.open_at(points, spans, ["k"], "at", "s", "e", hot_rows=hot_rows)
    want = [(i, k, at, sum(1 for x, s, e in SPANS if k is not None and at is not None and x == k and s is not None and s <= at and (e is None or (e >= at and e >= s))))
            for i, k, at in FACTS + FACTS[:9]]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_one_consumer_with_a_long_history_is_linear(spark):
    """100,000 agreements of one consumer and 100,000 dates: pair by pair this would be ten thousand million comparisons."""
    n = 100_000
    spans = spark.range(n).selectExpr("7 AS k", "id * 3 AS s", "id * 3 + 10 AS e")
    points = spark.range(n).selectExpr("7 AS k", "id * 3 + 1 AS at")
    begin = time.time()
    got = {r.n_open: r.n for r in meets.open_at(points, spans, ["k"], "at", "s", "e", hot_rows=20_000).groupBy("n_open").agg(F.count("*").alias("n")).collect()}
    assert time.time() - begin < 60
    assert got == {1: 1, 2: 1, 3: 1, 4: n - 3}


def test_consumers_without_agreement(spark):
    consumers = spark.createDataFrame([("a", "2024-02-01"), ("b", "2024-02-01"), (None, "2024-02-01"), ("a", None), ("c", "2024-06-30"), ("d", "2024-02-01")], "c string, d string")
    deals = spark.createDataFrame([("a", "2024-01-01", None), ("b", "2024-02-02", None), ("c", "2024-01-01", "2024-06-30"), ("d", "2024-03-01", "2024-01-01")],
                                  "c string, f string, t string").select("c", F.col("f").cast("date").alias("valid_from"), F.col("t").cast("date").alias("valid_to"))
    out = govern.consumers_without(consumers, deals, "c", F.col("d").cast("date"))
    assert out.columns == consumers.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("b", "2024-02-01"), (None, "2024-02-01"), ("a", None), ("d", "2024-02-01")], key=repr)


def boxes():
    rng = random.Random(2)
    out = [("all", float("-inf"), float("-inf"), float("inf"), float("inf")), ("left", float("-inf"), 0.0, 0.0, 5.0), ("dot", 3.0, 3.0, 3.0, 3.0), ("none", 5.0, 5.0, 4.0, 9.0),
           ("null", None, 0.0, 1.0, 1.0), ("nan", float("nan"), 0.0, 1.0, 1.0), ("tiny", 1e-9, 1e-9, 2e-9, 2e-9), ("wide", -1e6, -1.0, 1e6, 1.0)]
    for i in range(60):
        x, y = rng.randrange(-20, 20), rng.randrange(-20, 20)
        out.append((f"b{i}", float(x), float(y), x + rng.choice([0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 17.0, 40.0]), y + rng.choice([0.0, 1.0, 3.0, 8.0, 16.5])))
    return out


def points():
    rng = random.Random(3)
    out = [(0, None, 1.0), (1, float("nan"), 1.0), (2, 3.0, 3.0), (3, 1.5e-9, 1e-9), (4, 1e300, -1e300), (5, -0.0, 0.0)]
    return out + [(i, rng.choice([rng.randrange(-25, 25), rng.uniform(-25, 25)]) * 1.0, rng.randrange(-25, 25) * 1.0) for i in range(6, 300)]


def test_points_in_boxes(spark):
    p, b = spark.createDataFrame(points(), "id int, x double, y double"), spark.createDataFrame(boxes(), "name string, lo_x double, lo_y double, hi_x double, hi_y double")
    found = meets.in_boxes(p, b, "x", "y")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(i, n) for i, x, y in points() if x is not None and x == x for n, a, c, d, e in boxes() if a is not None and a == a and a <= x <= d and c <= y <= e}
    got = [(r.id, r.name) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    areas = {r.id: r.area for r in meets.area_of(p, "id", b, "x", "y", "name").collect()}
    size = {n: (d - a) * (e - c) for n, a, c, d, e in boxes() if a is not None}
    assert areas == {i: min(((size[n], n) for j, n in want if j == i), default=(0, "UNMAPPED"))[1] for i, _, _ in points()}


def test_box_and_point_tables_may_be_empty(spark):
    p, b = spark.createDataFrame(points(), "id int, x double, y double"), spark.createDataFrame(boxes(), "name string, lo_x double, lo_y double, hi_x double, hi_y double")
    assert meets.in_boxes(p.limit(0), b, "x", "y").count() == 0
    assert meets.in_boxes(p, b.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("few, block", [(1, 5), (7, 40)])
def test_crowded_cells_are_split_and_dealt_out(spark, few, block):
    p, b = spark.createDataFrame(points(), "id int, x double, y double"), spark.createDataFrame(boxes(), "name string, lo_x double, lo_y double, hi_x double, hi_y double")
    want = {(i, n) for i, x, y in points() if x is not None and x == x for n, a, c, d, e in boxes() if a is not None and a == a and a <= x <= d and c <= y <= e}
    got = [(r.id, r.name) for r in meets.in_boxes(p, b, "x", "y", block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    size = {n: (d - a) * (e - c) for n, a, c, d, e in boxes() if a is not None}
    areas = {r.id: r.area for r in meets.area_of(p, "id", b, "x", "y", "name", few=few).collect()}
    assert areas == {i: min(((size[n], n) for j, n in want if j == i), default=(0, "UNMAPPED"))[1] for i, _, _ in points()}


def sent(df):
    """Rows that pass through the exchanges of a query that is run once."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()

    def rows(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return rows(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(rows(node.children().apply(i)) for i in range(node.children().size()))

    return rows(plan)


def test_a_point_is_sent_once_however_many_shapes_boxes_have(spark):
    """Boxes of 49 shapes: points were sent once for every shape."""
    rng = random.Random(9)
    place = lambda: rng.choice([rng.uniform(-60, 60), rng.randrange(-60, 60) * 1.0])
    spots = [(i, place(), place()) for i in range(3000)] + [(3000 + i, v, w) for i, (v, w) in enumerate([(float("inf"), 0.0), (0.0, float("-inf")), (-0.0, 0.0), (0.0, -0.0)])] * 2
    areas = [(f"a{i}", x, y, x + 2.0 ** (i % 7) - 1, y + 2.0 ** (i // 7 % 7) - 1) for i, x, y in ((i, place(), place()) for i in range(490))]
    areas += [("edge", 0.0, float("-inf"), float("inf"), 0.0), ("spot", 0.0, 0.0, -0.0, -0.0)] * 2
    p, b = spark.createDataFrame(spots, "id int, x double, y double"), spark.createDataFrame(areas, "name string, lo_x double, lo_y double, hi_x double, hi_y double")
    want = Counter((i, n) for i, x, y in spots for n, c, d, e, f in areas if c <= x <= e and d <= y <= f)
    for block in (100, 1000):
        found = meets.in_boxes(p, b, "x", "y", block=block)
        assert found.columns == p.columns + b.columns
        assert Counter((r.id, r.name) for r in found.select("id", "name").collect()) == want
    assert sent(meets.in_boxes(p, b, "x", "y")) < 4 * (len(spots) + len(areas))


def test_the_smallest_of_many_nested_boxes(spark):
    """100,000 points by 100,000 boxes around the same centre: ten thousand million pairs, were they compared."""
    p = spark.range(100_000).select("id", (F.col("id") - 50_000).cast("double").alias("x"), F.lit(0.0).alias("y"))
    b = spark.range(1, 100_001).select(F.col("id").cast("string").alias("name"), (-F.col("id")).alias("lo_x"), F.lit(-1).alias("lo_y"), F.col("id").alias("hi_x"), F.lit(1).alias("hi_y"))
    out = meets.area_of(p, "id", b, "x", "y", "name")
    assert out.where(F.col("area") != F.greatest(F.abs("x"), F.lit(1)).cast("long").cast("string")).isEmpty() and out.count() == 100_000


# --- changes --------------------------------------------------------------------------------------------------------------------------

def versions():
    rng = random.Random(5)
    old = [(i if i % 17 else None, rng.choice(["a", "b", None]), rng.randrange(3)) for i in range(400)] + [(5, "r", 1)] * 3 + [(None, None, None)] * 2
    new = [r for i, r in enumerate(old) if i % 29] + [(9000 + i, "n", i) for i in range(4)] + [(5, "r", 1)] * 2
    new = [(k, "changed" if k is not None and k % 41 == 0 else a, b) for k, a, b in new]
    rng.shuffle(new)
    return old, new


def brute_force(old, new):
    gone, came = Counter(old) - Counter(new), Counter(new) - Counter(old)
    out = Counter()
    for k in {r[0] for r in [*gone, *came]}:
        g, c = [r for r in gone.elements() if r[0] == k], [r for r in came.elements() if r[0] == k]
        pairs = [("update", g[0], c[0])] if len(g) == len(c) == 1 else [("delete", r, (None,) * 3) for r in g] + [("insert", (None,) * 3, r) for r in c]
        for change, o, n in pairs:
            out.update((k, change, f, None if o[i] is None else str(o[i]), None if n[i] is None else str(n[i])) for i, f in ((1, "a"), (2, "b")) if o[i] != n[i])
    return out


@pytest.mark.parametrize("by_digest", [False, True])
@pytest.mark.parametrize("bits", [3, 8, 16])
def test_change_log_with_null_and_repeated_keys(spark, by_digest, bits):
    old, new = versions()
    frames = [spark.createDataFrame(v, "k int, a string, b int") for v in (old, new)]
    options = {"bits": bits} if by_digest else {}
    log = govern.change_log(*frames, "k", ["a", "b"], "me", "now", by_digest, **options)
    assert Counter((r.k, r.change, r.field, r.old_value, r.new_value) for r in log.collect()) == brute_force(old, new)


def test_an_unchanged_row_with_a_null_key_is_no_change(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y")], "k int, a string")
    assert govern.change_log(df, df, "k", ["a"], "me", "now").count() == 0


def test_only_rows_of_differing_ranges_are_compared(spark, monkeypatch):
    old = spark.range(20_000).withColumn("v", F.col("id") % 7)
    new = old.withColumn("v", F.when(F.col("id").isin(5, 777, 19_000), -1).otherwise(F.col("v")))
    before, after = digests.digests(old, ["id"], ["v"], 12), digests.digests(new, ["id"], ["v"], 12)
    ranges = digests.differing(before, after, 12)
    assert ranges.count() == 3
    assert digests.differing(before, before, 12).count() == 0
    read = []
    monkeypatch.setattr(digests, "row_changes", lambda o, n, *a: read.append(o.count() + n.count()) or row_changes(o, n, *a))
    out = digests.changed_rows(old, new, ["id"], ["v"], before, after, 12)
    assert {r.id for r in out.collect()} == {5, 777, 19_000}
    assert read[0] <= 2 * 3 * 20  # some five rows a range of either version, not 40,000


row_changes = digests.row_changes


def test_digests_add_up_and_do_not_depend_on_order(spark):
    df = spark.range(3000).withColumn("v", F.md5(F.col("id").cast("string")))
    whole = digests.digests(df, ["id"], ["v"], 6)
    parts = digests.digests(df.where("id < 1000"), ["id"], ["v"], 6).unionByName(digests.digests(df.where("id >= 1000").orderBy(F.desc("id")), ["id"], ["v"], 6))
    added = parts.groupBy("range").agg(*[F.sum(c).alias(c) for c in digests.SUMS])
    assert sorted(map(tuple, whole.select("range", *digests.SUMS).collect())) == sorted(map(tuple, added.select("range", *digests.SUMS).collect()))
