"""The split forms must equal the plain windows, also when one key holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from assay.operators import clean, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 31 == 0 else f"k{rnd.randrange(40)}")
        rows.append((i, key, rnd.randrange(200), rnd.choice("ABC"), rnd.randrange(50)))
    return spark.createDataFrame(rows, "id long, key string, t long, status string, v long").cache()


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    x, y = [sorted(map(tuple, d.select(*cols).collect()), key=repr) for d in (a, b)]
    assert x == y


@pytest.mark.parametrize("hot_rows", [7, 20, 100, 10_000])
@pytest.mark.parametrize("following", [False, True])
def test_neighbour_equals_window(skewed, hot_rows, following):
    got = ordered.neighbour(skewed, ["key"], ["t", "id"], {"a": ("v", 1), "b": ("status", 3)}, following, hot_rows=hot_rows)
    order = [F.col(c).desc() if following else F.col(c).asc() for c in ("t", "id")]
    w = W.partitionBy("key").orderBy(*order)
    same(got, skewed.withColumn("a", F.lag("v", 1).over(w)).withColumn("b", F.lag("status", 3).over(w)))


@pytest.mark.parametrize("hot_rows", [7, 50, 10_000])
def test_running_and_position_equal_window(skewed, hot_rows):
    got = ordered.running(skewed, ["key"], ["t", "id"], {"s": F.col("v")}, hot_rows=hot_rows)
    got = ordered.position(got, ["key"], ["t", "id"], hot_rows=hot_rows)
    w = W.partitionBy("key").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    same(got, skewed.withColumn("s", F.sum("v").over(w)).withColumn("position", F.count(F.lit(1)).over(w)))


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp"])
def test_order_columns_of_any_type(skewed, kind):
    cast = {"string": F.date_add(F.lit("1999-12-01"), F.col("t").cast("int")).cast("string"), "double": (F.col("t") - 100.5) * 3,
            "date": F.date_add(F.lit("1969-12-01"), F.col("t").cast("int")), "timestamp": F.timestamp_seconds(F.col("t") * 977)}[kind]
    df = skewed.withColumn("o", F.when(F.col("id") % 17 != 0, cast))
    got = ordered.neighbour(df, ["key"], ["o", "id"], {"a": ("v", 2)}, hot_rows=11)
    same(got, df.withColumn("a", F.lag("v", 2).over(W.partitionBy("key").orderBy("o", "id"))))


def spans(df, keys, order, hot):
    return {r[0]: r[1] for r in ordered.spanned(df, keys, order, hot).where("key = 'hot'").groupBy(ordered.SPAN).count().collect()}


def test_hot_key_is_found_and_split(skewed):
    hot = ordered.hot_keys(skewed, ["key"], ["t", "id"], 100)
    assert [r["key"] for r in hot.keys.collect()] == ["hot"] and hot.rows == 300
    sizes = spans(skewed, ["key"], ["t", "id"], hot)
    assert len(sizes) == 3 and all(n < 200 for n in sizes.values())
    assert ordered.hot_keys(skewed, ["key"], ["t", "id"], 1000) is None


def shaped(df, shape):
    """All rows of the key at one moment, crowded beside an outlier, fractional, exponential, or alike in their first bytes."""
    t = F.col("t")
    if shape == "outlier":
        return df.withColumn("t", F.when(F.col("id") == 0, F.lit(10**12)).otherwise(t))
    if shape == "tied":
        return df.withColumn("t", F.lit(7))
    if shape == "tied_null":
        return df.withColumn("t", F.lit(None).cast("long"))
    if shape == "two_values":
        return df.withColumn("t", F.when(F.col("id") % 2 == 0, 3))
    if shape == "fractional":
        return df.withColumn("t", t / 100_000.0)
    if shape == "exponential":
        return df.withColumn("t", F.exp(t / 4.0))
    return df.withColumn("t", F.format_string("Customer#00000000000000%09d", t))


@pytest.mark.parametrize("shape", ["outlier", "tied", "tied_null", "two_values", "fractional", "exponential", "prefixed", "third"])
def test_spans_are_even_whatever_the_order_columns(skewed, shape):
    order = ["one", "two", "id"] if shape == "third" else ["t", "id"]
    df = (skewed.withColumns({"one": F.lit(1), "two": F.lit("x")}) if shape == "third" else shaped(skewed, shape)).cache()
    hot = ordered.hot_keys(df, ["key"], order, 20)
    sizes = spans(df, ["key"], order, hot)
    assert sum(sizes.values()) == 300 and max(sizes.values()) <= 80
    w = W.partitionBy("key").orderBy(*order)
    same(ordered.neighbour(df, ["key"], order, {"a": ("v", 2)}, hot=hot), df.withColumn("a", F.lag("v", 2).over(w)))
    back = W.partitionBy("key").orderBy(*[F.col(c).desc() for c in order])
    same(ordered.neighbour(df, ["key"], order, {"a": ("v", 1)}, following=True, hot=hot), df.withColumn("a", F.lag("v", 1).over(back)))
    same(ordered.running(df, ["key"], order, {"s": F.col("v")}, hot=hot),
         df.withColumn("s", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))))


def test_no_hot_key_stays_whole(skewed):
    """However many keys lie above the limit, each is split."""
    hot = ordered.hot_keys(skewed, ["key"], ["t", "id"], 5)
    assert hot.keys.count() > 20
    largest = ordered.spanned(skewed, ["key"], ["t", "id"], hot).groupBy("key", ordered.SPAN).count().agg(F.max("count")).first()[0]
    assert largest <= 20


def test_key_lists_are_broadcast_by_their_bytes(spark):
    small = spark.range(1000).select(F.col("id"), F.repeat(F.lit("x"), 100).alias("wide"))
    plan = lambda limit: spark.range(10).join(ordered.sized(small, limit), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(200_000) and "strategy=broadcast" not in plan(100_000)


@pytest.mark.parametrize("hot_rows", [40, 10_000])
def test_rolling_equals_range_window(spark, skewed, hot_rows):
    df = skewed.where("key IS NOT NULL").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600)).withColumn("v", F.when(F.col("t") % 60 < 50, F.col("v")))
    got = ordered.rolling(df, ["key"], "ts", {"n": F.lit(1).cast("long"), "s": F.col("v")}, {"a": 5 * 3600, "b": 60 * 3600}, "second", hot_rows=hot_rows)
    ticks = df.groupBy("key", F.unix_seconds("ts").alias("tick")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    w = W.partitionBy("key").orderBy("tick")
    want = ticks
    for label, length in (("a", 5 * 3600), ("b", 60 * 3600)):
        for m in ("n", "s"):
            want = want.withColumn(f"{m}_{label}", F.sum(m).over(w.rangeBetween(-(length - 1), 0)))
    same(got, want)


def test_first_rows_prunes_before_the_shuffle(skewed):
    plan = ordered.first_rows(skewed, ["key"], ["t", "id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("n", [1, 10, 777, 5000])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    values = [round(rnd.gauss(0, 100), 1) for _ in range(n)] + [3.0] * (n // 3)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["name"]: r["value"] for r in ordered.exact_quantiles(df, "v", probs, accuracy=100).collect()}
    import math
    ranked = sorted(values)
    assert got == {k: ranked[max(math.ceil(p * len(ranked)), 1) - 1] for k, p in probs.items()}


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_scd2_history_on_hot_key(skewed, hot_rows):
    got = clean.scd2_history(skewed.where("key IS NOT NULL"), "key", "t", ["status"], ["id"], hot_rows=hot_rows).collect()
    rows = sorted(((r["key"], r["t"], r["id"], r["status"]) for r in skewed.where("key IS NOT NULL").collect()))
    opened, last = [], {}
    for key, t, i, status in rows:
        if last.get(key) != status:
            opened.append((key, t, i, status))
        last[key] = status
    ends = {}
    for a, b in zip(opened, opened[1:]):
        if a[0] == b[0]:
            ends[a[2]] = b[1]
    assert {(r["key"], r["valid_from"], r["id"], r["status"], r["valid_to"]) for r in got} == \
        {(k, t, i, s, ends.get(i)) for k, t, i, s in opened}
    assert sum(r["is_current"] for r in got) == len(last)


def test_prefix_sums(spark):
    df = spark.range(500).select((F.col("id") * 3).alias("i"), (F.col("id") % 7).alias("v"))
    got = {r["i"]: r["s"] for r in ordered.prefix_sums(df, "i", "v", "s", block=50).collect()}
    total, want = 0, {}
    for i in range(500):
        want[3 * i] = total
        total += i % 7
    assert got == want
