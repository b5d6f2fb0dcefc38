"""Incremental layers: equal to one full run; untouched partitions keep their files, also when a run breaks off."""

import os
import random

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from assay.operators import rules as R
from assay.plans import increment

SCHEMA = "k bigint, seq int, grp string, v decimal(10,2), gone boolean, _load_ts int"


@pytest.fixture(autouse=True)
def target(spark):
    global TARGET
    TARGET = increment.Target("t", ["k"], ["seq"], F.floor(F.col("k") / 10), rules=[R.Row("positive", F.col("v") > 0)], deleted=F.col("gone"),
                              groups=["grp"], measures={"total": F.col("v"), "seqs": F.col("seq")})


SILVER, TOTALS = "k bigint, seq int, grp string, v decimal(10,2), gone boolean", "grp string, rows bigint, total decimal(38,2), seqs bigint"


def brute_force(rows):
    last = {}
    for r in rows:
        if r[0] not in last or r[1] > last[r[0]][1]:
            last[r[0]] = r
    alive = [r for r in last.values() if not r[4]]
    gold = [r for r in alive if r[3] is not None and r[3] > 0]
    totals = {}
    for r in gold:
        n, v, s = totals.get(r[2], (0, 0, 0))
        totals[r[2]] = (n + 1, v + r[3], s + r[1])
    key = lambda x: (x is not None, x)
    return (sorted((r[:5] for r in last.values()), key=lambda r: key(r[0])), sorted((r[0] for r in gold), key=key),
            sorted((r[0] for r in alive if r not in gold), key=key), {g: v for g, v in totals.items()})


def state(spark, root):
    read = lambda layer, schema: increment.read(spark, root, TARGET, layer, schema).collect()
    key = lambda x: (x is not None, x)
    totals = read("totals", TOTALS)
    assert len(totals) == len({r.grp for r in totals})
    return (sorted((tuple(r) for r in read("silver", SILVER)), key=lambda r: key(r[0])), sorted((r.k for r in read("gold", SILVER)), key=key),
            sorted((r.k for r in read("quarantine", SILVER)), key=key), {r.grp: (r.rows, r.total, r.seqs) for r in totals})


def batch(seed, load, n):
    from decimal import Decimal
    rng = random.Random(seed)
    keys = rng.sample(range(120), n)
    return [(None if rng.random() < 0.02 else k, rng.randrange(load * 3) * 1000 + k * 7 + load, rng.choice(["a", "b", None]),
             None if rng.random() < 0.1 else Decimal(rng.randrange(-200, 900)) / 100, rng.random() < 0.1, load) for k in keys]


@pytest.fixture
def loads():
    out = [batch(i, i, 70) for i in range(1, 5)]
    seen = set()
    for rows in out:  # one null key a load, so that no two rows are equal in the order
        rows[:] = [r for r in rows if r[0] is not None or (r[1] not in seen and not seen.add(r[1]))]
    return out


def test_batches_equal_one_run_over_everything(spark, tmp_path, loads):
    root, so_far = str(tmp_path / "a"), []
    for load in loads:
        so_far += load
        increment.advance(spark, root, TARGET, spark.createDataFrame(so_far, SCHEMA))
        assert state(spark, root) == brute_force(so_far)
    whole = str(tmp_path / "b")
    increment.advance(spark, whole, TARGET, spark.createDataFrame(so_far, SCHEMA))
    assert state(spark, whole) == state(spark, root)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path, loads):
    root = str(tmp_path)
    increment.advance(spark, root, TARGET, spark.createDataFrame(loads[0], SCHEMA))
    before = files(root)
    one = [(33, 99_999, "z", None, False, 9), (38, 99_999, "z", 5, False, 9)]
    from decimal import Decimal
    one = [(k, s, g, None if v is None else Decimal(v), d, a) for k, s, g, v, d, a in one]
    out = increment.advance(spark, root, TARGET, spark.createDataFrame(loads[0] + one, SCHEMA))
    assert out["touched"] == ["3"] and out["new_rows"] == 2 and out["version"] == 2
    after = files(root)
    assert {p: t for p, t in after.items() if p in before} == before
    assert {p.split("part=")[1].split("/")[0] for p in set(after) - set(before) if "/silver/" in p} == {"3"}
    assert state(spark, root) == brute_force(loads[0] + one)


def test_a_broken_run_changes_nothing_that_is_read_and_can_be_repeated(spark, tmp_path, loads, monkeypatch):
    root = str(tmp_path)
    increment.advance(spark, root, TARGET, spark.createDataFrame(loads[0], SCHEMA))
    before, stood = files(root), state(spark, root)
    both = spark.createDataFrame(loads[0] + loads[1], SCHEMA)

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(increment, "commit", broken)
        with pytest.raises(RuntimeError):
            increment.advance(spark, root, TARGET, both)
    assert state(spark, root) == stood
    assert {p: t for p, t in files(root).items() if p in before} == before
    assert increment.advance(spark, root, TARGET, both)["version"] == 2
    assert state(spark, root) == brute_force(loads[0] + loads[1])


def test_nothing_new_commits_nothing(spark, tmp_path, loads):
    root = str(tmp_path)
    rows = spark.createDataFrame(loads[0], SCHEMA)
    increment.advance(spark, root, TARGET, rows)
    before = files(root)
    assert increment.advance(spark, root, TARGET, rows)["new_rows"] == 0 and files(root) == before
    assert increment.advance(spark, str(tmp_path / "none"), TARGET, rows.limit(0))["version"] == 0
    assert increment.read(spark, str(tmp_path / "none"), TARGET, "gold", SILVER).count() == 0


def test_many_partitions_share_folders_and_stand_alone_in_later_runs(spark, tmp_path):
    from decimal import Decimal
    root = str(tmp_path)
    row = lambda k, s, load: (k, s, "abc"[k % 3], Decimal((k + s) % 7 - 1), (k + s) % 11 == 0, load)
    folders = lambda layer, version: {p.split("part=")[1].split("/")[0] for p in files(f"{root}/{layer}/t/version={version}")}
    rows = [row(k, 1, 1) for k in range(0, 8000, 5)] + [(None, 1, "a", Decimal(1), False, 1)]
    out = increment.advance(spark, root, TARGET, spark.createDataFrame(rows, SCHEMA))
    assert len(out["touched"]) == 801 and state(spark, root) == brute_force(rows)
    assert all(len(folders(layer, 1)) <= 128 for layer in ("silver", "gold", "quarantine"))
    before = files(root)
    rows += [row(k, 2, 2) for k in (30, 31, 38, 7995)]  # two partitions are rewritten, their neighbours in the old folders stand
    assert increment.advance(spark, root, TARGET, spark.createDataFrame(rows, SCHEMA))["touched"] == ["3", "799"]
    assert folders("silver", 2) == {"3", "799"} and {p: t for p, t in files(root).items() if p in before} == before
    assert state(spark, root) == brute_force(rows)
    rows += [row(k, 3, 3) for k in range(0, 4000, 10)]
    increment.advance(spark, root, TARGET, spark.createDataFrame(rows, SCHEMA))
    assert len(folders("silver", 3)) <= 128 and state(spark, root) == brute_force(rows)
    rows += [row(k, 4, 4) for k in range(100, 900, 10)]
    increment.advance(spark, root, TARGET, spark.createDataFrame(rows, SCHEMA))
    assert state(spark, root) == brute_force(rows)


def test_gold_and_quarantine_are_filtered_from_silver_without_a_shuffle(spark, tmp_path, monkeypatch):
    from decimal import Decimal
    rows = [(k, 1, "abc"[k % 3], Decimal(k % 7 - 1), k % 11 == 0, 1) for k in range(0, 8000, 5)]
    plans, write = {}, DataFrameWriter.parquet

    def seen(self, path, *args, **options):
        plans.setdefault(path.removeprefix(f"{tmp_path}/").split("/")[1], []).append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    for name, some in (("many", rows), ("few", rows[:200])):  # partitions that share folders, and that have their own
        root = str(tmp_path / name)
        increment.advance(spark, root, TARGET, spark.createDataFrame(some, SCHEMA))
        assert state(spark, root) == brute_force(some)
    assert len(plans["gold"]) == len(plans["quarantine"]) == 2
    assert not any("shuffle" in p or "Exchange" in p for p in plans["gold"] + plans["quarantine"])


def test_a_sign_makes_no_measure_wider(spark):
    df = spark.createDataFrame([(1, 1, "a", None, False, 1)], SCHEMA)
    plain = dict(df.select(*[F.coalesce(m, F.lit(0)).alias(n) for n, m in TARGET.measures.items()]).dtypes)
    for sign in (1, -1):
        assert dict(increment._sums(TARGET, df, sign).dtypes) == {"grp": "string", "rows": "bigint", **plain}
