import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from assay.llm import winnowing
from tests.llm import data

ITEMS = "item_id bigint, text string, w string, mark string, h string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def expected(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - span + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[s:s + span]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[s:s + size]))):
                    hit.update(range(s, s + size))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t) + ("clash",) * 3 for i, t in items], ITEMS)
    out = winnowing.contaminated(docs, frame, **options)
    return sorted(map(tuple, out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def benchmark(short=True):
    base = data.text(1, 150).split()
    out = [(1, " ".join(base[5:40])), (2, " ".join(base[30:41])), (10, " ".join(base[50:60])), (3, data.text(500, 40)), (3, " ".join(base[100:120])),
           (4, "x " * 30), (5, None), (6, "..."), (None, " ".join(base[70:85])), (7, data.text(6, 30_000)[200:900])]
    return out + [(8, "two Words"), (9, " ".join(base[90:96])), (11, "中文")] * short


@pytest.mark.parametrize("short", [True, False])
def test_against_brute_force(spark, short):
    rows = [r[:2] for r in data.rows()]
    out = run(spark, data.frame(spark), benchmark(short))
    assert out == expected(rows, benchmark(short))
    assert sum(r[-1] for r in out) > 10 and not all(r[-1] for r in out)


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "SMALL", 0)
    assert run(spark, data.frame(spark), benchmark()) == expected([r[:2] for r in data.rows()], benchmark())


def test_every_shared_span_is_found_wherever_it_stands(spark):
    """Random texts of few words, where equal hashes within a run are common, and spans at all places."""
    rng = random.Random(4)
    letters = ["a", "B", "é", "d7"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(8, 30)))) for i in range(12)]
    docs = [(i, (",  ".join(rng.choice(letters) for _ in range(rng.randrange(0, 400))))) for i in range(60)]
    docs += [(100 + j, data.text(j, j) + " " + words(items[j % 12][1])[0] + " " + items[j % 12][1].upper().replace("É", "é") + "!") for j in range(24)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert run(spark, frame, items) == expected(docs, items)


def test_fewer_fingerprints_than_grams(spark):
    n = spark.createDataFrame([(data.text(9, 5000),)], "t string").select(F.size(winnowing.fingerprints(winnowing.words(F.col("t")))).alias("n")).first().n
    assert 0.2 * 5000 < n < 0.4 * 5000  # 2 / 7 expected


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, data.text(2, 90))], "item_id bigint, text string")
    plan = winnowing.contaminated(data.frame(spark), frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_clean_drops_the_hit_ones(spark):
    frame = spark.createDataFrame(benchmark()[:1], "item_id bigint, text string")
    docs = data.frame(spark)
    kept = winnowing.clean(docs, frame)
    assert kept.columns == docs.columns
    want = [r[0] for r in expected([r[:2] for r in data.rows()], benchmark()[:1]) if r[-1]]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(r[0] for r in data.rows() if r[0] is not None and r[0] not in want)


def test_empty_tables(spark):
    assert run(spark, data.empty(spark), benchmark()) == []
    out = run(spark, data.frame(spark), [])
    assert len(out) == len(data.rows()) and not any(r[-1] for r in out)
