import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assay.llm import collocations as C
from tests.llm import data


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def expected(rows, minimum, longest=5, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(w[s:s + size]) for s in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) >= 2 and a >= minimum}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("minimum", [2, 7])
def test_against_brute_force(spark, minimum, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 3_000)  # many shards, also within a task
    out = got(C.collocations(data.frame(spark), minimum, top=300))
    assert out == expected([r[1:3] for r in data.rows()], minimum, top=300)
    assert len(out) > 50 and {r[0] for r in out} >= {"en", "de", "und"}


def test_phrases_of_all_lengths_with_overlaps_ties_and_punctuation(spark):
    rng = random.Random(3)
    texts = ["a a a a a a a a", "A b. c D, a\tb c d e f g! é É\x0b\x85x ʼn", "1.5 2:3"] + [
        " ".join(rng.choice(["a", "b", "c", "d", "the", "of", "x.", "New", "York,"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, ("en", "", None)[i % 3], "s", 1) + (None,) * len(data.EXTRA) for i, t in enumerate(texts)]
    assert got(C.collocations(data.frame(spark, rows), 3, top=None)) == expected([r[1:3] for r in rows], 3, top=10**6)


def test_a_passage_in_a_third_of_all_texts(spark):
    passage = data.text(77, 40)
    rows = [(i, (passage if i % 3 == 0 else data.text(i, 30)), "en", "s", 1) + (None,) * len(data.EXTRA) for i in range(300)]
    assert got(C.collocations(data.frame(spark, rows), 90)) == expected([r[1:3] for r in rows], 90)


def test_empty_and_nothing_frequent(spark):
    assert C.collocations(data.empty(spark)).collect() == []
    assert C.collocations(data.frame(spark, data.rows()[:6]), 50).collect() == []


@pytest.mark.parametrize("n, b", [(2, 1), (2, 9), (3, 21), (3, 22), (4, 16), (5, 13), (5, 25), (5, 26), (5, 32), (2, 32)])
def test_permutation_is_invertible_and_filters_lose_nothing(n, b):
    rng = np.random.default_rng(n * 100 + b)
    ids = [rng.integers(0, 1 << b, 5000, dtype=np.uint64) for _ in range(n)]
    for j in range(n):
        ids[j][:50] = ids[j][0]
    back = C.restored(C.unpacked(C.packed(C.permuted(ids, b), b), b, n), b)
    assert all((x == y).all() for x, y in zip(ids, back))
    words, counts, place = C.grouped(C.packed(C.permuted(ids, b), b))
    counts = counts + rng.integers(0, 600, len(counts))
    assert all((w[place] == x).all() for w, x in zip(words, C.packed(C.permuted(ids, b), b)))
    for size in (0, 1, 3, len(counts)):
        made = C.QuotientFilter.of([w[:size] for w in words], counts[:size], n * b)
        again, times = C.QuotientFilter(*C.unpack(made.block())).entries()
        assert all((x == y[:size]).all() for x, y in zip(again, words)) and (times == counts[:size]).all()


def test_merged_filters_add_up():
    rng = np.random.default_rng(5)
    want, filters = Counter(), []
    for _ in range(6):
        keys = [rng.integers(0, 40, 300, dtype=np.uint64) for _ in range(3)]
        want.update(zip(*[k.tolist() for k in keys]))
        words, counts, _ = C.grouped(C.packed(C.permuted(keys, 23), 23))
        filters.append(C.QuotientFilter.of(words, counts, 69))
    words, total, places = C.QuotientFilter.merged(filters)
    ids = C.restored(C.unpacked(words, 23, 3), 23)
    assert dict(zip(zip(*[i.tolist() for i in ids]), total.tolist())) == want
    assert [len(p) for p in places] == [len(f.counters) for f in filters]


def test_a_filter_is_smaller_than_its_numbers():
    rng = np.random.default_rng(6)
    words, counts, _ = C.grouped(C.packed(C.permuted([rng.integers(0, 1 << 18, 100_000, dtype=np.uint64) for _ in range(2)], 18), 18))
    made = C.QuotientFilter.of(words, counts, 36)
    assert made.runs.nbytes + made.remainders.nbytes + made.counters.nbytes + made.large.nbytes < 0.5 * (8 + 8) * len(counts)
