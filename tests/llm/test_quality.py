import random
from collections import Counter

import pytest

from assay.llm import quality
from tests.llm import data


def brute(text):
    words = text.split()
    n = len(words)
    windows = Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    repeated = {j for i in range(n - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    spans = {p for i in range(n) if longest[i] >= quality.MIN_REPEAT for p in range(i, i + longest[i])}
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = sum(len(w.decode()) for w in words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    top = max(longest, default=0)
    kept = not failed and len(spans) <= quality.MAX_COVERED * n and (top if top >= quality.MIN_REPEAT else 0) <= quality.MAX_LONGEST * n
    return n, chars, sum(text.count(bytes([c])) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed, kept, len(spans), top


def test_against_brute_force():
    rng = random.Random(1)
    texts = [b" ".join(rng.choice([b"a", b"bb", "cé".encode(), b"d|", b"e\n"]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    texts += [(t or "").encode() for t in data.texts() if len(t or "") < 2_000] + [b"x " * 60, b"a b c d e f g h i j " * 9]
    got = quality.figures(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert tuple(c[i] for c in got[:7]) == want[:7], t
        assert (got[8][i], got[9][i]) == want[7:], t


def test_texts_of_one_batch_do_not_match_each_other():
    t = data.text(9, 80).encode()
    alone, together = quality.figures([t]), quality.figures([t, t, t])
    assert all(a[0] == b[0] == b[2] for a, b in zip(alone, together))


@pytest.mark.parametrize("n", [1, 2])
def test_filter_keeps_columns(spark, n):
    docs = data.frame(spark).repartition(n)
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    want = Counter((r[0], r[1]) for r in data.rows() if quality.figures([(r[1] or "").encode()])[6][0])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_rows_and_empty_table(spark):
    got = quality.quality(data.frame(spark), ["doc_id"]).collect()
    assert len(got) == len(data.rows()) and next(g for g in got if g.doc_id == 0).n_words == 0
    assert quality.quality(data.empty(spark), ["doc_id"]).collect() == []
