import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from assay.llm import privacy
from tests.llm import data

PLAIN = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return (kind == 0 or (kind == 1 and all(int(p) <= 255 for p in value.split("."))) or (kind == 2 and 16 <= len(digits) <= 19 and luhn(digits))
            or (kind == 3 and 8 <= len(digits) <= 15))


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(text) if valid(k, m[0])]


def test_rules_against_plain_patterns():
    rng = random.Random(3)
    for n in range(8000):
        t = "".join(rng.choice("aA1.2@-+ ()_0é%9") for _ in range(rng.randint(0, 40)))
        assert privacy.rule_spans(t) == brute(t), t
    for n in range(400):
        t = "".join(rng.choice("0123456789- ") if rng.random() < 0.97 else rng.choice("+x.") for _ in range(300))
        assert privacy.rule_spans(t) == brute(t), t


def person(i):
    rng = random.Random(i)
    card = "".join(rng.choice("0123456789") for _ in range(15))
    card += next(c for c in "0123456789" if luhn(card + c))
    return [f"{data.text(i, 1)}.{i}@mail{i % 7}.example.org", ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            "-".join(card[k:k + 4] for k in (0, 4, 8, 12)), f"+{rng.randint(1, 99)} ({rng.randint(10, 99)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"]


def texts(n=160):
    out = []
    for i in range(n):
        words = data.text(20_000 + i, 60).split()
        for value in person(i):
            words.insert(random.Random(i).randrange(len(words)), value)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def network(spark):
    docs = spark.createDataFrame(list(enumerate(texts(700))), "doc_id long, text string")  # about 1,400 windows
    x, y = privacy.labelled_windows(docs)
    return privacy.train(x, y, epochs=8)


def test_network_on_texts_it_has_not_seen(network):
    fresh = texts(760)[700:]
    found = privacy.decoded(fresh, network)
    want = {(i, *s) for i, t in enumerate(fresh) for s in privacy.rule_spans(t)}
    got = {(i, s.kind, s.start, s.end) for i, spans in enumerate(found) for s in spans}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.85 * len(got)


def test_base_stays_and_added_spans_do_not_overlap(spark, network):
    rows = [(r[0], r[1]) for r in data.rows()] + [(1000 + i, t) for i, t in enumerate(texts(30))] + [(2000, "write to some.one (at) mail.example.org, please")]
    out = [list(c) for c in zip(*privacy.figures([(t or "").encode() for _, t in rows], network))]
    for (_, text), row in zip(rows, out):
        base = sorted(brute(text or ""))
        assert row[:4] == [sum(k == kind for k, _, _ in base) for kind in range(4)]
        written = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert row[4] == hashlib.sha256(written.encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row[5].split(",") if s)]
        assert {(privacy.KINDS[k], a, b) for k, a, b in base} <= set(spans) and len(spans) == len(base) + row[6]
    assert out[-1][6] <= 1


def test_gradients(network):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, privacy.CLASSES, (3, 7)), rng.integers(0, privacy.TAGS, (3, 7))
    p = {k: v.astype(np.float64) for k, v in network.items()}
    _, grads = privacy.step_gradients(x, y, p)
    for name in p:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            if name.endswith("w"):
                at = (int(x[0, 0]), at[1])
            kept, eps = p[name][at], 1e-2
            p[name][at] = kept + eps
            up = privacy.step_gradients(x, y, p)[0]
            p[name][at] = kept - eps
            down = privacy.step_gradients(x, y, p)[0]
            p[name][at] = kept
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3 + 0.02 * abs(grads[name][at]), name


def test_viterbi_against_all_paths(network):
    rng = np.random.default_rng(1)
    e = rng.normal(size=(4, 1, privacy.TAGS)).astype(np.float32)
    move, start = network["t"][:privacy.TAGS] + privacy.FORBIDDEN[:privacy.TAGS], network["t"][privacy.TAGS]
    best = max(itertools.product(range(privacy.TAGS), repeat=4),
               key=lambda s: start[s[0]] + sum(e[t, 0, s[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(s, s[1:])))
    assert tuple(privacy.viterbi(e, network)[0]) == best


def test_reconciliation_against_all_subsets():
    rng = random.Random(5)
    for _ in range(150):
        spans = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 20)
            spans.append(privacy.Scored(rng.randint(0, 3), a, a + rng.randint(1, 8), rng.randint(1, 20)))
        best = 0
        for n in range(len(spans) + 1):
            for some in itertools.combinations(spans, n):
                if all(x.end <= y.start or y.end <= x.start for x, y in itertools.combinations(some, 2)):
                    best = max(best, sum(s.score for s in some))
        got = privacy.reconciled(spans)
        assert sum(s.score for s in got) == best
        assert all(x.end <= y.start or y.end <= x.start for x, y in itertools.combinations(got, 2))


def test_every_span_lies_in_windows():
    for t in texts(20):
        classes = privacy.classes_of(t)
        starts = privacy.window_starts(t, classes)
        assert all(any(s <= a and b <= s + privacy.WIDTH for s in starts) for _, a, b in privacy.rule_spans(t) if b - a <= privacy.WIDTH // 2)


def test_long_words_beside_a_sign_lie_in_windows():
    local = "christopher.montgomery-smith.of.the.very.long.name.indeed.and.more" * 2
    for value in (f"{local} (at) example.org", f"{local} (AT) example.org", "x [ At ] " + "sub." * 30 + "org", local + " @ example.org", "a.b AT mail DOT example DOT org"):
        text = data.text(1, 30) + " " + value + " " + data.text(2, 30)
        classes = privacy.classes_of(text)
        starts = privacy.window_starts(text, classes)
        begin = text.index(value)
        assert starts and starts[0] <= begin and starts[-1] + privacy.WIDTH >= begin + len(value), value
        assert privacy.may_hold(text.encode())


def test_cut_spans_are_joined():
    """One span of 150 characters over windows that share 48."""
    half, tags = privacy.WIDTH // 2, np.zeros(400, np.uint8)
    tags[100], tags[101:250] = 1, 2
    e = np.ones((privacy.WIDTH, privacy.TAGS), np.float32)
    e[:, 0] = 0
    out, cut, last = [], None, None
    for start in range(0, 304, half):
        found, cut = privacy.window_spans(tags[start:start + privacy.WIDTH], e, start, 400, cut if last == start - half else None)
        out += found
        last = start
    assert [(s.kind, s.start, s.end) for s in privacy.reconciled(out)] == [(0, 100, 250)]
    assert privacy.window_spans(tags[144:240], e, 144, 400)[0] == []  # without the window before, its beginning is unknown


def test_spelled_forms_in_any_case_are_found(network):
    names = [data.text(900 + i, 1) for i in range(40)]
    texts_ = [f"{data.text(i, 12)} {n}.{i}{at}mail{i % 7}.example.org {data.text(50 + i, 12)}" for i, n in enumerate(names) for at in (" (at) ", " (AT) ")]
    found = privacy.figures([t.encode() for t in texts_], network)
    assert sum(1 for n in found[6] if n) >= 0.5 * len(texts_)


def test_rows(spark):
    docs = data.frame(spark)
    got = privacy.personal_data(docs, ["doc_id", "kept"]).collect()
    assert len(got) == len(data.rows()) and privacy.personal_data(data.empty(spark), ["doc_id"]).collect() == []
