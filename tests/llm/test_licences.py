import re
import time

import pytest

from assay.llm import licences
from tests.llm import data

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = ["GNU General Public License cc-by CC  BY cc by cc by", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nx",
         "SPDX-License-Identifier: MIT AND", "İ cc by é-mit license", "gnu general\npublic LICENSE, version 3", "cc by cc by nc", "xcc by", "cc byx", "mit, license"]


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force():
    for t in [x or "" for x in data.texts()] + TEXTS:
        got = licences.scan(t.encode())
        assert got[:5] == brute(t), t
        assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(","))) and 0 <= got[6] <= 1


@pytest.mark.parametrize("expression, labels, allowed", [
    ("MIT", {"mit"}, True),
    ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, True),
    ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, False),
    ("GPL-2.0+ WITH Classpath-exception-2.0", {"gpl-2.0", "classpath-exception-2.0"}, True),
    ("GPL-2.0-only OR MIT AND Apache-2.0", {"gpl-2.0-only", "mit", "apache-2.0"}, True),
    ("(GPL-2.0-only OR MIT) AND AGPL-3.0", {"gpl-2.0-only", "mit", "agpl-3.0"}, False),
    ("((mit))", {"mit"}, True),
    ("GPL-2.0 WITH nonsense", {"gpl-2.0"}, False),
    ("GPL-2.0 WITH LLVM-exception", {"gpl-2.0", "llvm-exception"}, False),
    ("MIT WITH nonsense", {"mit"}, True),
    ("MIT OR whatever", {"mit"}, True),
    ("MIT AND whatever", {"mit"}, False),
])
def test_expressions(expression, labels, allowed):
    assert licences.evaluate(licences.postfix(expression)) == (labels, allowed)


@pytest.mark.parametrize("expression", ["", "AND", "MIT AND", "OR MIT", "(MIT", "MIT)", "()", "MIT AND OR BSD", "(MIT OR BSD) WITH x", "MIT (BSD)", "some words here", "foo AND bar"])
def test_what_is_no_expression(expression):
    order = licences.postfix(expression)
    assert order is None or licences.evaluate(order) is None


def test_a_long_text_of_places_takes_linear_time():
    begin = time.process_time()
    n_words, n_base, first, last, *_ = licences.scan(b"cc by " * 400_000)
    assert (n_words, n_base, first, last) == (800_000, 400_000, 0, 799_998)
    assert time.process_time() - begin < 10  # the count of spaces before each place would take minutes


def test_lists_are_arguments(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: HOUSE-1.0 WITH house-note")], "doc_id long, text string")
    assert licences.licences(docs, ["doc_id"]).first().n_invalid == 1
    r = licences.licences(docs, ["doc_id"], known=frozenset(["house-1.0"]), exceptions={"house-note": ("house",)}).first()
    assert (r.labels, r.allowed, r.n_invalid) == ("house-1.0,house-note", True, 0)


def test_rows(spark):
    got = licences.licences(data.frame(spark), ["doc_id", "score"][:1]).collect()
    assert len(got) == len(data.rows())
    assert licences.licences(data.empty(spark), ["doc_id"]).collect() == []
