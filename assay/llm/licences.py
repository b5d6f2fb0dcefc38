"""Licence scans: Aho-Corasick for identifier tags and notice phrases, shunting-yard for licence expressions.

A text's words (ASCII letters in lower case, digits, all bytes above ASCII) are joined by single spaces, and one automaton of all
phrases, each with a space before and after, runs over that form, so a phrase is found where its words stand consecutively, overlaps included.

* Base phrases give the contract's places.
* Notice phrases give labels of the method (a version, another family).
* Identifier tags (``SPDX-License-Identifier:`` and its kin) send the rest of their line to the parser: tokens, then shunting-yard
  with the precedence WITH, AND, OR into postfix order, then evaluation. A name evaluates to its labels and to whether the policy allows it; WITH
  adds the exception and allows what the exception opens; AND unites obligations, OR leaves a choice. An expression that does not
  parse gives no label and is counted.

The score is 1 minus the product of the doubts of the kinds of evidence found: base phrase, notice, parsed expression.

Defined results: a null text counts as empty; no phrase gives null places, empty labels and score 0; every row gives one row;
an empty table gives none; other columns do not matter.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from assay.llm.common import documents, map_texts, register

FIGURES = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "expressions array<string>, allowed boolean, n_invalid long")

# The phrases of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license identifier", "licence identifier")
TAG_LINE = re.compile(rb"(?i)(?:spdx-licen[cs]e-identifier|licen[cs]e-identifier)\s*[:=][ \t]*([^\r\n]*)")
#: Name beginnings whose licences the default policy does not allow unless an exception opens them.
COPYLEFT = ("gpl", "agpl", "lgpl", "cc-by-nc", "cc-by-nd", "proprietary")
# Identifiers of the public list of licences that count as names, lower case.
KNOWN = frozenset("""
0bsd afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 bsd-1-clause bsd-2-clause
bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0
cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0
cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only
gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0
lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0
ruby sleepycat unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())
# Exceptions of the same list, and the beginnings of the names that each of them opens.
EXCEPTIONS = {
    "autoconf-exception-3.0": ("gpl-3.0",),
    "bison-exception-2.2": ("gpl-2.0", "gpl-3.0"),
    "classpath-exception-2.0": ("gpl-2.0", "gpl-3.0"),
    "font-exception-2.0": ("gpl-2.0", "gpl-3.0"),
    "gcc-exception-3.1": ("gpl-3.0",),
    "linux-syscall-note": ("gpl-2.0",),
    "llvm-exception": ("apache-2.0",),
    "openjdk-assembly-exception-1.0": ("gpl-2.0",),
    "wxwindows-exception-3.1": ("gpl-2.0", "lgpl-2.0", "lgpl-2.1"),
}
DOUBT = {"base": 0.4, "notice": 0.3, "expression": 0.05}

WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, or None if it is not one."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the token before ends an operand
    for token in TOKEN.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                break  # a comment goes on behind the expression
            out.append(low)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(order: list[str], known: frozenset[str] = KNOWN, exceptions: dict[str, tuple[str, ...]] = EXCEPTIONS) -> tuple[frozenset[str], bool] | None:
    """The known labels that an expression in postfix order names, and whether the policy allows its use.

    A name that is not known is no label and allows nothing. An exception opens a licence only if it is known and made for it.
    """
    stack: list[tuple[frozenset[str], bool, str]] = []  # labels, allowed, the name if it is a single one
    for token in order:
        if token not in PRECEDENCE:
            label = token.rstrip("+")
            stack.append((frozenset([label]) & (known | exceptions.keys()), label in known and not label.startswith(COPYLEFT), label))
            continue
        if len(stack) < 2:
            return None
        (la, aa, name), (lb, ab, exception) = stack[-2], stack[-1]
        if token == "with":
            if not (name and exception):
                return None
            new = (la | lb, aa or (name in known and name.startswith(exceptions.get(exception, ()))), "")
        else:
            new = (la | lb, aa and ab if token == "and" else aa or ab, "")
        stack[-2:] = [new]
    return stack[0][:2] if len(stack) == 1 and stack[0][0] else None


@functools.cache
def automaton():
    made = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for phrase, label in BASE.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    for phrase in TAGS:
        kinds.setdefault(phrase, []).append(("tag", ""))
    for phrase, what in kinds.items():
        made.add_word(f" {phrase} ", (len(phrase) + 2, what))
    made.make_automaton()
    return made


def scan(text: bytes, known: frozenset[str] = KNOWN, exceptions: dict[str, tuple[str, ...]] = EXCEPTIONS) -> tuple:
    """The columns of ``FIGURES`` of one text, in time that grows with its length and its places."""
    words = text.translate(WORD_BYTES).split()
    form = b" " + b" ".join(words) + b" "
    begins, base, notices, tagged = [], set(), set(), False
    for end, (size, what) in automaton().iter(form.decode("latin-1")):
        for kind, label in what:
            if kind == "base":
                begins.append(end - size + 1)
                base.add(label)
            elif kind == "notice":
                notices.add(label)
            else:
                tagged = True
    places = [form.count(b" ", 0, b) for b in begins] if len(begins) < 3 else np.searchsorted(
        np.flatnonzero(np.frombuffer(form, np.uint8) == 0x20), begins).tolist()  # a word's number is that of the spaces before it
    found, expressions, allowed, invalid = set(), [], True, 0
    if tagged:
        for line in TAG_LINE.findall(text):
            order = postfix(line.decode("utf-8", "replace"))
            value = evaluate(order, known, exceptions) if order else None
            if value is None:
                invalid += 1
                continue
            found |= value[0]
            allowed &= value[1]
            expressions.append(" ".join(order))
    doubt = 1.0
    for kind, seen in (("base", base), ("notice", notices), ("expression", expressions)):
        if seen:
            doubt *= DOUBT[kind]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | notices | found)),
            round(1 - doubt, 6) if doubt < 1 else 0.0, expressions, allowed if expressions else None, invalid)


def licences(docs: DataFrame, keep: list[str], text_col: str = "text", known: frozenset[str] = KNOWN,
             exceptions: dict[str, tuple[str, ...]] = EXCEPTIONS) -> DataFrame:
    """Columns ``keep`` and the figures of every document; ``known`` names and ``exceptions`` (with what each opens) decide on expressions."""
    return map_texts(docs, keep, FIGURES, lambda texts: list(zip(*[scan(t, known, exceptions) for t in texts])), text_col)


@register("op8_licence_scan")
def op8_licence_scan(spark: SparkSession, root: str) -> DataFrame:
    return licences(documents(spark, root), ["doc_id"])
