"""Quality rules from repeated passages, found with a suffix array over the words of each text.

The words of a text are numbered, and its suffixes are sorted by prefix doubling in numpy: a round sorts only the suffixes
that still tie, by the ranks of their first and second half. The ranks of all rounds then give the longest common prefix
of neighbours in the array (its intervals are the repeated substrings). The longest match of a position is the larger of
its two neighbours' prefixes; where the position before has no longer match, the match cannot be extended to the left
either and is a maximal repeat. Spans of maximal repeats of ``min_repeat`` words or more are united; a text is rejected
when the union covers too large a share of it, or the longest repeat is too large a share.

Many texts are sorted at once: the words of different texts get different numbers, and each text ends in a number of its
own, so no match crosses texts. Memory is bounded by the batch (about four million bytes of text, or one longer text).

Defined results: a null text counts as empty and has no words, hence fails (fewer than 50 words); every input row gives one
row, repeated rows too; an empty table gives none; other columns are passed through by ``filter_quality`` whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from assay.llm.common import documents, map_texts, numbering, register

MIN_WORDS = 50
MIN_REPEAT = 8        # words; shorter repeats are ordinary language
MAX_COVERED = 0.45    # share of words in maximal repeats
MAX_LONGEST = 0.25    # length of the longest repeat as a share of the words

FIGURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
           "n_repeats long, covered_words long, longest_repeat long")

SPACE = np.zeros(256, np.uint8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(b"#*$%&|<>")] = 1
POINT = np.ones(256, np.uint8)  # bytes that begin a code point of a word
POINT[0x80:0xC0] = 0
POINT[SPACE == 1] = 0


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, each text closed by a number of its own; and where each text begins (with the end)."""
    numbers: list[int] = []
    starts, base = [0], 0
    for text in texts:
        known = numbering(base)
        numbers.extend(map(known.__getitem__, text.split()))
        base += len(known)
        numbers.append(base)
        base += 1
        starts.append(len(numbers))
    return np.array(numbers, dtype=np.int64), np.array(starts, dtype=np.int64)


def longest_matches(numbers: np.ndarray) -> np.ndarray:
    """For every position the length of the longest match that begins there and at some other position."""
    n = len(numbers)
    longest = np.zeros(n, dtype=np.int64)
    if not n:
        return longest
    counts = np.bincount(numbers)
    rank = (np.cumsum(counts) - counts)[numbers]
    levels, k = [(1, rank)], 1
    tied = np.flatnonzero(counts[numbers] > 1)
    while len(tied):
        first = rank[tied]
        key = first * (n + 1) + rank[tied + k]
        order = np.argsort(key, kind="stable")
        tied, key, first = tied[order], key[order], first[order]
        at = np.arange(len(tied))
        new_key = np.r_[True, key[1:] != key[:-1]]
        start_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        start_of_first = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], at, 0))
        rank = rank.copy()
        rank[tied] = first + start_of_key - start_of_first
        sizes = np.diff(np.r_[np.flatnonzero(new_key), len(tied)])
        tied = tied[np.repeat(sizes, sizes) > 1]
        k *= 2
        levels.append((k, rank))
    array = np.empty(n, dtype=np.int64)
    array[rank] = np.arange(n)
    words = levels[0][1]
    pairs = np.flatnonzero(words[array[:-1]] == words[array[1:]])  # neighbours with a common prefix at all
    a, b = array[pairs], array[pairs + 1]
    common = np.zeros(len(pairs), dtype=np.int64)
    for k, ranks in reversed(levels):
        common += k * (ranks[np.minimum(a + common, n - 1)] == ranks[np.minimum(b + common, n - 1)])
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in the union of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + length, -1)
    return np.cumsum(change[:-1]) > 0


def figures(texts: list[bytes], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> list[np.ndarray]:
    """The columns of ``FIGURES`` for each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def per_text(table: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(table[data], dtype=np.int64)]
        return total[bounds[1:]] - total[bounds[:-1]]

    dup_lines = []
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))

    numbers, starts = numbered(texts)
    longest = longest_matches(numbers)
    n_words = np.diff(starts) - 1

    def words_in(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return total[starts[1:]] - total[starts[:-1]]

    triples = np.flatnonzero(longest >= 3)
    repeat_words = words_in(covered(triples, np.full(len(triples), 3), len(numbers)))
    before = np.r_[0, longest[:-1]]  # the end mark of the text before has no match
    maximal = np.flatnonzero((longest >= min_repeat) & (before <= longest))
    in_spans = words_in(covered(maximal, longest[maximal], len(numbers)))
    top = np.maximum.reduceat(longest, starts[:-1]) if len(texts) else longest
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > 50 * n_words)
    kept = ~failed & (in_spans <= max_covered * n_words) & (np.where(top >= min_repeat, top, 0) <= max_longest * n_words)
    is_start = np.zeros(len(numbers), dtype=bool)
    is_start[maximal] = True
    return [n_words, per_text(POINT), per_text(SYMBOL), np.array(dup_lines), repeat_words, failed, kept, words_in(is_start), in_spans, top]


def quality(docs: DataFrame, keep: list[str], **limits: float) -> DataFrame:
    """Columns ``keep`` and the figures and verdict of every document."""
    return map_texts(docs, keep, FIGURES, lambda texts: figures(texts, **limits))


def filter_quality(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, all columns as they were."""
    names = docs.columns
    judged = map_texts(docs, names, "`__kept` boolean", lambda texts: [figures(texts, **limits)[6]])
    return judged.where("`__kept`").drop("__kept")


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality(documents(spark, root), ["doc_id"])
