"""Toxicity scores of restored text: noisy-channel deobfuscation, then a classifier of independent causes.

1. **Counts.** In one pass over the labelled training rows, tasks count in how many texts, and in how many toxic ones, each feature
   stands, and the character trigrams of their words. Counts are condensed per task and summed by key range; all features that
   tell the labels apart (by their likelihood ratio) form the model's vocabulary.
2. **Restoration.** Every word that holds look-alike signs (1d10t, @$$, idio+), signs between letters (i.d.1.0.t) or a letter twice or
   more in a row (iidioott), or belongs to a run of single letters and look-alikes (1 d 1 0 t) is decoded, however long: each sign offers
   what may have been meant (itself, its letters, nothing), a run of equal letters offers one or two of them, a gap between single letters
   offers a space or none; Viterbi finds the best path through this lattice under the character trigram model and the channel's costs.
   Signs at the ends of a word may be punctuation, so the best path that reads them all as letters counts too. The features of a
   decoded word are those of its readings and of the word as it stands; it counts as restored if the best path has other letters
   (of doubled letters alone, at least two fewer: letter is no hidden word), or if signs stood between single ones. A number with its signs (24/7, $100) is no hidden word, nor are signs without a letter, @ or $ (``readable``).
   All other words are their own restoration.
3. **Classifier.** Regression with independent causes (the score is 1 - exp(-sum of weights)) on the restored words and their beginnings of four, five and seven letters (so inflected forms of a learned
   word count too), fitted on all labelled training rows. A clean text adds its plain sum of weights to the loss, so the number of clean
   texts with each feature says all of them; of the toxic texts tasks count the distinct sets of features. Up to ``ENTRIES``
   features of such sets are held by the driver, more stay with the tasks and every step adds up their slopes. Every text is scored whole.

Labels are read for training rows only; language, source and doc_id are no inputs (doc_id only decides which rows are held out).

Defined results: a null text counts as empty and gets the score of a text without any feature; rows without doc_id belong to the training part but match
no label; a document with several labels counts once per label; unlabelled rows are scored like others; with no label at all every score is
0; every row gives one row; an empty table gives none.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assay.llm.common import bounded_batches, documents, held_out, labels, map_texts, numbering, pack, partitions, register, small_batches, stored, unpack, whole
from assay.llm.wordids import Encoded, WordIds, flattened

ENTRIES = 4_000_000  # features of distinct toxic texts that the driver holds while it fits
MODULUS = 3
LEAST_TEXTS = 3     # a feature stands in at least so many toxic texts
LEAST_RATIO = 6.0   # and its log likelihood ratio is at least this
CUTOFF = 0.7
FLUSH = 600_000  # distinct features a counting task holds before it sends them on
BATCH = 2_000_000
SMALL_LABELS = 1_000_000  # rows of 12 bytes that may be broadcast

RESULT = "score double, predicted int, n_restored long"

#: Signs and what they may stand for; each also may stand for itself or for nothing.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
               "+": "t", "€": "e", "(": "c", "£": "l"}
SIGNS = re.escape("".join(LOOK_ALIKES))
ITSELF, MEANT, NOTHING, DOUBLE, TWICE = -4.0, -1.0, -2.5, -0.7, -2.0   # log costs of the channel; TWICE for one letter meant by two

BEGINNINGS = (4, 5, 7)

EDGES = re.compile(r"^[^\w@$€£]+|[^\w]+$")
LETTERS = re.compile(r"[^\W\d_]+")
KEPT = re.compile(rf"[\w{SIGNS}]")
REPEATED = re.compile(r"([^\W\d_])\1")
THRICE = re.compile(r"([^\W\d_])\1\1")
REPEATED_RUN = re.compile(r"([^\W\d_])\1+")
MOST_RUNS = 5  # doubled places of a word whose paths are listed; with more, Viterbi goes through them
DOTTED = re.compile(rf"(?:(?:[^\W\d_]|[{SIGNS}])[\W_]){{2,}}(?:[^\W\d_]|[{SIGNS}])")
HOLDS = re.compile(rf"[{SIGNS}\W_]")
LONG = 200  # characters of a word whose restoration is not remembered
ALPHABET = 64


def symbol(c: str) -> int:
    """Character classes of the language model: 0 border, 1-26 a-z, 27-58 Latin letters with marks, 59 other letters."""
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + (o & 31) if 0xDF <= o <= 0xFF else 59 if c.isalpha() else 0


known_symbol = functools.lru_cache(maxsize=4096)(symbol)


def key_of(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> 1


def features_of(word: str) -> list[str]:
    n = len(word)
    return [word, *[word[:b] + "-" for b in BEGINNINGS if n > b]] if n > BEGINNINGS[0] else [word]


@dataclass
class Language:
    """log P(character | two before), from counts with backing off to shorter contexts."""
    three: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "Language":
        c3 = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * ALPHABET)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        return cls(np.log((c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)))


def readable(core: str) -> bool:
    """Whether signs may stand for letters here: there is a letter, @, $$, or a $ without any digit."""
    return any(map(str.isalpha, core)) or (len(core) > 1 and ("@" in core or "$$" in core or ("$" in core and not any(map(str.isdigit, core)))))


def suspicious(core: str) -> bool:
    """Whether a word without its outer signs may hide another."""
    if LETTERS.fullmatch(core):
        return REPEATED.search(core) is not None
    return len(core) > 1 and (HOLDS.search(core) is not None or REPEATED.search(core) is not None) and readable(core)


def counts_as_restored(outer: str, best: str) -> bool:
    if LETTERS.fullmatch(outer) and not THRICE.search(outer):
        return len(outer) - len(best) > 1
    return best != "" and (best != "".join(filter(str.isalnum, outer)) or DOTTED.fullmatch(outer) is not None)


def lattice(core: str, spaced: bool = False, ends: bool = False) -> list[list[tuple[str, float]]]:
    """For each place what may stand there, with the channel's cost. With ``ends`` look-alikes before the first and after the last letter or
    digit are letters."""
    inner = [i for i, c in enumerate(core) if c.isalnum()] or [len(core)]
    places: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(core):
        c = core[i]
        run = 1
        while i + run < len(core) and core[i + run] == c:
            run += 1
        if c.isalpha():
            if run >= 3:
                places.append([(c, 0.0), (c + c, DOUBLE)])
            else:
                places.append([(c, 0.0)] if run == 1 else [(c + c, 0.0), (c, TWICE)])
                if spaced and i + run < len(core):
                    places.append([("", 0.0), (" ", 0.0)])
        elif c.isdigit() and c not in LOOK_ALIKES:
            places += [[(c, 0.0)]] * run
        else:
            meant = [(m, MEANT) for m in LOOK_ALIKES.get(c, "")]
            letter = ends and meant and not inner[0] <= i <= inner[-1]
            places += [meant + ([] if letter else [("", NOTHING if meant else 0.0)]) + ([(c, ITSELF)] if c.isdigit() else [])] * (run if meant else 1)
            if spaced and meant and i + run < len(core):
                places.append([("", 0.0), (" ", 0.0)])
        i += run
    return places


def decode(core: str, language: Language, spaced: bool = False, ends: bool = False) -> str:
    """The most probable restoration: Viterbi over the lattice, the state being the last two characters."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    three = language.three
    for choices in [*lattice(core, spaced, ends), [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for piece, cost in choices:
                x, y, total = a, b, score + cost
                for c in piece:
                    z = known_symbol(c)
                    total += three[x, y, z]
                    x, y = (y, z) if z else (0, 0)
                held = new.get((x, y))
                if held is None or total > held[0]:
                    new[x, y] = (total, (path, piece) if piece else path)
        best = new
    (_, path), = best.values()  # the border at the end leaves one state
    pieces = []
    while path is not None:
        path, piece = path
        pieces.append(piece)
    return "".join(reversed(pieces)).strip()


def variants(word: str) -> tuple[list[str], list[float]] | None:
    """All paths through the lattice of a word of letters only, with the channel's costs; None if there are too many to list."""
    runs = [(m.start(), m.end()) for m in REPEATED_RUN.finditer(word)]
    if len(runs) > MOST_RUNS:
        return None
    made, costs, done = [""], [0.0], 0
    for a, b in runs:
        c = word[a]
        choices = ((c, 0.0), (c + c, DOUBLE)) if b - a > 2 else ((c + c, 0.0), (c, TWICE))
        before = word[done:a]
        made = [m + before + piece for m in made for piece, _ in choices]
        costs = [x + cost for x in costs for _, cost in choices]
        done = b
    return [m + word[done:] for m in made], costs


def decode_letters(words: list[str], language: Language) -> list[str]:
    """``decode`` of words of letters with few doubled ones, all at once: their paths are listed and summed in one go; ties go to the first path."""
    out, every, costs, sizes, at = list(words), [], [], [], []
    for i, word in enumerate(words):
        found = variants(word)
        if found is None:
            out[i] = decode(word, language)
        else:
            every += found[0]
            costs += found[1]
            sizes.append(len(found[0]))
            at.append(i)
    if not every:
        return out
    lengths = np.fromiter(map(len, every), np.int64, len(every)) + 2  # trigrams of a path, and one over the border to the next
    ends = np.cumsum(lengths)
    values = language.three.ravel()[trigrams_of_letters(every)]
    values[ends[:-1] - 1] = 0.0
    total = np.add.reduceat(values, ends - lengths) + np.array(costs)
    sizes = np.array(sizes)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    best = np.flatnonzero(total == np.maximum.reduceat(total, first)[owner])
    _, one = np.unique(owner[best], return_index=True)
    for i, j in zip(at, best[one].tolist()):
        out[i] = every[j]
    return out


class Decoder:
    """Restorations of words under one model; a bounded number of those that hold signs is remembered."""

    def __init__(self, block: bytes):
        self.language = Language(np.frombuffer(block, dtype=np.float64).reshape(ALPHABET, ALPHABET, ALPHABET))
        self._remembered = functools.lru_cache(maxsize=100_000)(lambda core, spaced, ends: decode(core, self.language, spaced, ends))

    def __call__(self, core: str, spaced: bool, ends: bool = False) -> str:
        return self._remembered(core, spaced, ends) if len(core) <= LONG else decode(core, self.language, spaced, ends)

    def letters(self, words: list[str]) -> list[str]:
        return decode_letters(words, self.language)


@functools.lru_cache(maxsize=1)
def decoder(block: bytes) -> Decoder:
    """One per worker process and model."""
    return Decoder(block)


def lowered(words: list[bytes]) -> list[str]:
    return b"\n".join(words).decode("utf-8", "replace").lower().split("\n") if words else []  # a word has no line end


def core_of(word: str) -> str:
    return word if word.isalpha() else EDGES.sub("", word)


def outer_of(word: str) -> str:
    """The word without its outer signs, look-alikes kept."""
    if word.isalpha():
        return word
    end = len(word)
    while end and not KEPT.match(word[end - 1]):
        end -= 1
    return word[KEPT.search(word).start():end] if end else ""


def single(word: str) -> bool:
    outer = outer_of(word)
    return len(outer) == 1 and (outer.isalpha() or outer in LOOK_ALIKES)


def single_runs(single: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) of all stretches of three or more words of one letter."""
    edges = np.flatnonzero(np.diff(np.r_[0, single.astype(np.int8), 0]))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        first, last = np.searchsorted(starts, [s, e - 1], side="right") - 1
        for i in range(first, last + 1):  # a stretch may end one text and begin the next
            a, b = max(s, int(starts[i])), min(e, int(starts[i + 1]))
            if b - a >= 3:
                yield i, a, b


class Features:
    """Features of words and texts by number, with what is known of each held word."""

    def __init__(self, restore=None, limit: int = 300_000):
        self.restore = restore
        self.words = WordIds(self._encode, limit)
        self.words.renewed = self._renewed
        self.changed, self.single = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)

    def number_of(self, parts: list[list[str]]) -> Encoded:
        """Numbers of the features of each list of words, and how many each has."""
        raise NotImplementedError

    def _renewed(self, stay: np.ndarray) -> None:
        self.changed, self.single = self.changed[stay], self.single[stay]

    def _encode(self, words: list[bytes]) -> Encoded:
        held = len(self.words.known) - len(words)
        small = lowered(words)
        plain = [w.isalpha() for w in small]
        cores = [w if p else EDGES.sub("", w) for w, p in zip(small, plain)]
        outers = [w if p else outer_of(w) for w, p in zip(small, plain)]
        parts = [[c] if c else [] for c in cores]
        changed = np.zeros(len(words), dtype=bool)
        if self.restore is not None:
            doubled = [i for i, o in enumerate(outers) if REPEATED.search(o) and o.isalpha()]
            for i, best in zip(doubled, self.restore.letters([outers[i] for i in doubled])):
                if best != outers[i]:
                    changed[i] = counts_as_restored(outers[i], best)
                if best not in parts[i]:
                    parts[i].append(best)
            for i in (i for i, p in enumerate(plain) if not p):
                core, outer = cores[i], outers[i]
                if not outer.isalpha() and suspicious(outer):
                    best = self.restore(outer, False).split()
                    changed[i] = counts_as_restored(outer, "".join(best))
                    more = self.restore(outer, False, True).split() if outer != core or not outer[0].isalnum() else []
                    parts[i] = list(dict.fromkeys(parts[i] + best + more))
        self.changed = np.concatenate([self.changed[:held], changed])
        self.single = np.concatenate([self.single[:held], np.array([len(o) == 1 and (o.isalpha() or o in LOOK_ALIKES) for o in outers], dtype=bool)])
        distinct = numbering()  # words that differ in their outer signs only have the same parts
        same = np.fromiter(map(distinct.__getitem__, map(tuple, parts)), np.int64, len(parts))
        ids, sizes = self.number_of(list(distinct))
        begin, each = (np.cumsum(sizes) - sizes)[same], sizes[same]
        ends = np.cumsum(each)
        return ids[np.repeat(begin - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)], each

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature) of all texts, each pair once, ascending; and the number of restored words of each text."""
        split = [t.split() for t in texts]
        at, starts = self.words.numbers(split)
        ids, sizes = self.words.gathered(at, starts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        running = np.r_[0, np.cumsum(self.changed[at])]
        restored = running[starts[1:]] - running[starts[:-1]]
        if self.restore is not None:
            more: list[list[str]] = []
            who: list[int] = []
            for i, a, b in single_runs(self.single[at], starts):
                letters = [outer_of(w) for w in lowered(split[i][a - starts[i]:b - starts[i]])]
                if not any(map(str.isalpha, letters)) and not readable("".join(letters)):
                    continue
                for k in range(0, len(letters), 40):  # a long run in stretches that overlap
                    parts = [p for p in self.restore("".join(letters[k:k + 60]), True).split() if len(p) > 2]
                    restored[i] += len(parts)
                    more.append(parts)
                    who.append(i)
            if more:
                found, counts = self.number_of(more)
                ids, owner = np.r_[ids, found], np.r_[owner, np.repeat(who, counts)]
        pairs = np.unique(owner.astype(np.int64) << 32 | ids.astype(np.int64))
        return pairs >> 32, pairs & 0xFFFFFFFF, restored


class AllFeatures(Features):
    """Every feature gets a number as it appears; ``keys`` has their keys."""

    def __init__(self):
        super().__init__()
        self.known = numbering()

    def number_of(self, parts: list[list[str]]) -> Encoded:
        lists = [[self.known[f] for p in words for f in features_of(p)] for words in parts]
        return flattened(lists)

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        names = list(self.known)
        return np.array([key_of(names[i]) for i in numbers.tolist()], dtype=np.int64)


class ModelFeatures(Features):
    """Only features of the model count; their number is their place among the model's ascending keys."""

    def __init__(self, keys: np.ndarray, restore):
        super().__init__(restore)
        self.model_keys = keys

    def number_of(self, parts: list[list[str]]) -> Encoded:
        if not len(self.model_keys):
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        lists = [features_of(words[0]) if len(words) == 1 else [f for p in words for f in features_of(p)] for words in parts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        digests = map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(lists))
        every = (np.fromiter(digests, np.uint64, int(sizes.sum())) >> np.uint64(1)).astype(np.int64)  # as key_of
        at = np.minimum(np.searchsorted(self.model_keys, every), len(self.model_keys) - 1)
        found = self.model_keys[at] == every
        return at[found].astype(np.uint32), np.bincount(np.repeat(np.arange(len(parts)), sizes)[found], minlength=len(parts))


@functools.lru_cache(maxsize=1)
def model_features(keys: bytes, language: bytes) -> ModelFeatures:
    """One per worker process and model."""
    return ModelFeatures(np.frombuffer(keys, dtype=np.int64), decoder(language))


SYMBOLS = np.array([symbol(chr(i)) for i in range(0x250)], dtype=np.int64)


def trigrams_of(words: list[str]) -> np.ndarray:
    """Places of the trigrams of all words of letters, each word between borders."""
    return trigrams_of_letters([w for w in words if LETTERS.fullmatch(w)])


def trigrams_of_letters(words: list[str]) -> np.ndarray:
    points = np.frombuffer(("  " + "  ".join(words) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.where(points < len(SYMBOLS), SYMBOLS[np.minimum(points, len(SYMBOLS) - 1)], 59)
    return (s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:]


COUNTED = "part int, block binary"


def counted(train: DataFrame, parts: int) -> DataFrame:
    """Per key range the features that tell the labels apart best, and (part -1) the trigram counts. ``train`` has text and toxic."""

    def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = np.zeros(ALPHABET ** 3, dtype=np.int64)
        totals = np.zeros(2, dtype=np.int64)
        features = AllFeatures()
        both = np.zeros((0, 2), dtype=np.int64)

        def flushed():
            seen = np.flatnonzero(both[:, 0])
            keys = features.keys(seen)
            order = np.argsort(keys)
            keys, counts = keys[order], both[seen][order]
            bounds = np.searchsorted((keys >> 32) * parts >> 31, np.arange(parts + 1))
            rows = [(i, pack(keys[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "block"])

        for batch in small_batches(batches, "t", BATCH):
            toxic = np.asarray(batch.column("toxic"), dtype=np.int64)
            texts = batch.column("t").to_pylist()
            totals += (len(toxic), toxic.sum())
            owner, ids, _ = features(texts)
            n = len(features.known)
            both = np.r_[both, np.zeros((n - len(both), 2), dtype=np.int64)]
            both += np.stack([np.bincount(ids, minlength=n), np.bincount(ids, toxic[owner], minlength=n).astype(np.int64)], axis=1)
            words = {core_of(w) for w in lowered(list({w for t in texts for w in t.split()}))}
            trigrams += np.bincount(trigrams_of(sorted(words)), minlength=len(trigrams))
            if n > FLUSH:
                yield flushed()
                features, both = AllFeatures(), np.zeros((0, 2), dtype=np.int64)
        if len(both):
            yield flushed()
        at = np.flatnonzero(trigrams)
        yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "block": pa.array([pack(at, trigrams[at], totals)], pa.binary())})

    def add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [unpack(b) for b in frame.block]
        if key[0] < 0:
            trigrams, totals = np.zeros(ALPHABET ** 3, dtype=np.int64), np.zeros(2, dtype=np.int64)
            for at, counts, sums in blocks:
                trigrams[at] += counts
                totals += sums
            at = np.flatnonzero(trigrams)
            return pd.DataFrame({"part": [-1], "block": [pack(at, trigrams[at], totals)]})
        keys, counts = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first)
        enough = counts[:, 1] >= LEAST_TEXTS
        return pd.DataFrame({"part": [int(key[0])], "block": [pack(keys[enough], counts[enough])]})

    source = train.select(whole().cast("binary").alias("t"), F.col("toxic").cast("int").alias("toxic"))
    return stored(source.mapInArrow(map_side, COUNTED).groupBy("part").applyInPandas(add_up, COUNTED), "toxic-counts")


def chosen_features(counts: DataFrame, total: int, toxic: int) -> np.ndarray:
    """Keys of the features with a likelihood ratio of at least ``LEAST_RATIO``, ascending."""
    base = (toxic + 0.5) / (total + 1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                keys, n = unpack(block)
                rate = (n[:, 1] + 0.5 * base) / (n[:, 0] + 0.5)
                value = np.where(rate > base, n[:, 1] * np.log(rate / base) + (n[:, 0] - n[:, 1]) * np.log(np.maximum(1 - rate, 1e-9) / (1 - base)), 0)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[value >= LEAST_RATIO])})

    rows = counts.where("part >= 0").select("block").mapInArrow(best, "key long").collect()
    return np.sort(np.array([r.key for r in rows], dtype=np.int64))


@dataclass
class Model:
    keys: np.ndarray     # ascending
    weights: np.ndarray
    bias: float
    language: bytes      # the trigram model's table


Sets = tuple[np.ndarray, np.ndarray, np.ndarray]  # set and feature of each entry, and the texts of each set


def sets_of(keys: list[bytes], n: list[int]) -> Sets:
    return np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys]), np.frombuffer(b"".join(keys), np.int32).astype(np.int64), np.array(n, dtype=float)


def toxic_slopes(theta: np.ndarray, at: np.ndarray, cols: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gradient of the weights, and of the bias after them, from sets of features of toxic texts."""
    total = np.bincount(at, theta[cols], minlength=len(n)) + theta[-1]
    slope = -n / np.expm1(np.minimum(total, 700.0))
    return np.r_[np.bincount(cols, slope[at], minlength=len(theta) - 1), slope.sum()]


def descend(toxic: Callable[[np.ndarray], np.ndarray], clean: np.ndarray, steps: int = 800, price: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights of at least 0 that maximise the likelihood of label 1 with probability 1 - exp(-sum), by Adam over all rows.

    Each feature is a cause that alone may make a text toxic, and words that merely stand beside such a cause get no weight, as the text
    is explained already. A weight costs as much as ``price`` clean texts with that feature would. ``toxic`` gives the gradient of the
    toxic texts, ``clean`` the number of clean texts with each feature and, after them, of all clean texts.
    """
    theta, m, v = np.full(len(clean), 0.05), np.zeros(len(clean)), np.zeros(len(clean))
    fixed = clean + np.r_[np.full(len(clean) - 1, price), 0.0]
    for step in range(1, steps + 1):
        gradient = toxic(theta) + fixed
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
        theta -= 0.1 * (0.995 ** step) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        theta = np.maximum(theta, 0)
        theta[-1] = max(theta[-1], 1e-5)
    return theta[:-1], float(theta[-1])


def fit_weights(rows: list[tuple[list[int], int]], n_features: int, steps: int = 800, price: float = 0.3) -> tuple[np.ndarray, float]:
    """``descend`` over rows at hand: the features of each text, and its label."""
    sets = Counter(np.array(f, dtype=np.int32).tobytes() for f, y in rows if y > 0)
    clean = [f for f, y in rows if y <= 0]
    counts = np.bincount(np.array([j for f in clean for j in f], dtype=np.int64), minlength=n_features)
    at = sets_of(list(sets), list(sets.values()))
    return descend(lambda theta: toxic_slopes(theta, *at), np.r_[counts, len(clean)].astype(float), steps, price)


TALLIED = "key binary, toxic int, n long"
FOUND = "ids binary, n_restored long"


def found_features(docs: DataFrame, keys: np.ndarray, language: bytes, keep: list[str]) -> DataFrame:
    """Columns ``keep``, the model's features that every whole text has (``ids``, four bytes each) and the number of restored words."""
    block = keys.tobytes()

    def work(texts: list[bytes]) -> list:
        owner, ids, restored = model_features(block, language)(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)) * 4
        every = ids.astype(np.int32).tobytes()
        return [[every[a:b] for a, b in zip(bounds, bounds[1:])], restored]

    return map_texts(docs, keep, FOUND, work, size=BATCH)


def tallied(found: DataFrame, n_features: int) -> DataFrame:
    """The distinct sets of features of toxic texts, and each single feature of clean texts, with the number of those texts. ``found`` has ids and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: Counter = Counter()
        clean, held = np.zeros(n_features, dtype=np.int64), 0

        def told(keys: list[bytes], toxic: int, n: list[int]):
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "toxic": pa.array([toxic] * len(keys), pa.int32()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            ids, toxic = batch.column("ids").to_pylist(), (np.asarray(batch.column("toxic")) > 0).tolist()
            clean += np.bincount(np.frombuffer(b"".join(x for x, y in zip(ids, toxic) if not y), np.int32), minlength=n_features)
            for x in (x for x, y in zip(ids, toxic) if y):
                sets[x] += 1
                held += len(x) // 4
            if held > FLUSH:
                yield told(list(sets), 1, list(sets.values()))
                sets, held = Counter(), 0
        yield told(list(sets), 1, list(sets.values()))
        seen = np.flatnonzero(clean)
        yield told([int(j).to_bytes(4, "little") for j in seen], 0, clean[seen].tolist())

    return stored(found.select("ids", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, TALLIED).groupBy("key", "toxic").agg(F.sum("n").alias("n")), "toxic-sets")


def spread_slopes(sets: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """``toxic_slopes`` of sets that are too many for the driver: each call is a job over them."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"block": pa.array([pack(*sets_of(batch.column("key").to_pylist(), batch.column("n").to_pylist()))], pa.binary())})

    blocks = stored(sets.select("key", "n").mapInArrow(packed, "block binary"), "toxic-blocks")

    def slopes(theta: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = np.zeros(len(theta))
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    mine += toxic_slopes(theta, *unpack(block))
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "slope": pa.array(mine[at])})

        # Sorted before they are added: the sum is the same whichever task ends first.
        added = F.aggregate(F.array_sort(F.collect_list("slope")), F.lit(0.0), lambda a, x: a + x)
        gradient = np.zeros(len(theta))
        for row in blocks.mapInArrow(part, "at long, slope double").groupBy("at").agg(added.alias("slope")).collect():
            gradient[row["at"]] = row["slope"]
        return gradient

    return slopes


def vocabulary(train: DataFrame, parts: int) -> tuple[np.ndarray, bytes, int] | None:
    """Keys of the model's features, the trigram model, and the number of clean texts; None without a labelled text."""
    counts = counted(train, parts)
    trigrams, total, toxic = np.zeros(ALPHABET ** 3, dtype=np.int64), 0, 0
    for row in counts.where("part < 0").collect():
        at, n, (total, toxic) = unpack(row.block)
        trigrams[at] = n
    if not total:
        return None
    return chosen_features(counts, int(total), int(toxic)), Language.of(trigrams).three.tobytes(), int(total - toxic)


def weighted(found: DataFrame, keys: np.ndarray, language: bytes, n_clean: int) -> Model:
    """The model, from the features found in the labelled texts (ids, toxic)."""
    sets = tallied(found, len(keys))
    clean = np.zeros(len(keys) + 1)
    clean[-1] = n_clean
    for row in sets.where("toxic = 0").collect():
        clean[int.from_bytes(row.key, "little")] = row.n
    sets = sets.where("toxic = 1")
    if (sets.agg(F.sum(F.length("key") / 4 + 1)).first()[0] or 0) <= ENTRIES:
        held = sorted((bytes(r.key), r.n) for r in sets.collect())
        at = sets_of([k for k, _ in held], [n for _, n in held])
        weights, bias = descend(lambda theta: toxic_slopes(theta, *at), clean)
    else:
        weights, bias = descend(spread_slopes(sets), clean)
    return Model(keys, weights, bias, language)


def fit(train: DataFrame, parts: int) -> Model | None:
    """Learn from texts with their label (text, toxic)."""
    known = vocabulary(train, parts)
    return None if known is None else weighted(found_features(train, known[0], known[1], ["toxic"]), *known)


def scored(found: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep``, the score (0 to 1), the prediction and the number of restored words, from the features found in every text."""
    source = found.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], "ids", "n_restored")
    schema = T.StructType(source.schema.fields[:-2] + T.StructType.fromDDL(RESULT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            owner = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
            scores = -np.expm1(-(model.bias + np.bincount(owner, model.weights[np.frombuffer(b"".join(ids), np.int32)], minlength=len(ids))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(scores, pa.float64()), pa.array((scores >= CUTOFF).astype(np.int32)), batch.column("n_restored")], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in T.StructType.fromDDL(RESULT)])


def unscored(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The result where nothing was learnt."""
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_restored"))


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``scored`` over whole texts."""
    return unscored(docs, keep) if model is None else scored(found_features(docs, model.keys, model.language, keep), model, keep)


def toxicity(docs: DataFrame, marks: DataFrame, keep: list[str]) -> DataFrame:
    """Learn from the labelled rows that are not held out, then score every document. Every text is decoded once."""
    bounded_batches(docs.sparkSession)
    marks = marks.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    few = marks.count() <= SMALL_LABELS
    marked = docs.where(~held_out(MODULUS)).select("doc_id", "text").join(F.broadcast(marks) if few else marks, F.col("doc_id") == F.col("__id"))
    # One row for each text and label: copies of one text say nothing about other words of it.
    first = stored(marked.groupBy(F.xxhash64(whole()).alias("mark"), "toxic").agg(F.min("doc_id").alias("__id")).select("__id", "toxic"), "toxic-first")
    first = F.broadcast(first) if first.count() <= SMALL_LABELS else first
    known = vocabulary(docs.select("doc_id", "text").join(first, F.col("doc_id") == F.col("__id")).select("text", "toxic"), 2 * partitions(docs.sparkSession))
    if known is None:
        return unscored(docs, keep)
    kept = {f"keep{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
    plain = docs.select(*[c.alias(n) for n, c in kept.items()], F.col("doc_id").alias("of"), "text")
    found = stored(found_features(plain, known[0], known[1], [*kept, "of"]), "toxic-features")
    model = weighted(found.select("of", "ids").join(first, F.col("of") == F.col("__id")).select("ids", "toxic"), *known)
    return scored(found.drop("of"), model, list(kept)).toDF(*keep, *[f.name for f in T.StructType.fromDDL(RESULT)])


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root)
    scored = toxicity(docs.withColumn("held_out", held_out(MODULUS)), labels(spark, root), ["doc_id", "held_out"])
    return scored
