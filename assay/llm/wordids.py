"""Token ids of whole texts from the ids of their words, for tokenizers that never look across a word's border."""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from assay.llm.common import numbering

Encoded = tuple[np.ndarray, np.ndarray]  # all ids, and their number per item


def set_threads(threads: int) -> None:
    """Threads of the tokenizers library in this process; takes effect before its first batch."""
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"


@functools.cache
def tokenizer(path: str, threads: int = 1):
    """The tokenizers-library tokenizer of a file, once per worker process."""
    set_threads(threads)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def flattened(lists: list[list[int]]) -> Encoded:
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def slices(ids: np.ndarray, sizes: np.ndarray):
    end = 0
    for n in sizes.tolist():
        yield ids[end:end + n]
        end += n


class Growing:
    """An array that grows at its end without being copied each time."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1024, kind), 0

    @property
    def values(self) -> np.ndarray:
        return self.room[:self.size]

    def extend(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            room = np.zeros(max(end, len(self.room) * 3 // 2), self.room.dtype)
            room[:self.size] = self.values
            self.room = room
        self.room[self.size:end] = more
        self.size = end


class WordIds:
    """Ids of words (bytes or texts); each distinct word is encoded once while it is held, at most about ``limit`` words are held.

    At the limit the words met ``KEEP`` times or more since the last time stay.
    """

    KEEP = 3

    def __init__(self, encode: Callable[[list], Encoded], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = numbering()
        self._flat, self._begin, self._size, self._met = Growing(np.uint32), Growing(np.int64), Growing(np.int32), Growing(np.int32)

    @property
    def flat(self) -> np.ndarray:
        """All held ids; ``begin`` and ``size`` tell where those of each word are."""
        return self._flat.values

    @property
    def begin(self) -> np.ndarray:
        return self._begin.values

    @property
    def size(self) -> np.ndarray:
        return self._size.values

    def _renew(self) -> np.ndarray:
        """Drop the words that were met seldom; gives the old numbers of those that stay."""
        met = self._met.values
        stay = np.flatnonzero(met >= self.KEEP)
        if len(stay) > self.limit // 2:
            stay = stay[np.argsort(-met[stay], kind="stable")[:self.limit // 2]]
            stay.sort()
        words = list(self.known)
        flat, begin, size = self.flat, self.begin[stay], self.size[stay].astype(np.int64)
        self.clear()
        for i in stay.tolist():
            self.known[words[i]]
        ends = np.cumsum(size)
        self._flat.extend(flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)])
        self._begin.extend(ends - size)
        self._size.extend(size)
        self._met.extend(np.zeros(len(stay), np.int32))
        return stay

    def __call__(self, texts: list[list[bytes]]) -> Encoded:
        """All ids of the texts, given as lists of words, and their number per text."""
        return self.gathered(*self.numbers(texts))

    def gathered(self, at: np.ndarray, starts: np.ndarray) -> Encoded:
        """Ids of numbered words, and their number per text."""
        sizes = self.size[at].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.diff(np.r_[0, ends][starts])

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The words as numbers under which their ids are held until the next call, and where each text begins (with the end)."""
        held = self._ready()
        numbers, starts = [], [0]
        for words in texts:
            numbers.extend(map(self.known.__getitem__, words))
            starts.append(len(numbers))
        return self._learnt(held, np.array(numbers, dtype=np.int64)), np.array(starts)

    def numbers_of(self, words: pa.StringArray) -> np.ndarray:
        """The words as numbers; the words of an Arrow array are first reduced to its distinct ones."""
        held = self._ready()
        distinct = words.dictionary_encode()
        keys = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return self._learnt(held, place[distinct.indices.to_numpy()])

    def _ready(self) -> int:
        if len(self.known) > self.limit:
            self.renewed(self._renew())
        return len(self.known)

    def _learnt(self, held: int, at: np.ndarray) -> np.ndarray:
        """Encode the words that are new since there were ``held``."""
        if len(self.known) > held:
            ids, sizes = self.encode(list(self.known)[held:])
            self._begin.extend(len(self.flat) + np.cumsum(sizes) - sizes)
            self._size.extend(sizes)
            self._flat.extend(ids)
            self._met.extend(np.zeros(len(sizes), np.int32))
        self._met.values[:] += np.bincount(at, minlength=self._met.size).astype(np.int32)
        return at

    def renewed(self, stay: np.ndarray) -> None:
        """Called with the old numbers of the words that stay, for what else is held by number."""
