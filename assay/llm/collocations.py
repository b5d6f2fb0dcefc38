"""Phrase collocations of each language, counted exactly in counting quotient filters that are merged across shards.

Texts are cut into pieces at punctuation and line ends, pieces into words. Candidates are phrases of 2 to ``LONGEST`` words that occur ``minimum``
times or more in their language. A cut of a phrase into two parts compares it with its parts' counts; the weakest cut gives the score.

1. **Word ids.** A map task numbers the words of its shard (about ``SHARD`` words of its texts) and keeps the shard as a sequence of
   numbers with breaks at pieces. The words travel by range of their hash to the task that sums them, which gives an id to every word
   of a language that occurs ``minimum`` times and returns the ids to the shards. Other words are breaks from here on: no candidate holds
   one. Nothing is broadcast; the vocabulary is as large as it is.
2. **Filters.** For n = 2, 3, … a shard packs the ids of every n consecutive words into one number of n * b bits and permutes these numbers
   invertibly (a Feistel network over the words). The high bits of a permuted number are its quotient, the others its full remainder: a counting
   quotient filter keeps, per quotient, the sorted run of remainders with their counters. As the remainder is whole and the permutation
   can be undone, nothing is lost, and equal filters' entries are equal phrases.
3. **Merging.** Filters of one range of all shards are merged by their sort order; a phrase that a third of all texts hold is one
   entry a shard. Counts of ``minimum`` or more are final. Each shard gets back one bit an entry, and goes on with those places
   only where both phrases of n words are frequent: an occurrence of a frequent phrase never holds a rare one, so no count is missed.
4. **Scores** are joins of the counted phrases with their parts, in DataFrame operations and whole numbers of 38 digits.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count as often as they stand; a text without words adds
nothing; a language without candidates has no rows; an empty table gives none; other columns do not matter.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from assay.llm.common import batch_number, bounded_batches, documents, pack, partitions, register, release, small_batches, stored, unpack, whole

MINIMUM = 100
LONGEST = 5
TOP = 2_000
BATCH = 1_000_000
SHARD = 1_400_000    # words of a shard, more if a single text is longer
PER_PART = 4_000_000  # words of the corpus for each range of filters
ROUNDS = 4           # of the permutation

BREAK = 0
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(PIECE_ENDS, b"." * len(PIECE_ENDS))

MADE = "part int, shard long, block binary, seq binary"
NAMED = "shard long, block binary, id long, lang binary, word binary, f long, n long"
STATE = "shard long, seq binary"
COUNTED = "shard long, part int, block binary, w array<long>, f long"


# --- numbers of n * b bits as columns of 64 bits, the highest first -----------------------------------------------------------------

def mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def packed(ids: list[np.ndarray], b: int) -> list[np.ndarray]:
    """Ids of b bits each, the first one highest, as one number in columns of 64 bits."""
    n = len(ids)
    columns = -(-n * b // 64)
    out = [np.zeros(len(ids[0]), np.uint64) for _ in range(columns)]
    for j, x in enumerate(ids):
        at, shift = divmod((n - 1 - j) * b, 64)
        out[columns - 1 - at] |= x << np.uint64(shift)
        if shift + b > 64:
            out[columns - 2 - at] |= x >> np.uint64(64 - shift)
    return out


def unpacked(words: list[np.ndarray], b: int, n: int) -> list[np.ndarray]:
    columns, out = len(words), []
    for j in range(n):
        at, shift = divmod((n - 1 - j) * b, 64)
        x = words[columns - 1 - at] >> np.uint64(shift)
        if shift + b > 64:
            x = x | (words[columns - 2 - at] << np.uint64(64 - shift))
        out.append(x & mask(b))
    return out


def scrambled(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(ids: list[np.ndarray], b: int) -> list[np.ndarray]:
    """An invertible permutation of n ids of b bits: each in turn is changed by a hash of all the others."""
    x = list(ids)
    for r, j in itertools.product(range(ROUNDS), range(len(x))):
        x[j] = x[j] ^ (_of_others(x, j, r) & mask(b))
    return x


def restored(ids: list[np.ndarray], b: int) -> list[np.ndarray]:
    x = list(ids)
    for r, j in itertools.product(reversed(range(ROUNDS)), reversed(range(len(x)))):
        x[j] = x[j] ^ (_of_others(x, j, r) & mask(b))
    return x


def _of_others(x: list[np.ndarray], j: int, r: int) -> np.ndarray:
    h = np.full(len(x[0]), 0x51ED27 + r, np.uint64)
    for i, other in enumerate(x):
        if i != j:
            h = scrambled(h ^ other, i + 1)
    return h >> np.uint64(7)


def ascending(words: list[np.ndarray]) -> np.ndarray:
    return np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])


def grouped(words: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ascending distinct numbers, their counts, and for every number given its place among them."""
    size = len(words[0])
    order = ascending(words)
    rows = [w[order] for w in words]
    new = np.zeros(size, bool)
    new[:1] = True
    for w in rows:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    place = np.empty(size, np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.diff(np.r_[first, size]) if counts is None else (np.add.reduceat(counts[order], first) if size else counts)
    return [w[first] for w in rows], total.astype(np.int64), place


class QuotientFilter:
    """Counters of distinct numbers of ``bits`` bits: per quotient (the high ``q`` bits) a sorted run of remainders (all other bits) with counters.

    The length of each run is kept, not the quotient; remainders are whole bytes; a counter is a byte, from 255 on a number beside them.
    """

    def __init__(self, bits: int, q: int, runs: np.ndarray, remainders: np.ndarray, counters: np.ndarray, large: np.ndarray):
        self.bits, self.q, self.runs, self.remainders, self.counters, self.large = bits, q, runs, remainders, counters, large

    @staticmethod
    def of(words: list[np.ndarray], counts: np.ndarray, bits: int) -> "QuotientFilter":
        """From ascending distinct numbers and their counts."""
        size = len(counts)
        q = min(bits, 30, max(size, 1).bit_length() - 1)
        top_bits = bits - 64 * (len(words) - 1)
        if q <= top_bits:
            quotient = words[0] >> np.uint64(top_bits - q) if q else np.zeros(size, np.uint64)
        else:
            quotient = (words[0] << np.uint64(q - top_bits)) | (words[1] >> np.uint64(64 - q + top_bits))
        runs = np.bincount(quotient.astype(np.int64), minlength=1 << q)
        runs = runs.astype(np.uint8 if runs.max(initial=0) < 256 else np.uint32)
        width = -(-(bits - q) // 8)
        every = np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(size, 8 * len(words))
        remainders = every[:, every.shape[1] - width:].copy()
        if width and (bits - q) % 8:
            remainders[:, 0] &= np.uint8((1 << (bits - q) % 8) - 1)
        return QuotientFilter(bits, q, runs, remainders, np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255])

    def entries(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The numbers, ascending, and their counts."""
        size, columns = len(self.counters), -(-self.bits // 64)
        every = np.zeros((size, 8 * columns), np.uint8)
        width = self.remainders.shape[1]
        every[:, every.shape[1] - width:] = self.remainders
        words = [w.astype(np.uint64) for w in every.view(">u8").reshape(size, columns).T]
        quotient = np.repeat(np.arange(1 << self.q, dtype=np.uint64), self.runs)
        at, shift = divmod(self.bits - self.q, 64)
        if self.q:
            words[columns - 1 - at] |= quotient << np.uint64(shift)
            if shift and shift + self.q > 64:
                words[columns - 2 - at] |= quotient >> np.uint64(64 - shift)
        counts = self.counters.astype(np.int64)
        counts[counts == 255] = self.large
        return words, counts

    def block(self) -> bytes:
        return pack(self.bits, self.q, self.runs, self.remainders, self.counters, self.large)

    @staticmethod
    def merged(filters: list["QuotientFilter"]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        """Distinct numbers of all filters with their sums, and the place of each filter's entries among them."""
        parts = [f.entries() for f in filters]
        words = [np.concatenate(x) for x in zip(*[p[0] for p in parts])]
        found, total, place = grouped(words, np.concatenate([p[1] for p in parts]))
        ends = np.cumsum([len(p[1]) for p in parts])
        return found, total, np.split(place, ends[:-1])


# --- words ------------------------------------------------------------------------------------------------------------------------

def split(text: bytes) -> list[bytes]:
    """Words of a text with ``b"."`` where a piece ends; A-Z in lower case. What is left of white space then is space and tab."""
    return text.lower().translate(TABLE).replace(b".", b" . ").split()


def joined_breaks(seq: np.ndarray, *beside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Drop all but one of neighbouring breaks, here and at the same places of arrays beside."""
    keep = seq != BREAK
    keep[1:] |= seq[:-1] != BREAK
    return tuple(x[keep] for x in (seq, *beside))


def packed_ids(ids: np.ndarray, *beside: np.ndarray) -> bytes:
    """A sequence of numbers by byte planes, of which the high ones are nearly empty."""
    return pack(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T), *map(np.packbits, beside))


def unpacked_ids(block: bytes) -> tuple[np.ndarray, ...]:
    planes, *beside = unpack(block)
    ids = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return ids, *[np.unpackbits(b, count=len(ids)).astype(bool) for b in beside]


def shards(docs: DataFrame, parts: int, lang_col: str, text_col: str) -> DataFrame:
    """Stored rows: a shard's sequence of word numbers; and per range of word hashes the shard's words, their numbers and counts."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).cast("binary").alias("lang"),
                         whole(F.col(f"`{text_col}`").cast("string")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known, held, sequence = itertools.count(1), {}, [], itertools.count()

        def flushed():
            shard = batch_number(next(sequence))
            seq, = joined_breaks(np.concatenate(held))
            keys = [lang + b" " + word for lang, words in known.items() for word in words if word != b"."]
            numbers = np.array([i for words in known.values() for word, i in words.items() if word != b"."], np.uint32)
            times = np.bincount(seq, minlength=len(numbers) + 1)[numbers]
            part = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(i, pack([keys[j] for j in order[a:b].tolist()], numbers[order[a:b]], times[order[a:b]].astype(np.uint32)))
                    for i, a, b in zip(range(parts), at, at[1:]) if b > a]
            known.clear()
            held.clear()
            yield pa.RecordBatch.from_arrays([
                pa.array([-1] + [r[0] for r in rows], pa.int32()), pa.array([shard] * (len(rows) + 1), pa.int64()),
                pa.array([None] + [r[1] for r in rows], pa.binary()), pa.array([packed_ids(seq)] + [None] * len(rows), pa.binary())], names=["part", "shard", "block", "seq"])

        for batch in small_batches(batches, "t", BATCH):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
                if lang not in known:
                    known[lang] = defaultdict(count.__next__)
                    known[lang][b"."] = BREAK
                words = split(text)
                words.append(b".")
                held.append(np.fromiter(map(known[lang].__getitem__, words), np.uint32, len(words)))
            if sum(map(len, held)) >= SHARD:
                yield from flushed()
                count = itertools.count(1)
        if held:
            yield from flushed()
        release()

    return stored(source.mapInArrow(run, MADE), "phrase-shards")


def named(made: DataFrame, parts: int, minimum: int) -> DataFrame:
    """Stored rows: for each shard its numbers' ids; every frequent word (id, lang, word, f); the words of each language (lang, n)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [unpack(b) for b in frame.block]
        coded = pa.array(itertools.chain.from_iterable(b[0] for b in blocks), pa.binary()).dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        total = np.zeros(len(words), np.int64)
        np.add.at(total, at, np.concatenate([b[2] for b in blocks]).astype(np.int64))
        often = sorted(np.flatnonzero(total >= minimum).tolist(), key=words.__getitem__)
        ids = np.zeros(len(words), np.int64)
        ids[often] = 1 + key[0] + parts * np.arange(len(often), dtype=np.int64)
        all_of = defaultdict(int)
        for word, n in zip(words, total.tolist()):
            all_of[word.rpartition(b" ")[0]] += n
        back, end = [], 0
        for shard, block in zip(frame.shard, blocks):
            mine = ids[at[end:end + len(block[1])]]
            end += len(block[1])
            if mine.any():
                back.append((shard, pack(block[1][mine > 0], mine[mine > 0])))
        rows = pd.DataFrame(
            [(s, b, None, None, None, None, None) for s, b in back]
            + [(None, None, int(ids[i]), *words[i].rpartition(b" ")[::2], int(total[i]), None) for i in often]
            + [(None, None, None, lang, None, None, n) for lang, n in all_of.items()], columns=["shard", "block", "id", "lang", "word", "f", "n"])
        return rows.astype({c: "Int64" for c in ("shard", "id", "f", "n")})

    return stored(made.where("part >= 0").select("part", "shard", "block").groupBy("part").applyInPandas(run, NAMED), "phrase-words")


def numbered(made: DataFrame, names: DataFrame) -> DataFrame:
    """Each shard as a sequence of ids, breaks for all words without one; words with breaks on both sides are left out."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"shard": [], "seq": []})
        seq, = unpacked_ids(left.seq.iloc[0])
        table = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
        for block in right.block:
            numbers, ids = unpack(block)
            table[numbers] = ids
        ids = table[seq]
        pair = (ids[1:] != BREAK) & (ids[:-1] != BREAK)
        ids, = joined_breaks(np.where(np.r_[pair, False] | np.r_[False, pair], ids, BREAK)) if len(ids) else (ids,)
        if not ids.any():
            return pd.DataFrame({"shard": [], "seq": []})
        return pd.DataFrame({"shard": [key[0]], "seq": [packed_ids(ids, ids != BREAK)]})

    left = made.where("part < 0").select("shard", "seq")
    right = names.where("shard IS NOT NULL").select("shard", "block")
    return stored(left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(run, STATE), "phrase-ids")


# --- phrases ----------------------------------------------------------------------------------------------------------------------

def places(seq: np.ndarray, live: np.ndarray, n: int) -> np.ndarray:
    """Where a phrase of n words may be frequent: both phrases of n - 1 words in it are."""
    return np.flatnonzero(live[:-1] & live[1:]) if len(seq) >= n else np.zeros(0, np.int64)


def phrases(seq: np.ndarray, at: np.ndarray, n: int, b: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct permuted phrases of a shard, ascending, with counts, and the phrase of every place."""
    return grouped(packed(permuted([seq[at + j].astype(np.uint64) for j in range(n)], b), b))


def part_of(words: list[np.ndarray], parts: int) -> np.ndarray:
    return (words[-1] % np.uint64(parts)).astype(np.int64)


def counted(state: DataFrame, n: int, b: int, parts: int, minimum: int) -> DataFrame:
    """Stored rows: frequent phrases (w, f), and for each shard and range one bit for each of its entries."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block in zip(batch.column("shard").to_pylist(), batch.column("seq").to_pylist()):
                seq, live = unpacked_ids(block)
                at = places(seq, live, n)
                if not len(at):
                    continue
                words, counts, _ = phrases(seq, at, n, b)
                part = part_of(words, parts)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(i, QuotientFilter.of([w[order[x:y]] for w in words], counts[order[x:y]], n * b).block())
                        for i, x, y in zip(range(parts), bounds, bounds[1:]) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()),
                                                  pa.array([r[1] for r in rows], pa.binary())], names=["part", "shard", "block"])
        release()

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        words, total, of = QuotientFilter.merged([QuotientFilter(*unpack(x)) for x in frame.block])
        often = total >= minimum
        bits = [pack(np.packbits(often[i]), len(i)) for i in of]
        ids = np.stack(restored(unpacked([w[often] for w in words], b, n), b), axis=1).astype(np.int64) if often.any() else np.zeros((0, n), np.int64)
        sent = pd.DataFrame({"shard": frame.shard.to_numpy(), "part": key[0], "block": bits, "w": None, "f": None})
        found = pd.DataFrame({"shard": None, "part": key[0], "block": None, "w": list(ids), "f": total[often]})
        del words, of
        release()
        both = pd.concat([sent.astype(object), found.astype(object)], ignore_index=True)
        return both.astype({"shard": "Int64", "part": "int32", "f": "Int64"})

    return stored(state.mapInArrow(send, "part int, shard long, block binary").groupBy("part").applyInPandas(merge, COUNTED), "phrase-counts")


def narrowed(state: DataFrame, counts: DataFrame, n: int, b: int, parts: int) -> DataFrame:
    """The shards with the places of frequent phrases of n words; words in none of them become breaks."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"shard": [], "seq": []})
        if not len(left) or not len(right):
            return nothing
        seq, live = unpacked_ids(left.seq.iloc[0])
        at = places(seq, live, n)
        words, _, place = phrases(seq, at, n, b)
        flags = np.zeros(len(words[0]), bool)
        order = np.argsort(part_of(words, parts), kind="stable")
        right = right.sort_values("part")
        flags[order] = np.concatenate([np.unpackbits(bits, count=size).astype(bool) for bits, size in map(unpack, right.block)])
        begin = at[flags[place]]
        if not len(begin):
            return nothing
        live, inside = np.zeros(len(seq), bool), np.zeros(len(seq), bool)
        live[begin] = True
        for j in range(n):
            inside[begin + j] = True
        seq, live = joined_breaks(np.where(inside, seq, 0).astype(np.uint32), live)
        return pd.DataFrame({"shard": [key[0]], "seq": [packed_ids(seq, live)]})

    back = counts.where("shard IS NOT NULL").select("shard", "part", "block")
    return stored(state.groupBy("shard").cogroup(back.groupBy("shard")).applyInPandas(run, STATE), "phrase-places")


def frequent(docs: DataFrame, minimum: int = MINIMUM, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts: phrases ``w`` (ids), ``f``, of 1 to ``longest`` words; words ``id, lang, word``; languages ``lang, n`` (words)."""
    spark = docs.sparkSession
    at_first = 2 * partitions(spark)
    made = shards(docs, at_first, lang_col, text_col)
    names = named(made, at_first, minimum)
    top, total = names.agg(F.max("id"), F.sum("n")).first()
    bits = max(1, int(top or 0).bit_length())
    if bits > 32:
        raise ValueError("more than four thousand million frequent words")
    parts = max(at_first, int(total or 0) // PER_PART)
    state = numbered(made, names)
    out = names.where("id IS NOT NULL").select(F.array("id").alias("w"), "f")
    for n in range(2, longest + 1):
        counts = counted(state, n, bits, parts, minimum)
        out = out.unionByName(counts.where("f IS NOT NULL").select("w", "f"))
        if n < longest:
            state = narrowed(state, counts, n, bits, parts)
    words = names.where("id IS NOT NULL").select("id", F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"))
    langs = names.where("n IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n"))
    return out, words, langs


def long_number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, minimum: int = MINIMUM, longest: int = LONGEST, top: int | None = TOP, **columns) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of every language (all of them if ``top`` is None)."""
    phrases_, words, langs = frequent(docs, minimum, longest, **columns)
    key = lambda c: F.array_join(c, ".")
    table = stored(phrases_.select(key(F.col("w").cast("array<string>")).alias("key"), "w", "f", F.size("w").alias("size")), "phrases")
    many = table.where("size >= 2").select("key", "w", "size", F.col("f").alias("a"))
    # Every frequent phrase covers the one without its last word and the one without its first; longer ones cover through these.
    covered = table.where("size >= 3").select("f", F.explode(F.array(F.expr("slice(w, 1, size - 1)"), F.expr("slice(w, 2, size - 1)"))).alias("inner")).groupBy(
        key(F.col("inner").cast("array<string>")).alias("key")).agg(F.max("f").alias("longer"))
    left = many.join(covered, "key", "left").where(F.col("longer").isNull() | (long_number("longer") * 100 < long_number("a") * 100)).drop("longer")
    cuts = left.select("key", "w", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).withColumns({
        "first": key(F.expr("slice(w, 1, k)").cast("array<string>")), "rest": key(F.expr("slice(w, k + 1, size - k)").cast("array<string>"))})
    counts = lambda name, out: table.select(F.col("key").alias(name), F.col("f").alias(out))
    spoken = words.join(langs, "lang").select(F.col("id").alias("begin"), "lang", "n")
    parts = cuts.join(counts("first", "l"), "first").join(counts("rest", "r"), "rest").withColumn("begin", F.element_at("w", 1)).join(spoken, "begin")
    # DIV of whole decimals is exact; the operands stay below 38 digits for counts below 10^17
    valued = parts.withColumn("score", F.expr("CAST(CAST(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0)) AS DECIMAL(38,0)) * 1000 AS DECIMAL(38,0)) DIV CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)) AS DECIMAL(38,0))"))
    best = valued.groupBy("key", "w", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = best.select("key", F.posexplode("w").alias("place", "id")).join(words.select("id", "word"), "id").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best.join(spelled, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = out.withColumn("rank", F.row_number().over(order))
    return (placed if top is None else placed.where(F.col("rank") <= top)).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM p),
g AS (SELECT lang, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM s, (SELECT unnest(range(1, {LONGEST + 1})) AS n) WHERE s + n - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, n AS size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MINIMUM}),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
longer AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[:size - 1], ' '), array_to_string(w[2:], ' ')]) AS part FROM c WHERE size >= 3) GROUP BY ALL),
k AS (SELECT c.*, unnest(range(1, size)) AS k FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.phrase = longer.part WHERE longer IS NULL OR 100 * longer < 100 * a),
v AS (SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, t.n, k, ((1000::HUGEINT * a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM k JOIN t ON t.lang = k.lang
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
m AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM m
QUALIFY rank <= {TOP}
"""


@register("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations(documents(spark, root))
