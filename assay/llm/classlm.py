"""Language-model scores from a Brown class-based bigram model.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class), both with half a count added.

1. **Counts.** Tasks condense their training words to (key, count) before the shuffle, split by key range; one task per range
   sums its words. The vocabulary stays a distributed table, one block per range, and grows with the corpus.
2. **Frequent words.** The largest words, ``FREQUENT`` at most (their number is read off a histogram of counts, so the bound is
   proven before anything is collected), go to every task. The ``CLUSTERED`` largest are clustered by exchange; every other frequent word then joins the
   learnt class that explains its neighbours best. Words beyond those, seen or not, belong to one of 16 classes by their last byte, which the key
   carries in its lowest bits.
3. **Exchange clustering.** All training texts are counted into a bigram matrix over clustered words and byte classes; its size
   depends on ``CLUSTERED`` only. Each word in turn moves to the class that raises the class-bigram likelihood most, until a
   round moves none or ``ROUNDS`` are done. This runs on the driver, over that bounded matrix.
   For the other frequent words tasks count the classes before and after each, by ranges of words; with the classes fixed, the task of a range
   gives each of its words the class of the largest likelihood. Transitions are then counted once more over all training texts.
4. **Scores.** A batch scores its frequent words itself. Its other words travel as compact blocks to the task that holds their
   range of the vocabulary, and sums per document come back; no word's postings gather in one task, as words left to this
   way are rare by construction.

Keys are 60 bits of a 64-bit hash and 4 bits of class; two words share a key with a chance below 1e-9 for 40,000 words and
about 1e-4 for 15 million, which changes one count by the other's.

Defined results: a null text counts as empty and consists of its end token; rows without doc_id belong to the training part;
every row gives one row, repeated rows too; with no training text all counts are 0; an empty table gives no rows; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.llm.common import batch_number, bounded_batches, documents, held_out, numbering, pack, partitions, register, small_batches, stored, unpack, whole

FREQUENT = 131_072
CLUSTERED = 2_048
LEARNED = 48      # classes found by exchange
SHAPES = 16       # classes of all other words, by last byte
ROUNDS = 8
RANGE = 4_096     # frequent words that one task gives classes to
BLOCK = 64        # rows of the bigram matrix that one task sums
FLUSH = 400_000   # distinct words a counting task holds before it sends them on
BATCH = 2_500_000
END = b""         # no word is empty

VOCAB = "part int, keys binary, counts binary, histogram binary"
RESULT = "doc_id bigint, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def key_of(word: bytes) -> int:
    """60 bits of hash, 4 bits of byte class."""
    return (xxhash.xxh3_64_intdigest(word) & ~15) | ((word[-1] if word else 0) & 15)


END_KEY = key_of(END)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all texts, each closed by the end token; where each text begins (with the end); the numbers' keys."""
    known, numbers, starts = numbering(), [], [0]
    known[END]  # number 0
    for text in texts:
        numbers.extend(map(known.__getitem__, text.lower().split()))
        numbers.append(0)
        starts.append(len(numbers))
    return np.array(numbers, dtype=np.int32), np.array(starts), np.array([key_of(w) for w in known], dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending keys that lie in one range."""
    bounds = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        yield int(i), slice(bounds[i], bounds[i + 1])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their total counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def vocabulary(train: DataFrame, parts: int) -> DataFrame:
    """The counted words of the training texts: one stored row per key range, with a histogram of their counts by power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            rows = [(part, pack(keys[s], counts[s])) for part, s in by_part(keys, parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])

        for batch in small_batches(batches, "t", BATCH):
            numbers, _, keys = tokens(batch.column("t").to_pylist())
            held.append((keys, np.bincount(numbers, minlength=len(keys)).astype(np.int64)))
            if sum(len(k) for k, _ in held) > FLUSH:
                yield from flushed()
        if held:
            yield from flushed()

    def add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = summed(*(np.concatenate(x) for x in zip(*map(unpack, frame.block))))
        keys, counts = keys[counts > 0], counts[counts > 0]
        histogram = np.bincount(np.log2(counts).astype(int), minlength=64)
        return pd.DataFrame({"part": [int(key[0])], "keys": [pack(keys)], "counts": [pack(counts)], "histogram": [pack(histogram)]})

    blocks = train.select(whole().cast("binary").alias("t")).mapInArrow(count, "part int, block binary")
    return stored(blocks.groupBy("part").applyInPandas(add_up, VOCAB), "vocabulary")


def frequent_words(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Keys and counts of the largest words, by count and key; the number of tokens and of distinct words."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, histogram in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (c,), (h,) = unpack(counts), unpack(histogram)
                yield pa.RecordBatch.from_pydict({"power": list(range(64)), "words": [int(x) for x in h], "tokens": [int(c.sum())] + [0] * 63})

    sums = vocab.select("counts", "histogram").mapInArrow(totals, "power long, words long, tokens long").groupBy("power").agg(
        F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
    words = {r.power: r.words for r in sums}
    total, distinct = sum(r.tokens for r in sums), sum(words.values())
    least, seen = 64, 0
    while least and seen + words.get(least - 1, 0) <= FREQUENT:
        least -= 1
        seen += words.get(least, 0)

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (k,), (c,) = unpack(keys), unpack(counts)
                take = c >= 2 ** least
                yield pa.RecordBatch.from_pydict({"keys": [k[take].tobytes()], "counts": [c[take].tobytes()]})

    rows = vocab.select("keys", "counts").mapInArrow(large, "keys binary, counts binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), dtype=np.uint64)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), dtype=np.int64)
    order = np.lexsort((keys, -counts))
    return keys[order], counts[order], total, distinct


@dataclass
class Words:
    """What every task knows of the frequent words, ascending by key: count and symbol (clustered word or byte class)."""
    keys: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    clustered: int
    classes: np.ndarray | None = None  # class of each of them, once they all have one

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> "Words":
        """``keys`` come largest first; the end token is a symbol of its own, after the byte classes."""
        plain = np.flatnonzero(keys != END_KEY)[:CLUSTERED]
        symbol = len(plain) + (keys & np.uint64(SHAPES - 1)).astype(np.int32)
        symbol[plain] = np.arange(len(plain))
        symbol[keys == END_KEY] = len(plain) + SHAPES
        order = np.argsort(keys)
        return cls(keys[order], counts[order], symbol[order], len(plain))

    @property
    def symbols(self) -> int:
        return self.clustered + SHAPES + 1

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, count and whether the word is one of the frequent ones."""
        if not len(self.keys):
            found, at = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
            symbol, counts = np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=np.int64)
        else:
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            symbol, counts = self.symbol[at], self.counts[at]
        shape = self.clustered + (keys & np.uint64(SHAPES - 1)).astype(np.int32)
        symbol = np.where(found, symbol, np.where(keys == np.uint64(END_KEY), self.symbols - 1, shape))
        return symbol, np.where(found, counts, 0), found


    def classes_of(self, keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Class of each word: its own if it is frequent, else that of its symbol."""
        symbol, _, found = self.look_up(keys)
        if self.classes is None or not found.any():
            return of[symbol]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(found, self.classes[at], of[symbol])


def bigrams(train: DataFrame, words: Words) -> np.ndarray:
    """How often symbol b follows symbol a over all training texts; a text begins after an end token."""
    n = words.symbols

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros(n * n, dtype=np.int64)
        for batch in small_batches(batches, "t", BATCH):
            numbers, _, keys = tokens(batch.column("t").to_pylist())
            symbol = words.look_up(keys)[0].astype(np.int64)[numbers]
            matrix += np.bincount(np.r_[n - 1, symbol[:-1]] * n + symbol, minlength=n * n)
        for i in range(0, n, BLOCK):
            if (block := matrix[i * n:(i + BLOCK) * n]).any():
                at = np.flatnonzero(block).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "block": pa.array([pack(np.diff(at, prepend=np.int32(0)), block[at].astype(np.int32))], pa.binary())})

    def add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK * n, dtype=np.int64)
        for gaps, counts in map(unpack, frame.block):
            total[np.cumsum(gaps)] += counts
        at = np.flatnonzero(total).astype(np.int32)
        return pd.DataFrame({"i": [int(key[0])], "block": [pack(at, total[at])]})

    rows = train.select(whole().cast("binary").alias("t")).mapInArrow(count, "i int, block binary").groupBy("i").applyInPandas(add_up, "i int, block binary").collect()
    matrix = np.zeros(n * n, dtype=np.int64)
    for row in rows:
        at, counts = unpack(row.block)
        matrix[row.i * n + at.astype(np.int64)] = counts
    return matrix.reshape(n, n)


def exchange(matrix: np.ndarray, clustered: int, learned: int = LEARNED, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every symbol. The first ``clustered`` symbols are moved; each of the others keeps a class of its own."""

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    n = len(matrix)
    classes = learned + n - clustered
    of = np.r_[np.arange(clustered) % learned, np.arange(learned, classes)]
    counts = matrix.astype(np.float64)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    after, before = counts @ member, counts.T @ member  # by symbol: counts with each class that follows, that goes before
    table = member.T @ after
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            a, own = of[w], counts[w, w]
            s, p = after[w].copy(), before[w].copy()
            s[a] -= own
            p[a] -= own
            table[a] -= s
            table[:, a] -= p
            table[a, a] -= own
            rows, columns = table[:learned], table[:, :learned].T
            diagonal = table[np.arange(learned), np.arange(learned)]
            up, left = f(rows + s) - f(rows), f(columns + p) - f(columns)
            corner = f(diagonal + s[:learned] + p[:learned] + own) - f(diagonal)
            d = np.arange(learned)
            total_row, total_column = rows.sum(1), columns.sum(1)
            gain = (up.sum(1) - up[d, d] + left.sum(1) - left[d, d] + corner
                    - f(total_row + s.sum() + own) + f(total_row) - f(total_column + p.sum() + own) + f(total_column))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += s
            table[:, b] += p
            table[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= counts[:, w]
                after[:, b] += counts[:, w]
                before[:, a] -= counts[w]
                before[:, b] += counts[w]
        if not moved:
            break
    return of


@dataclass
class Model:
    words: Words
    of: np.ndarray          # class of a symbol
    follows: np.ndarray     # log10 P(class | class before)
    emits: np.ndarray       # log10 of the denominator of P(word | class)
    tokens: int
    distinct: int


def shapes_of(vocab: DataFrame, words: Words) -> np.ndarray:
    """Number of distinct words in each byte class, without those that are frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                symbol, _, found = words.look_up(unpack(block)[0])
                symbol = symbol[~found] - words.clustered
                yield pa.RecordBatch.from_pydict({"shape": list(range(SHAPES)), "n": [int(x) for x in np.bincount(symbol[(symbol >= 0) & (symbol < SHAPES)], minlength=SHAPES)]})

    out = np.zeros(SHAPES, dtype=np.int64)
    for row in vocab.select("keys").mapInArrow(count, "shape long, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect():
        out[row["shape"]] = row["n"]
    return out


def class_table(train: DataFrame, words: Words, of: np.ndarray, classes: int) -> np.ndarray:
    """How often a word of class b follows one of class a over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes, dtype=np.int64)
        for batch in small_batches(batches, "t", BATCH):
            numbers, _, keys = tokens(batch.column("t").to_pylist())
            cls = words.classes_of(keys, of).astype(np.int64)[numbers]
            table += np.bincount(np.r_[of[-1], cls[:-1]] * classes + cls, minlength=classes * classes)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(table[at], pa.int64())})

    table = np.zeros(classes * classes, dtype=np.int64)
    for row in train.select(whole().cast("binary").alias("t")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row["cell"]] = row["n"]
    return table.reshape(classes, classes)


def best_classes(train: DataFrame, words: Words, of: np.ndarray, table: np.ndarray, learned: int = LEARNED) -> np.ndarray:
    """Class of every frequent word: of a clustered one its own, of another the learnt class under which its neighbours are the most likely.

    ``table`` has the class transitions with all other words in their byte classes; they stay fixed, so each word is judged alone, in the task of its range.
    """
    classes = len(table)
    smooth = np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * classes))
    going, coming, size = smooth[:learned].T, smooth[:, :learned], np.log(table.sum(0)[:learned] + 0.5)
    open_ = (words.symbol >= words.clustered) & (words.keys != np.uint64(END_KEY))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t", BATCH):
            numbers, _, keys = tokens(batch.column("t").to_pylist())
            symbol, _, found = words.look_up(keys)
            at = np.minimum(np.searchsorted(words.keys, keys), max(len(words.keys) - 1, 0))
            mine = np.where(found, at, -1)
            mine[found] = np.where(open_[at[found]], at[found], -1)
            cls, word = of[symbol].astype(np.int64)[numbers], mine[numbers]
            here = np.flatnonzero(word >= 0)  # never the end token, so another token follows
            before = np.where(here > 0, cls[here - 1], of[-1])
            pairs, times = np.unique(np.r_[word[here] * 2 * classes + cls[np.minimum(here + 1, len(cls) - 1)], (word[here] * 2 + 1) * classes + before], return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(0, len(words.keys) + RANGE, RANGE) * 2 * classes)
            rows = [(i, pack(pairs[a:b] - i * RANGE * 2 * classes, times[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["i", "block"])

    def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(RANGE * 2 * classes)
        for pairs, times in map(unpack, frame.block):
            seen[pairs] += times
        seen = seen.reshape(RANGE, 2, classes)
        gain = seen[:, 0] @ going + seen[:, 1] @ coming - seen[:, 0].sum(1)[:, None] * size
        held = np.flatnonzero(seen.any((1, 2)))
        return pd.DataFrame({"i": [int(key[0])], "block": [pack(held, gain[held].argmax(1))]})

    out = of[words.symbol]
    rows = train.select(whole().cast("binary").alias("t")).mapInArrow(count, "i int, block binary").groupBy("i").applyInPandas(choose, "i int, block binary")
    for row in rows.collect():  # a number for each frequent word
        held, best = unpack(row.block)
        out[row.i * RANGE + held] = best
    return out


def fit(train: DataFrame, vocab: DataFrame) -> Model:
    keys, counts, total, distinct = frequent_words(vocab)
    words = Words.of(keys, counts)
    matrix = bigrams(train, words)
    of = exchange(matrix, words.clustered)
    classes = int(of.max()) + 1
    member = np.zeros((len(of), classes))
    member[np.arange(len(of)), of] = 1
    table = member.T @ matrix @ member
    if len(words.keys) > words.clustered + 1:
        words.classes = best_classes(train, words, of, table)
        table = class_table(train, words, of, classes)
    own = words.classes if words.classes is not None else of[words.symbol]
    follows = np.log10((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * classes))
    distinct_of = np.bincount(own[words.keys != np.uint64(END_KEY)], minlength=classes).astype(float)
    distinct_of[of[words.clustered:words.clustered + SHAPES]] += shapes_of(vocab, words)
    distinct_of[of[-1]] += 1
    emits = np.log10(table.sum(0) + 0.5 * (distinct_of + 1))
    return Model(words, of, follows, emits, total, distinct)


def score(docs: DataFrame, model: Model, vocab: DataFrame, parts: int) -> DataFrame:
    """One row per document, columns as in ``RESULT``."""
    words, of = model.words, model.of
    unit = np.log10(model.tokens + 0.5 * (model.distinct + 1))
    sent = "part int, batch long, block binary, docs binary"

    def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequence, batch in enumerate(small_batches(batches, "t", BATCH)):
            numbers, starts, keys = tokens(batch.column("t").to_pylist())
            _, counts, found = words.look_up(keys)
            cls = words.classes_of(keys, of)[numbers]
            before = np.r_[of[-1], cls[:-1]]
            before[starts[:-1]] = of[-1]
            known = found[numbers]

            def per_text(values: np.ndarray) -> np.ndarray:
                total = np.r_[0, np.cumsum(values)]
                return total[starts[1:]] - total[starts[:-1]]

            # A sum per text and not a difference of running sums, which would lose digits.
            base = np.add.reduceat(np.where(known, np.log10(counts + 0.5)[numbers], 0.0), starts[:-1])
            rest = np.add.reduceat(model.follows[before, cls] - model.emits[cls], starts[:-1])
            number = batch_number(sequence)
            ids = np.asarray(batch.column("doc_id").fill_null(0))
            missing = np.asarray(batch.column("doc_id").is_null())
            part_col, blocks, doc_col = [-1 - number % parts], [None], [pack(
                ids, missing, np.asarray(batch.column("held_out").cast(pa.int8())), np.diff(starts), per_text(known), base, rest)]
            rare = np.flatnonzero(~known)
            owner = np.repeat(np.arange(len(ids)), np.diff(starts))[rare]
            order = np.argsort(keys)
            place = np.empty(len(keys), dtype=np.int64)
            place[order] = np.arange(len(keys))
            pairs, times = np.unique(place[numbers[rare]] * len(ids) + owner, return_counts=True)  # ascending by key, then text
            rare_keys, owner = keys[order][pairs // max(len(ids), 1)], (pairs % max(len(ids), 1)).astype(np.uint32)
            for part, s in by_part(rare_keys, parts):
                k, runs = np.unique(rare_keys[s], return_counts=True)
                part_col.append(part)
                blocks.append(pack(k, runs.astype(np.uint16 if runs.max() < 65536 else np.uint32), owner[s].astype(np.uint16 if len(ids) < 65536 else np.uint32), times[s].astype(np.uint16 if times[s].max() < 65536 else np.uint32)))
                doc_col.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(part_col, pa.int32()), pa.array([number] * len(part_col), pa.int64()),
                                              pa.array(blocks, pa.binary()), pa.array(doc_col, pa.binary())], names=["part", "batch", "block", "docs"])

    def reduce_side(key: tuple, frame: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return frame
        keys, counts = (unpack(held["keys"].iloc[0])[0], unpack(held["counts"].iloc[0])[0]) if len(held) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out = []
        for block in frame.block:
            k, runs, owner, times = unpack(block)
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            count = np.where(keys[at] == k, counts[at], 0) if len(keys) else np.zeros(len(k), np.int64)
            count = np.repeat(count, runs)
            who, where = np.unique(owner, return_inverse=True)
            out.append(pack(who, np.bincount(where, np.log10(count + 0.5) * times), np.bincount(where, (count > 0) * times).astype(np.int64)))
        return frame.assign(block=out)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, missing, held, n, known, base, rest = unpack(frame.docs[frame.docs.notna()].iloc[0])
        base, known = base.copy(), known.astype(np.int64)
        for block in frame.sort_values("part").block.dropna():
            who, part_base, part_known = unpack(block)
            base[who] += part_base
            known[who] += part_known
        return pd.DataFrame({"doc_id": pd.array(np.where(missing, 0, ids), dtype="Int64").copy() if not missing.any() else pd.array([None if m else int(i) for i, m in zip(ids, missing)], dtype="Int64"),
                             "held_out": held.astype(bool), "n_tokens": n, "n_known": known, "train_tokens": model.tokens,
                             "base_score": base - n * unit, "score": base + rest})

    source = docs.select("doc_id", held_out(5).alias("held_out"), whole().cast("binary").alias("t"))
    sent_blocks = source.mapInArrow(map_side, sent)
    answered = sent_blocks.groupBy("part").cogroup(vocab.groupBy("part")).applyInPandas(reduce_side, sent)
    return answered.groupBy("batch").applyInPandas(merge, RESULT)


def class_scores(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    parts = 2 * partitions(docs.sparkSession)
    train = docs.where(~held_out(5))
    vocab = vocabulary(train, parts)
    return score(docs, fit(train, vocab), vocab, parts)


@register("op2_class_lm")
def op2_class_lm(spark: SparkSession, root: str) -> DataFrame:
    return class_scores(documents(spark, root))
