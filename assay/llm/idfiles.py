"""Token ids in bit-plane or byte-plane files: fixed-size blocks of ids, transposed into planes, each plane compressed with zstandard.

A file is a Parquet table with one row per chunk, so it lies on any storage Spark writes to and a lost task leaves nothing half
written. A chunk holds the ids of whole documents (about ``CHUNK`` ids, or one longer document), cut into blocks of ``BLOCK``
ids. A block's ids are transposed into bit planes (all lowest bits, then all second-lowest, ...; or byte planes) and each plane is
compressed alone. Byte planes are the default: on these vocabularies they come out smaller than bit planes (1.33 against 1.55
bytes an id) and seven times as fast. The chunk index stands beside the planes: where each plane ends, how many ids lie
before the chunk in its part, and which documents it holds with how many ids each. A reader may open any chunk on its own.

Parts are ranges of doc_id, ascending; the number of ids before a part follows from one number per part.

Texts are encoded by the tokenizers library word by word where the vocabulary's normaliser and pattern never join across white space and put letters in
lower case; this is tried out when the vocabulary is loaded, and the tests hold it against encoding whole texts. Each distinct word of a stretch is
encoded once. With any other vocabulary whole texts are encoded.

Defined results: a null or empty text has the end id alone; rows without doc_id come first; rows with equal doc_id stand
side by side, each with its ids; an empty table gives no rows and no chunks; other columns do not matter. Texts of any length are one document
in one chunk; a task holds a batch of texts and one chunk.
"""

from __future__ import annotations

import functools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.llm.common import bounded_batches, documents, folder, numbering, partitions, register, small_batches, whole
from assay.llm.wordids import Encoded, WordIds, flattened, slices, tokenizer

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK = 32_768
CHUNK = 262_144
BATCH = 6_000_000

CHUNKS = ("part int, chunk int, first long, n_ids long, bits int, bit_planes boolean, block int, planes binary, plane_ends array<int>, "
          "doc_ids array<long>, doc_sizes array<long>")


LINE = 256
ENDS = (".", ",")


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts (UTF-8), and where each text begins (with the end).

    ASCII letters are put in lower case, as the normaliser does, except in texts that might name a special token.
    """
    try:
        plain = texts.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        plain = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(plain, "<|"), plain, pc.ascii_lower(plain)))
    pieces = split.flatten()
    filled = pc.not_equal(pc.binary_length(pieces), 0)  # white space at an end of a text leaves an empty piece
    starts = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))][split.offsets.to_numpy()]
    return pieces.filter(filled), starts


#: Every sign between, before and behind letters and digits, with white space of all kinds: texts that show whether words can be encoded apart.
PROBES = [f"Ab{c}cD {c} {c}{c}x\t9{c}Z\n {c}q{c}" for c in [*map(chr, range(33, 127)), "É", "ß", "ʼ", "中", "\u0301", "\U0001f600", "٣", "²"]]


class VocabularyIds:
    """The tokenizers library's ids of texts, by their words where that gives the same.

    Words of letters only are encoded many to a line; each ends with a piece that closes a word. A full stop or comma behind an ASCII
    letter is a piece of its own wherever it stands, so such a word takes the ids of the word before the mark, which often is known.
    """

    def __init__(self, path: str):
        self.made = tokenizer(path)
        vocab = self.made.get_vocab(with_added_tokens=True)
        suffix = self.made.model.end_of_word_suffix
        self.bits = max(vocab.values()).bit_length()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if suffix:
            self.closes[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        self.by_line = bool(suffix)
        self.marks = {m: self.made.encode(m, add_special_tokens=False).ids for m in ENDS}
        ids = lambda text: self.made.encode(text, add_special_tokens=False).ids
        self.cuts = self.by_line and all(len(i) == 1 and ids(f"{c}{m}") == [*ids(c), *i] and ids(f"{c}{c}{m}") == [*ids(c + c), *i]
                                         for m, i in self.marks.items() for c in string.ascii_lowercase)
        # A pattern that looks beyond a word, or a normaliser that keeps capitals or adds a sign, shows in one of the probes.
        self.apart = all(ids(t) == [i for w in words_of(pa.array([t.encode()]))[0].to_pylist() for i in ids(w)] for t in PROBES)
        self.words = WordIds(self.encode, limit=400_000)

    def _batch(self, texts: list[str]) -> Encoded:
        return flattened([e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, and where the ids of each begin and how many they are."""
        plain = np.array([self.by_line and t.isalpha() for t in texts], dtype=bool)
        ids, sizes = [np.zeros(0, np.uint32)] * 2, [np.zeros(0, np.int64)] * 2
        if plain.any():
            letters = [t for t, p in zip(texts, plain) if p]
            ids[0], _ = self._batch([" ".join(letters[i:i + LINE]) for i in range(0, len(letters), LINE)])
            sizes[0] = np.diff(np.r_[0, np.flatnonzero(self.closes[ids[0]]) + 1])
            if len(sizes[0]) != len(letters) or sizes[0].sum() != len(ids[0]):  # some letters are no letters to the vocabulary's pattern
                ids[0], sizes[0] = self._batch(letters)
        if not plain.all():
            ids[1], sizes[1] = self._batch([t for t, p in zip(texts, plain) if not p])
        every = np.concatenate(sizes)
        order = np.empty(len(texts), dtype=np.int64)
        order[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(texts))
        return np.concatenate(ids), (np.cumsum(every) - every)[order], every[order]

    def encode(self, words: list[str]) -> Encoded:
        held, known = len(self.words.begin), self.words.known
        fresh: dict[str, int] = numbering()
        source = np.empty(len(words), dtype=np.int64)  # a held word's number, or held plus the place among the fresh ones
        mark = np.zeros(len(words), dtype=np.uint32)
        for i, text in enumerate(words):
            if self.cuts and text[-1] in ENDS and "a" <= text[-2:-1] <= "z":
                mark[i] = self.marks[text[-1]][0]
                number = known.get(text[:-1])
                source[i] = number if number is not None and number < held else held + fresh[text[:-1]]
            else:
                source[i] = held + fresh[text]
        ids, begin, size = self._plain(list(fresh))
        old = source < held
        begin, size = np.append(begin, 0), np.append(size, 0)  # there may be no fresh word
        begin, size = begin[np.where(old, 0, source - held)], size[np.where(old, 0, source - held)]
        begin[old], size[old] = self.words.begin[source[old]], self.words.size[source[old]]
        total = size + (mark > 0)
        start = np.cumsum(total) - total
        out = np.empty(int(total.sum()), dtype=np.uint32)
        for flat, own in ((ids, ~old), (self.words.flat, old)):
            n = size[own]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(start[own], n) + within] = flat[np.repeat(begin[own], n) + within]
        out[(start + size)[mark > 0]] = mark[mark > 0]
        return out, total

    def __call__(self, texts: list[bytes] | pa.Array) -> Encoded:
        if not self.apart:
            return self._batch([t.decode("utf-8", "replace") for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
        words, starts = words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        return self.words.gathered(self.words.numbers_of(words), starts)


@functools.cache
def vocabulary_ids(path: str) -> VocabularyIds:
    return VocabularyIds(path)


def to_planes(ids: np.ndarray, bit_planes: bool, bits: int, block: int) -> tuple[bytes, list[int]]:
    """Compressed planes of all blocks, one after the other, and where each ends."""
    out, ends, total = [], [], 0
    packer = zstandard.ZstdCompressor(level=1)
    for start in range(0, len(ids), block):
        part = ids[start:start + block].astype("<u4")
        octets = part.view(np.uint8).reshape(-1, 4)[:, :(bits + 7) // 8]
        if bit_planes:
            planes = [np.packbits((part >> np.uint32(i)) & np.uint32(1)) for i in range(bits)]
        else:
            planes = [np.ascontiguousarray(octets[:, i]) for i in range(octets.shape[1])]
        for plane in planes:
            out.append(packer.compress(plane.tobytes()))
            total += len(out[-1])
            ends.append(total)
    return b"".join(out), ends


def from_planes(data: bytes, ends: list[int], n_ids: int, bit_planes: bool, bits: int, block: int) -> np.ndarray:
    """The ids again, as little-endian unsigned 32-bit integers."""
    opener = zstandard.ZstdDecompressor()
    per_block = bits if bit_planes else (bits + 7) // 8
    starts = [0, *ends[:-1]]
    out = np.zeros(n_ids, dtype="<u4")
    for b, start in enumerate(range(0, n_ids, block)):
        size = min(block, n_ids - start)
        for i in range(per_block):
            k = b * per_block + i
            plane = np.frombuffer(opener.decompress(data[starts[k]:ends[k]]), dtype=np.uint8)
            values = np.unpackbits(plane, count=size) if bit_planes else plane
            out[start:start + size] |= values.astype(np.uint32) << np.uint32(i if bit_planes else 8 * i)
    return out


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, bit_planes: bool = False, block: int = BLOCK,
              chunk: int = CHUNK, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``id_col``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = vocabulary_ids(vocabulary)
        bits = max(ids_of.bits, end_id.bit_length())
        part, number, first, total = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            planes, ends = to_planes(ids, bit_planes, bits, block)
            row = [part, number, first, len(ids), bits, bit_planes, block, planes, ends, list(doc_ids), list(sizes)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        end = np.array([end_id], dtype=np.uint32)
        for batch in small_batches(batches, "t", BATCH):
            ids, counts = ids_of(batch.column("t"))
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), slices(ids, counts)):
                doc_ids.append(doc_id)
                held += [own, end]
                sizes.append(len(own) + 1)
                total += sizes[-1]
                if total >= chunk:
                    yield flushed()
                    number, first, total = number + 1, first + total, 0
                    doc_ids.clear(), sizes.clear(), held.clear()
        if sizes:
            yield flushed()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col).cast("string")).cast("binary").alias("t"))
    bounded_batches(docs.sparkSession)
    ranged = source.repartitionByRange(parts or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(encode, CHUNKS).write.parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk with the number of ids before it in the whole output and the documents it holds; planes are not read."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = {r.part: r.n for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number per part
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    offsets = spark.createDataFrame([(p, n) for p, n in before.items()], "part int, before long")
    return chunks.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``), decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, bits, flag, block, planes, ends, doc_ids, sizes = (batch.column(i)[row].as_py() for i in range(batch.num_columns))
                ids = from_planes(planes, ends, n, flag, bits, block)
                own = list(slices(ids, np.array(sizes)))
                size = np.array(sizes, dtype=np.int64)
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(size) - size), pa.array(size), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(arrays)])

    columns = ["start", "n_ids", "bits", "bit_planes", "block", "planes", "plane_ends", "doc_ids", "doc_sizes"]
    return chunk_index(spark, path).select(columns).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


@register("op7_token_planes")
def op7_token_planes(spark: SparkSession, root: str) -> DataFrame:
    path = folder(spark, "token-planes")
    write_ids(documents(spark, root), path, public_tokenizers.path(VOCABULARY))
    return read_ids(spark, path)
